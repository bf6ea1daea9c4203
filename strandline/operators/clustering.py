"""Greedy clustering of each window's best entries: order decides, and centroids move while it runs.

Spark takes the best entries of every window (the limit is part of the feature) and brings each window to a task; the fold there
looks up clusters by an inverted index of centroid tokens, so that an entry meets only clusters with which it shares a token.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import top_per_group

# Similarities from which an entry joins a cluster, and the bands they are reported in; share of members that keeps a token.
WEAK, JOIN, STRONG, SHARE, KEY_TOKENS = 0.18, 0.28, 0.42, 0.3, 20
UNTITLED = "未命名事件"


class Cluster:
    """Members in order of arrival, their token counts and the centroid that follows from them."""

    def __init__(self) -> None:
        self.members: list[dict] = []
        self.counts: Counter[str] = Counter()
        self.centroid: set[str] = set()
        self.best: float | None = None
        self.told: float | None = None

    def add(self, entry: dict) -> tuple[set[str], set[str]]:
        """Takes an entry in; tokens that came into the centroid and that left it."""
        self.members.append(entry)
        self.counts.update(entry["tokens"])
        least = max(1, math.ceil(len(self.members) * SHARE))
        before, self.centroid = self.centroid, {t for t, n in self.counts.items() if n >= least}
        return self.centroid - before, before - self.centroid

    def keys(self) -> list[str]:
        return sorted({m["explicit_key"] for m in self.members} - {""})

    def topic(self, untitled: str = UNTITLED) -> str:
        worth = lambda m: min(5.0, m["n_text"] / 400.0) if m["score"] is None else m["score"] / 10.0
        return max(self.members, key=lambda m: (worth(m), len(m["title"])))["title"] or untitled

    def key(self, by_topic: bool = True) -> str:
        """Its explicit key, else a hash of the first centroid tokens in order, else of the topic if keyed by that."""
        named = self.keys()
        if named:
            return named[0]
        basis = " ".join(sorted(self.centroid)[:KEY_TOKENS]) or (" ".join(self.topic().lower().split()) if by_topic else "")
        return hashlib.sha1(basis.encode()).hexdigest()[:16]

    def band(self) -> str:
        if self.best is None:
            return "explicit_or_single"
        return "strong" if self.best >= STRONG else "normal" if self.best >= JOIN else "weak_review" if self.best >= WEAK else "below"

    def reasons(self) -> list[str]:
        told = [("explicit_event_key", bool(self.keys())), ("article_duplicate_signal", any(m["duplicate_group"] for m in self.members)), ("independent_sources", len({m["source"] for m in self.members}) > 1)]
        out = [name for name, holds in told if holds] + ([f"token_similarity={self.told:.3f}"] if self.told is not None else [])
        return out or ["single_report_candidate"]


def fold(entries: Sequence[dict]) -> list[Cluster]:
    """Clusters of entries taken in order."""
    clusters: list[Cluster] = []
    with_token: dict[str, set[int]] = defaultdict(set)
    by_key: dict[str, int] = {}
    for entry in entries:
        at, best = by_key.get(entry["explicit_key"], -1), None
        if at < 0:
            shared = Counter(c for t in entry["tokens"] for c in with_token.get(t, ()))
            found = [(n / (len(entry["tokens"]) + len(clusters[c].centroid) - n), -c) for c, n in shared.items()]
            best, place = max(found, default=(0.0, 0))
            at = -place if found and best >= JOIN else -1
        if at < 0:
            at, best = len(clusters), None
            clusters.append(Cluster())
        cluster = clusters[at]
        came, left = cluster.add(entry)
        for t in came:
            with_token[t].add(at)
        for t in left:
            with_token[t].discard(at)
        cluster.told = None
        if best is not None:
            cluster.best = cluster.told = max(cluster.best or 0.0, best)
        if entry["explicit_key"]:
            by_key.setdefault(entry["explicit_key"], at)
    return clusters


SCHEMA = "cluster int, id long, event_key string, topic string, band string, best_similarity double, reasons string, size int, sources string, centroid string"


def greedy(entries: DataFrame, window: str = "window", limit: int = 200, excluded: Sequence[str] = (), untitled: str = UNTITLED, by_topic: bool = True) -> DataFrame:
    """A row for each of the `limit` best entries of a window, with its cluster and what the cluster is.

    entries has the window, id, title, tokens (array), n_text (length of title and summary), score (0 to 100 or null),
    explicit_key, duplicate_group and source. They are taken by score (null last), length of title, then id. Clusters whose
    key is excluded are left out. Null strings count as empty; an entry without tokens stands alone.
    untitled is the topic of a cluster without titles; by_topic keys a cluster without centroid by its topic, else they share
    the key of an empty text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    e = entries.select(
        F.col(window).alias("window"), F.col("id").cast("long").alias("id"), F.trim(text("title")).alias("title"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("n_text", F.lit(0)).alias("n_text"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score").cast("double"))).alias("score"), F.trim(text("explicit_key")).alias("explicit_key"), F.trim(text("duplicate_group")).alias("duplicate_group"), text("source").alias("source"),
    )
    first = top_per_group(e, ["window"], [F.coalesce("score", F.lit(-1.0)).desc(), F.length("title").desc(), F.asc("id")], limit, "place")
    skipped = frozenset(excluded)

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("place").to_dict("records")
        for r in ordered:
            r["tokens"], r["score"] = set(r["tokens"]), None if pd.isna(r["score"]) else r["score"]
        out = []
        for number, c in enumerate(fold(ordered)):
            key = c.key(by_topic)
            if key not in skipped:
                same = (key, c.topic(untitled), c.band(), c.best, ",".join(c.reasons()), len(c.members), ",".join(sorted({m["source"] for m in c.members} - {""})), " ".join(sorted(c.centroid)))
                out += [(m["window"], number, m["id"], *same) for m in c.members]
        return pd.DataFrame(out, columns=["window", *(part.split()[0] for part in SCHEMA.split(", "))])

    kind = e.schema["window"].dataType.simpleString()
    return first.groupBy("window").applyInPandas(clustered, f"window {kind}, {SCHEMA}").withColumnRenamed("window", window)
