"""Personal data by fixed patterns, extended by bootstrapped contextual extraction.

Seeds are the base matches. The words around them are lexical patterns; identifier-like tokens that stand in the same
contexts are further instances. Spark scores the pattern-instance graph in rounds: a pattern's score is the mean score
of its different instances, an instance's score the noisy-or of its high-confidence patterns. Instances that reach the
threshold are added with the kind whose seeds induced the patterns.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import free, staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may be an identifier that no base pattern covers: a token with an at sign or with four or more digits.
_TOKEN = re.compile(r"[^\s,;<>()\[\]{}\"']*[0-9@][^\s,;<>()\[\]{}\"']*")


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all base matches, sorted; positions in code points."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # no match holds this @, and none crosses it
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


_WORD = re.compile(r"\S+")
#: Characters of a word, those nearest to the span, that a pattern holds.
NEAR = 100


class _Words:
    """The words of a text by their places, found once."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def context(self, start: int, end: int) -> list[str]:
        """Lexical patterns around a span: two words before it, two behind it, and the words on either side, however far away."""
        low = lambda a, b: re.sub("[0-9]", "0", self.text[a:b].lower())
        left, right = ["^", "^"], ["$", "$"]
        at, stop = bisect.bisect_left(self.starts, start), start
        for k in range(at - 1, max(-1, at - 3), -1):
            stop = min(stop, self.ends[k])
            left[1 - (at - 1 - k)] = low(max(self.starts[k], stop - NEAR), stop)
            stop = self.starts[k]
        at, begin = bisect.bisect_right(self.ends, end), end
        for k in range(at, min(len(self.ends), at + 2)):
            begin = max(begin, self.starts[k])
            right[k - at] = low(begin, min(self.ends[k], begin + NEAR))
            begin = self.ends[k]
        return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}", f"_ {right[0]} {right[1]}"]


def mentions(text: str) -> list[dict]:
    """Seeds and candidate tokens of a text with their patterns; kind is null for candidates."""
    base = base_spans(text)
    words = _Words(text) if base or _TOKEN.search(text) else None
    out = [{"start": s, "end": e, "kind": k, "instance": text[s:e].lower(), "patterns": words.context(s, e)} for s, k, e in base]
    i = 0
    ends = sorted((s, e) for s, _, e in base)
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".:!?")
        s, e = m.start(), m.start() + len(token)
        if "@" not in token and sum(map(str.isdigit, token)) < 4:
            continue
        while i < len(ends) and ends[i][1] <= s:
            i += 1
        if any(a < e and s < b for a, b in ends[max(0, i - 4) : i + 4]):
            continue
        out.append({"start": s, "end": e, "kind": None, "instance": token.lower(), "patterns": words.context(s, e)})
    return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MENTION_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)] if t else [] for t in texts.to_pylist()], _SPAN_TYPE)


def _mentions(texts: pa.Array) -> pa.Array:
    return pa.array([mentions(t) if t else [] for t in texts.to_pylist()], _MENTION_TYPE)


def spans_of(text: Column) -> Column:
    """The base spans of a text column, sorted by start and kind; null and empty texts have none."""
    return F.arrow_udf(_spans, _SPAN).asNondeterministic()(text)


def discovered(docs: DataFrame, text: str = "text", min_seeds: int = 3, confidence: float = 0.5, threshold: float = 0.8, rounds: int = 3) -> DataFrame:
    """Identifiers beyond the base matches: _text (xxhash64 of the text), start, end, kind, score.

    A pattern counts for a kind if it stands around min_seeds different seeds of that kind or more and its mean
    instance score is confidence or more. All texts are used, whole; rows with equal texts are one text.
    """
    find = F.arrow_udf(_mentions, "array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>").asNondeterministic()
    likely = docs.select(F.xxhash64(text).alias("_text"), F.col(text).alias("_t")).where("_t rlike '[0-9@]'")
    found = likely.select("_text", F.explode(find("_t")).alias("m")).select("_text", "m.*")
    found = staged(found.select("_text", "start", "end", "kind", "instance", F.explode("patterns").alias("pattern")))
    graph = staged(found.groupBy("pattern", "instance").agg(F.collect_set("kind").alias("seeds")))  # a seed can be of several kinds
    seeds = graph.select("pattern", F.explode("seeds").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds).select("pattern", "kind")
    edges = staged(graph.join(seeds, "pattern").select("pattern", "kind", "instance", F.when(F.array_contains("seeds", F.col("kind")), 1.0).otherwise(0.0).alias("given"), (F.size("seeds") == 0).alias("open")))
    scores = edges.groupBy("instance", "kind").agg(F.max("given").alias("score"))
    for _ in range(rounds):
        patterns = edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.avg("score").alias("confidence"))
        good = patterns.where(F.col("confidence") >= confidence)
        # a left join: instances without a good pattern keep their given score and stay in every pattern's mean
        voted = edges.join(good, ["pattern", "kind"], "left").groupBy("instance", "kind").agg(
            F.max("given").alias("given"), (1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))).alias("vote")
        )
        scores = staged(voted.select("instance", "kind", F.greatest("given", "vote").alias("score")))
    new = edges.where("open").select("instance", "kind").distinct().join(scores.where(F.col("score") >= threshold), ["instance", "kind"])
    best = new.groupBy("instance").agg(F.max(F.struct("score", F.negative("kind").alias("k"), "kind")).alias("b")).select("instance", "b.kind", "b.score")
    places = found.where("kind is null").select("_text", "start", "end", "instance").distinct()
    return places.join(best, "instance").select("_text", "start", "end", "kind", "score")


def with_spans(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans", **options) -> DataFrame:
    """docs with columns `base` (base spans) and `spans` (base and discovered ones, by start, then kind); such columns are replaced."""
    clean = docs.drop(base, spans)
    key, other, more = free(clean, "_text", "_key", "_more")
    # written out, so that Spark knows its size and need not shuffle the texts to few of them
    extra = staged(discovered(clean, text, **options).groupBy(F.col("_text").alias(other)).agg(F.collect_list(F.struct("start", "kind", "end")).alias(more)))
    keyed = clean.withColumns({base: spans_of(F.col(text)), key: F.xxhash64(text)})
    both = F.array_sort(F.concat(base, F.coalesce(F.col(more), F.array().cast(_SPAN))))
    return keyed.join(extra, F.col(key) == F.col(other), "left").withColumn(spans, both).drop(key, other, more)


def count_of(spans: str, kind: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")


def listing(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def _redact(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text and found:
            parts, at = [], 0
            for x in found:
                if x["end"] > at:
                    parts += [text[at : max(at, x["start"])], f"[{KINDS[x['kind']].upper()}]" if x["start"] >= at else ""]
                    at = x["end"]
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets, overlapping spans by the first; columns stay."""
    base, spans = free(docs, "base", "spans")
    found = with_spans(docs, text, base, spans, **options)
    changed = found.withColumn(text, F.when(F.size(spans) > 0, F.arrow_udf(_redact, "string")(F.col(text), F.col(spans))).otherwise(F.col(text)))
    if n_chars and n_chars in docs.columns:
        changed = changed.withColumn(n_chars, F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col(n_chars)))
    return changed.select(*docs.columns)
