"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its potential comes from features of the line and of its neighbours, and neighbouring labels
are tied by transitions. Forward-backward marginals of `good`, weighted by line length, make a document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Byte classes: upper, lower, digit, bar, exclamation and question marks, sentence ends, other symbols, non-ASCII.
_CLASS = np.zeros((256, 8), np.float32)
_CLASS[65:91, 0] = _CLASS[97:123, 1] = _CLASS[48:58, 2] = 1
_CLASS[ord("|"), 3] = 1
_CLASS[[33, 63], 4] = 1
_CLASS[[44, 46, 58, 59], 5] = 1
_CLASS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126], 6] = 1
_CLASS[128:, 7] = 1
LINE_FEATURES = 24


def line_features(line: str, before: str) -> list[float]:
    """Numeric features of a line, about 0 to 1; before is the line before it."""
    raw = line.encode("utf-8", "surrogatepass")
    counts = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist() if raw else [0.0] * 8
    n, w = max(1, len(raw)), line.split()
    m = len(w)
    kinds = len(set(w)) / m if m else 0.0
    repeats = sum(map(eq, w, w[1:])) / m if m else 0.0
    letters = counts[0] + counts[1] + counts[7]
    mean = (sum(map(len, w)) / m) if m else 0.0
    return [
        *[c / n for c in counts], counts[0] / max(1.0, letters), float(counts[0] > 0.5 * letters and letters > 3), float(counts[3] > 0), float(counts[6] > 0.05 * n), float(counts[4] > 0.05 * n),
        kinds, float(kinds < 0.5 and m >= 6), repeats, float(repeats > 0.3), min(mean, 20) / 20, float(m == 0), float(m == 1), min(np.log1p(m), 8) / 8,
        float(line.rstrip()[-1:] in ".!?:\"'"), float(line[:1].isupper()), float(line == before and m > 0),
    ]


def document_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, and the lines' lengths; an empty text is one empty line."""
    lines = text.split("\n")
    own = np.array([line_features(x, y) for x, y in zip(lines, ["", *lines[:-1]], strict=True)], np.float32)
    edge = np.zeros((1, LINE_FEATURES), np.float32)
    rows = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(lines), 1), np.float32)])
    return rows, np.array([max(1, len(x)) for x in lines], np.float64)


def marginals(scores: list[np.ndarray], transitions: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per document P(good) of each line by forward-backward, and the expected transitions of all documents.

    scores: log-odds of good, by document. Documents are padded together by powers of two of their lengths.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    pairs = np.zeros((2, 2))
    lengths = np.array([len(s) for s in scores], int)
    kinds = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for kind in np.unique(kinds):
        which = np.flatnonzero(kinds == kind)
        for at in range(0, len(which), max(1, (1 << 18) >> int(kind))):
            part = which[at : at + max(1, (1 << 18) >> int(kind))]
            t, n = int(lengths[part].max()), len(part)
            node = np.zeros((t, n, 2))
            real = np.arange(t)[:, None] < lengths[part]
            for k, d in enumerate(part):
                node[: lengths[d], k, 1] = scores[d]
            forward, backward = np.zeros((t, n, 2)), np.zeros((t, n, 2))
            forward[0] = node[0]
            for i in range(1, t):
                step = forward[i - 1][:, :, None] + transitions
                forward[i] = np.where(real[i][:, None], np.logaddexp(step[:, 0], step[:, 1]) + node[i], forward[i - 1])
            for i in range(t - 2, -1, -1):
                step = (backward[i + 1] + node[i + 1])[:, None, :] + transitions
                backward[i] = np.where(real[i + 1][:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
            z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
            good = np.exp(np.minimum(forward[..., 1] + backward[..., 1] - z, 0))
            if t > 1:
                joint = forward[:-1, :, :, None] + transitions + (node[1:] + backward[1:])[:, :, None, :] - z[None, :, None, None]
                pairs += (np.exp(np.minimum(joint, 0)) * real[1:, :, None, None]).sum(axis=(0, 1))
            for k, d in enumerate(part):
                out[d] = good[: lengths[d], k]
    return out, pairs


class Model:
    """A fitted field: feature weights, transitions, and the map from length-weighted marginals to a probability."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, slope: float = 1.0, bias: float = 0.0):
        self.weights, self.transitions, self.slope, self.bias = weights, transitions, slope, bias

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted share of good lines."""
        docs = [document_lines(t or "") for t in texts]
        good, _ = marginals([rows @ self.weights for rows, _ in docs], self.transitions)
        return np.array([float((g * n).sum() / n.sum()) for g, (_, n) in zip(good, docs, strict=True)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.quality(texts)) + self.bias)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Maximum likelihood of the lines' labels (each line has its document's label) by Adam, then calibration."""
    rows = np.vstack([r for r, _ in docs]).astype(np.float64)
    sizes = np.array([len(n) for _, n in docs])
    cut = np.cumsum(sizes)[:-1]
    # a document weighs one line's worth per line up to 20, so that very long ones do not rule
    each = np.repeat(np.minimum(1, 20 / sizes), sizes)
    y = np.repeat(labels, sizes)
    total = each.sum()
    same = np.array([[((1 - labels) * (sizes - 1)).sum(), 0], [0, (labels * (sizes - 1)).sum()]], float)
    w, a = np.zeros(rows.shape[1]), np.zeros((2, 2))
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    for k in range(1, rounds + 1):
        good, pairs = marginals(np.split(rows @ w, cut), a)
        gw = rows.T @ ((y - np.concatenate(good)) * each) / total - l2 * w
        ga = (same - pairs) / max(1, sizes.sum()) - 0.05 * a
        mw, vw, ma, va = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * ma + 0.1 * ga, 0.99 * va + 0.01 * ga**2
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w = w + rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        a = a + rate * (ma / c1) / (np.sqrt(va / c2) + 1e-8)
    good, _ = marginals(np.split(rows @ w, cut), a)
    x = _logit(np.array([float((g * n).sum() / n.sum()) for g, (_, n) in zip(good, docs, strict=True)]))
    s, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(s * x + b)))
        s += 0.1 * (float(((labels - p) * x).mean()) - 0.001 * s)
        b += 0.3 * float((labels - p).mean())
    return Model(w, a, max(s, 0.05), b)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 6000) -> Model:
    """Fit on about `sample` labelled documents (the bound), chosen by a hash of the id; whole texts are used.

    labels has (doc_id, label 0/1); null labels and ids are ignored, repeated labels count each. With no
    labelled document every text has quality 0.5.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    n = known.count()
    if not n:
        return Model(np.zeros(3 * LINE_FEATURES + 1), np.zeros((2, 2)))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("quality"), F.col("_id")), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [document_lines(t) for t in pdf["t"]]
            yield pd.DataFrame({"_id": pdf["_id"], "_y": pdf["_y"], "rows": [r.tobytes() for r, _ in found], "sizes": [n.tobytes() for _, n in found]})

    held = rows.mapInPandas(features, "_id long, _y int, rows binary, sizes binary").collect()
    held.sort(key=lambda r: (r._id, r._y, r.rows))
    width = 3 * LINE_FEATURES + 1
    if not held:
        return Model(np.zeros(width), np.zeros((2, 2)))
    parsed = [(np.frombuffer(r.rows, np.float32).reshape(-1, width), np.frombuffer(r.sizes, np.float64)) for r in held]
    return train(parsed, np.array([r._y for r in held], float))


def scored(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """docs with a column `out`: probability that the document is good. Null and empty texts are one empty line."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double").asNondeterministic()(F.col(text)))
