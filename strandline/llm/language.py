"""Language identification by nearest centroids of normalised TF-IDF byte n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import buffers, chunks

FEATURES = 4096
_MULTIPLIER = np.uint32(2654435761)


def ngram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of a text's hashed 1-, 2- and 3-grams of bytes."""
    b = data.astype(np.uint32)
    grams = [b]
    if len(b) > 1:
        grams.append((b[:-1] | b[1:] << np.uint32(8)) + np.uint32(1 << 24))
    if len(b) > 2:
        grams.append((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) + np.uint32(2 << 24))
    return np.bincount((np.concatenate(grams) * _MULTIPLIER) >> np.uint32(20), minlength=FEATURES)


def count_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Count matrices of groups of whole documents, in order."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        for k in range(i, j, 64):
            yield np.stack([ngram_counts(data[offsets[x] : offsets[x + 1]]) for x in range(k, min(j, k + 64))])


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (log-damped counts); an empty row stays zero."""
    rows = np.log1p(counts.astype(np.float32)) * idf
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids by cosine; starts are spread by taking the farthest row each time."""
    k = min(k, len(rows))
    centres = [rows.mean(axis=0)]
    for _ in range(k - 1):
        centres.append(rows[int(np.argmin(np.max(rows @ np.stack(centres).T, axis=1)))])
    c = np.stack(centres)
    for _ in range(rounds):
        nearest = np.argmax(rows @ c.T, axis=1)
        sums = np.stack([rows[nearest == i].sum(axis=0) if (nearest == i).any() else c[i] for i in range(k)])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def length_class(n_bytes: np.ndarray) -> np.ndarray:
    """Length classes (powers of two up to 4096 bytes) for which distances are compared."""
    return np.minimum(np.floor(np.log2(np.maximum(n_bytes, 1))), 12).astype(int)


class Model:
    """Centroids of all languages, idf weights and the least cosine of each language's own texts by length class."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: place of the nearest centroid, its cosine, and whether that is too far."""
        lengths = np.diff(buffers(texts)[1])
        near, score = [], []
        for counts in count_rows(texts):
            sims = unit_rows(counts, self.idf) @ self.centroids.T
            near.append(np.argmax(sims, axis=1))
            score.append(np.max(sims, axis=1))
        near = np.concatenate([*near, np.zeros(0, int)]).astype(int)
        score = np.concatenate([*score, np.zeros(0)]).astype(float)
        return near, np.clip(score, 0, 1), score < self.floors[near, length_class(lengths)]


def _prepared(docs: DataFrame, text: str):
    """Lower-cased words of letters alone: symbols, digits and shouting say nothing about the language."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{M}]+", " "))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", clusters: int = 4, sample_per_language: int = 600, slack: float = 0.5) -> Model:
    """Learn from rows of train that have a language and a text with a letter; without any, every text is `und`, rejected.

    Document frequencies cover all of train. Centroids and distances are fitted per language on
    sample_per_language rows (the bound of the sample) chosen by a hash, or on all if there are fewer. A text is too far from its nearest centroid
    if its cosine is under slack times the one-percent quantile of that language's own texts of like length.
    """
    rows = train.select(F.col(lang).alias("lang"), _prepared(train, text).alias("text"), F.col(doc_id).alias("id")).where("lang is not null").where(r"text rlike '\\p{L}'")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for counts in count_rows(batch.column("text")):
                seen += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(seen)], ["feature", "n"])

    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.ones(FEATURES, np.float32), ["und"], np.zeros((1, FEATURES), np.float32), np.full((1, 13), np.inf))
    seen = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    for r in seen:
        df[r.feature] = r.n
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    # the rows with the least hashes of each language; Spark limits each task's before the shuffle, and equal rows are as good as others
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", "text"), F.xxhash64("text", "id"))
    sample = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_per_language).drop("place")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(pdf["text"], pa.string())
        unit = np.concatenate([unit_rows(c, idf) for c in count_rows(texts)])
        centres = spherical_kmeans(unit, clusters)
        own = np.max(unit @ centres.T, axis=1)
        kinds = length_class(np.diff(buffers(texts)[1]))
        floors = np.zeros(13)
        for k in range(12, -1, -1):
            floors[k] = np.quantile(own[kinds == k], 0.01) if (kinds == k).sum() >= 5 else (floors[k + 1] * 0.7 if k < 12 else own.min())
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.tolist() for c in centres], "floors": [(floors * slack).tolist()] * len(centres)})

    fitted = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, floors array<double>").collect()
    fitted.sort(key=lambda r: (r.lang, r.centroid))
    return Model(idf, [r.lang for r in fitted], np.array([r.centroid for r in fitted], np.float32), np.array([r.floors for r in fitted]))


def identify(docs: DataFrame, model: Model, out: str = "language", text: str = "text") -> DataFrame:
    """docs with a struct `out`: lang_pred, score (cosine, 0 to 1), rejected.

    Null texts and texts without a letter are `und`, score 0, rejected. Only the text is used; a column named like
    `out` is replaced. Equal texts get equal answers.
    """
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        near, score, far = model.predict(texts)
        ok = lettered.to_numpy(zero_copy_only=False).astype(bool)
        langs = np.array(model.langs, object)[near] if len(near) else np.zeros(0, object)
        return pa.StructArray.from_arrays([pa.array(np.where(ok, langs, "und"), pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(far | ~ok)], fields=list(kind))

    udf = F.arrow_udf(run, "struct<lang_pred:string,score:double,rejected:boolean>").asNondeterministic()
    prepared = _prepared(docs, text)
    return docs.drop(out).withColumn(out, udf(prepared, prepared.rlike(r"\p{L}")))


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo; null ids count as -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod, F.lit(-1))
