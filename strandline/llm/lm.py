"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

A word's probability is that of its class given the context times that of the word within its class. Classes come from
word endings and have two digits, each with a softmax of its own: the first given the context, the second given the
context and the first. Scores are sums of weights of hashed context features: the word before, the pair before, and the
second and third word before (skips). Weights start from feature-class counts over all training texts and are moved by
distributed gradient updates: in each round every task sums expected minus observed counts over the texts of one slice,
Spark adds them up by feature, and the driver takes the step; one epoch of rounds sees every training text once. Within
a class the softmax has one indicator a word, whose solution is the smoothed count. Word counts are a Spark table of any
size; the rows of hashed features follow the training text up to a bound, as they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged
from .textbytes import LOWER, buffers, chunks, hashed, mix, words

DIGIT = 8
CLASSES = DIGIT * DIGIT
#: Rows of hashed features: a power of two, about one for each BYTES_A_ROW bytes of training text, within these bounds.
LEAST_ROWS, MOST_ROWS, BYTES_A_ROW = 1 << 14, 1 << 17, 1 << 15
BLOCK = 256
#: Bytes of text that one task sums up before its sums are shuffled.
TASK_BYTES = 1 << 27
END = np.uint64(0x51ED270B7F4A7C15)
START = np.uint64(0x2545F4914F6CDD1D)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token (words, then an end for each document), and per document the range of its tokens."""
    starts, ends, ranges = words(data, offsets)
    hashes = hashed(data, starts, ends)
    n = len(offsets) - 1
    bounds = ranges + np.arange(n + 1)
    last = np.zeros(len(hashes) + n, bool)
    last[bounds[1:] - 1] = True
    tok = np.full(len(last), END)
    tok[~last] = hashes
    cls = np.full(len(last), CLASSES - 1, np.int64)
    if len(hashes):
        final = LOWER[data[ends - 1]].astype(np.uint64)
        second = np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
        cls[~last] = (mix(final | second << np.uint64(8)) % np.uint64(CLASSES - 1)).astype(np.int64)
    return tok, cls, bounds


def features(tok: np.ndarray, bounds: np.ndarray, rows: int) -> np.ndarray:
    """Feature rows of each token, shape (4, tokens); rows is a power of two."""
    at = np.arange(len(tok)) - np.repeat(bounds[:-1], np.diff(bounds))

    def back(k: int) -> np.ndarray:
        out = np.full(len(tok), START)
        out[k:] = tok[:-k] if k else tok
        out[at < k] = START
        return out

    one, two, three = back(1), back(2), back(3)
    return np.stack([(mix(x ^ s) & np.uint64(rows - 1)).astype(np.int64) for x, s in zip((one, one * np.uint64(3) + two, two, three), _SALTS, strict=True)])


class ClassModel:
    """Class scores of tokens under weights of shape (1 + rows, DIGIT + CLASSES), whose first row is the bias.

    A row holds the scores of the first digit, then for each first digit those of the second.
    """

    STEP = 1 << 15  # tokens at a time

    def __init__(self, weights: np.ndarray):
        self.rows = len(weights) - 1
        self.bias = (weights[0, :DIGIT].copy(), weights[0, DIGIT:].reshape(DIGIT, DIGIT).copy())
        self.first, self.second = np.ascontiguousarray(weights[1:, :DIGIT]), np.ascontiguousarray(weights[1:, DIGIT:]).reshape(-1, DIGIT)

    def odds(self, feats: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised probabilities of the first digits, and of the second ones behind each token's own first digit."""
        digit = cls // DIGIT
        one, two = self.bias[0][None, :].repeat(len(cls), axis=0), self.bias[1][digit]
        for f in feats:
            one += self.first[f]
            two += self.second[f * DIGIT + digit]
        for scores in (one, two):
            scores -= scores.max(axis=1, keepdims=True)
            np.exp(scores, out=scores)
        return one, two

    def logs(self, feats: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's own class."""
        out = np.empty(len(cls))
        for at in range(0, len(cls), self.STEP):
            own = cls[at : at + self.STEP]
            one, two = self.odds(feats[:, at : at + self.STEP], own)
            n = np.arange(len(own))
            p = one[n, own // DIGIT] / one.sum(axis=1) * (two[n, own % DIGIT] / two.sum(axis=1))
            out[at : at + self.STEP] = np.log(np.maximum(p, 1e-30))
        return out

    def add_gradient(self, total: np.ndarray, feats: np.ndarray, cls: np.ndarray) -> None:
        """Adds expected minus observed counts to total, laid out by score: (DIGIT + DIGIT, (1 + rows) * DIGIT)."""
        one, two = self.odds(feats, cls)
        digit, n = cls // DIGIT, np.arange(len(cls))
        for p, own in ((one, digit), (two, cls % DIGIT)):
            p /= p.sum(axis=1, keepdims=True)
            p[n, own] -= 1
        one, two = one.T.astype(np.float64, order="C"), two.T.astype(np.float64, order="C")
        for k in range(DIGIT):
            total[k, 0] += one[k].sum()
            total[DIGIT + k, :DIGIT] += np.bincount(digit, two[k], DIGIT)
        for f in feats:
            both = f * DIGIT + digit
            for k in range(DIGIT):
                total[k, 1 : self.rows + 1] += np.bincount(f, one[k], self.rows)
                total[DIGIT + k, DIGIT:] += np.bincount(both, two[k], self.rows * DIGIT)


def _gradient_table(total: np.ndarray, rows: int) -> np.ndarray:
    """The sums of add_gradient in the layout of the weights."""
    return np.hstack([total[:DIGIT, : rows + 1].T, total[DIGIT:].reshape(DIGIT, rows + 1, DIGIT).transpose(1, 2, 0).reshape(rows + 1, CLASSES)])


def _summed(docs: DataFrame, tasks: int, rows: int, weights: np.ndarray | None) -> np.ndarray:
    """Feature-class counts (weights None) or the gradient over all texts, added up in Spark by blocks of features."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    step = 1 << 18  # tokens at a time
    width = CLASSES if weights is None else DIGIT + CLASSES
    padded_rows = -(-(rows + 1) // BLOCK) * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        model = None if held.value is None else ClassModel(held.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets, 1 << 21):
                lo, hi = offsets[i], offsets[j]
                tok, cls, bounds = tokens(data[lo:hi], offsets[i : j + 1] - lo)
                feats = features(tok, bounds, rows)
                total = np.zeros((rows + 1) * CLASSES if model is None else (2 * DIGIT, (rows + 1) * DIGIT)) if total is None else total
                for at in range(0, len(tok), step):
                    f, c = feats[:, at : at + step], cls[at : at + step]
                    if model:
                        model.add_gradient(total, f, c)
                    else:
                        total[:CLASSES] += np.bincount(c, minlength=CLASSES)
                        np.add.at(total, ((f + 1) * CLASSES + c).ravel(), 1.0)
        if total is not None:
            padded = np.zeros((padded_rows, width), np.float32)
            padded[: rows + 1] = total.reshape(rows + 1, CLASSES) if model is None else _gradient_table(total, rows)
            blocks = [padded[k : k + BLOCK].tobytes() for k in range(0, padded_rows, BLOCK)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["block", "part", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("sums"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    kind = "block int, part int, sums binary"
    found = docs.coalesce(tasks).mapInArrow(run, kind)
    while True:  # no sum takes more than 64 parts
        tasks = -(-tasks // 64)
        found = found.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("block", "part").applyInArrow(add, kind)
        if tasks == 1:
            break
    out = np.zeros((padded_rows, width))
    for r in found.collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.float32).reshape(BLOCK, width)
    held.destroy()
    return out[: rows + 1]


def train(texts: DataFrame, rounds: int = 4, blend: float = 0.35, prior: float = 8.0, step: float = 1.0) -> np.ndarray:
    """Class weights learned from all texts (column text): counts, then one epoch of `rounds` gradient updates.

    The texts are dealt into `rounds` slices by a hash; each update takes the gradient over one of them. It moves a
    feature's weights by observed minus expected counts over the counts expected in a slice plus a prior.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = 1 << int(np.clip(np.ceil(np.log2(max(1, size) / BYTES_A_ROW)), np.log2(LEAST_ROWS), np.log2(MOST_ROWS)))
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, int(size // TASK_BYTES) + 1)
    seen = _summed(texts, tasks, rows, None).reshape(rows + 1, DIGIT, DIGIT)

    def start(counts: np.ndarray) -> np.ndarray:
        """Bias and blended log ratios from counts of shape (1 + rows, ..., DIGIT)."""
        base = (counts[0] + 1) / (counts[0].sum(axis=-1, keepdims=True) + DIGIT)
        ratio = (counts[1:] + prior * base) / (counts[1:].sum(axis=-1, keepdims=True) + prior)
        return np.concatenate([np.log(base)[None], blend * (np.log(ratio) - np.log(base))])

    seen = np.hstack([seen.sum(axis=2), seen.reshape(rows + 1, CLASSES)])
    weights = np.hstack([start(seen[:, :DIGIT]), start(seen[:, DIGIT:].reshape(-1, DIGIT, DIGIT)).reshape(-1, CLASSES)])
    slice_ = F.pmod(F.xxhash64(F.lit("slice"), "text"), F.lit(rounds))
    for k in range(rounds):
        gradient = _summed(texts.where(slice_ == k), tasks, rows, weights.astype(np.float32))
        weights = weights - step / (len(_SALTS) + 1) * np.clip(gradient / (seen / rounds + prior), -2, 2)
    return weights.astype(np.float32)


def scored(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text", rounds: int = 4, batch_bytes: int = 12_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    held_out names a boolean column; all other rows are learned from (null counts as false). Null texts are empty: one
    token, the end. Documents are dealt into batches of about batch_bytes by a hash; each batch looks up the training
    counts of its different words once, so that words are shuffled once a batch and not once a token; a word that
    stands in every batch has one row a batch, a small part of any task's rows. Words are told apart by 64-bit hashes.
    Repeated rows are scored each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = train(rows.where("not held_out").select("text"), rounds)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // batch_bytes) + 1
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(parts, "batch")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("batch", pa.int32()), ("word", pa.int64()), ("cls", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            where = batch.column("batch").to_numpy()
            learned = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = buffers(batch.column("text"))
            found = []
            for i, j in chunks(offsets, 1 << 20):
                lo, hi = offsets[i], offsets[j]
                tok, cls, bounds = tokens(data[lo:hi], offsets[i : j + 1] - lo)
                sizes = np.diff(bounds)
                found.append((tok, cls, np.repeat(where[i:j], sizes), np.repeat(learned[i:j], sizes)))
            if not found:
                continue
            tok, cls, b, known = (np.concatenate(x) for x in zip(*found, strict=True))
            for k in np.unique(b):
                own = b == k
                u, first, inverse = np.unique(tok[own], return_index=True, return_inverse=True)
                counts = np.bincount(inverse, weights=known[own], minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(cls[own][first].astype(np.int32)), pa.array(counts)], schema=kind)

    by_word = Window.partitionBy("word")
    counted = dealt.select("batch", "held_out", "text").mapInArrow(vocabulary, "batch int, word long, cls int, n long").repartition(parts, "word")
    place = F.row_number().over(by_word.orderBy("batch"))
    kind = F.when(place == 1, F.col("cls"))  # one of a word's rows tells its class
    counted = staged(counted.select("batch", "word", F.sum("n").over(by_word).alias("c"), kind.alias("cls")))
    by_class = counted.where("cls is not null and c > 0").groupBy("cls").agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds"))
    totals = by_class.agg(F.sum("tokens").alias("N"), F.sum("kinds").alias("V"), F.map_from_entries(F.collect_list(F.struct("cls", (F.col("tokens") + F.col("kinds") + 1).alias("m")))).alias("m"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        word = right.column("word").combine_chunks().to_numpy().view(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        count = right.column("c").combine_chunks().to_numpy() if right.num_rows else np.zeros(0, np.int64)
        order = np.argsort(word)
        word, count = word[order], count[order]
        data, offsets = buffers(left.column("text"))
        out, classes_of = [], ClassModel(model.value)
        for i, j in chunks(offsets, 1 << 18):
            lo, hi = offsets[i], offsets[j]
            tok, cls, bounds = tokens(data[lo:hi], offsets[i : j + 1] - lo)
            c = count[np.searchsorted(word, tok)]
            feats = features(tok, bounds, classes_of.rows)
            own = classes_of.logs(feats, cls)
            first = bounds[:-1]
            doc = np.repeat(np.arange(j - i), np.diff(bounds))
            hist = np.bincount(doc * CLASSES + cls, minlength=(j - i) * CLASSES).reshape(j - i, CLASSES)
            out.append((np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(c + 1.0), first), np.add.reduceat(own, first) / np.log(10), hist))
        n_tokens, known, counts, classes, hist = (np.concatenate(x) for x in zip(*out, strict=True))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(hist.ravel().astype(np.int32)), CLASSES).cast(pa.list_(pa.int32()))
        return pa.table(
            {"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(known), "counts": pa.array(counts), "classes": pa.array(classes), "hist": lists}
        )

    lookup = counted.select("batch", "word", "c")
    found = dealt.groupBy("batch").cogroup(lookup.groupBy("batch")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, counts double, classes double, hist array<int>")
    t = totals.select(F.struct("N", "V", "m")).scalar()
    found = found.withColumn("t", t)
    within = F.aggregate(F.transform("hist", lambda k, i: F.when(k > 0, k * F.log10(F.coalesce(F.try_element_at(F.col("t.m"), i), F.lit(1)).cast("double"))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.coalesce("t.N", F.lit(0)).alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * F.log10((F.coalesce("t.N", F.lit(0)) + F.coalesce("t.V", F.lit(0)) + 1).cast("double"))).alias("base_score"), (F.col("classes") + F.col("counts") - within).alias("score"),
    )
