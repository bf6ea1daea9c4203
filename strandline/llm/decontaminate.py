"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by size (powers of two of their distinct shingles). For each partition a document is cut
into overlapping windows of twice the partition's upper size, so that sets of like size are compared: a short item
inside a very long document meets a window in which it is not diluted. Items and windows are sketched by one-permutation
MinHash; a shared minimum in any bin makes a candidate, and the item is then verified by exact containment of its
shingles in the whole document. For the smallest partitions every shingle is a bin of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import free, staged
from .textbytes import buffers, chunks, shingles, word_hashes

BINS = 64
#: Items of fewer than 2**TINY shingles get a bin for each shingle; a piece of a document has PIECE shingles at most.
TINY, PIECE = 4, 1 << 16
_EMPTY = np.uint64(2**64 - 1)


def minima(hashes: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One-permutation MinHash of several sets: the least hash in each of BINS bins, by set."""
    out = np.full(groups * BINS, _EMPTY)
    at = group * BINS + (hashes >> np.uint64(58)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order]
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.minimum.reduceat(hashes, first)
    return out.reshape(groups, BINS)


class Items:
    """A block of test items: shingle sets and, for each size partition, a sorted index of MinHash values."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        data, offsets = buffers(pa.array(texts, pa.string()))
        hashes, ranges = word_hashes(data, offsets)
        self.ids, self.sets, self.index = [], [], {}
        by_band: dict[int, list[int]] = {}
        for k, item in enumerate(ids):
            seq = shingles(hashes[ranges[k] : ranges[k + 1]], n)
            if len(seq):
                by_band.setdefault(len(seq).bit_length(), []).append(len(self.sets))
                self.ids.append(item)
                self.sets.append(np.unique(seq))
        for band, which in by_band.items():
            group = np.repeat(np.arange(len(which)), [len(self.sets[k]) for k in which])
            flat = np.concatenate([self.sets[k] for k in which])
            owner = np.array(which)[group]
            if band > TINY:
                flat = minima(flat, group, len(which)).ravel()
                owner = np.repeat(np.array(which), BINS)
            owner, flat = owner[flat != _EMPTY], flat[flat != _EMPTY]
            order = np.argsort(flat, kind="stable")
            self.index[band] = (flat[order], owner[order])

    def candidates(self, seq: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of the document's shingle sequence."""
        found: set[int] = set()
        for band, (values, owner) in self.index.items():
            stride = 1 << band
            for at in range(0, len(seq), PIECE):
                piece = seq[at : at + PIECE + stride]
                if band > TINY:
                    # windows [i*stride, (i+2)*stride): minima of blocks of one stride, then of neighbouring blocks
                    blocks = minima(piece, np.arange(len(piece)) // stride, (len(piece) - 1) // stride + 1)
                    piece = np.minimum(blocks, np.r_[blocks[1:], blocks[-1:]]).ravel()
                lo, hi = np.searchsorted(values, piece, "left"), np.searchsorted(values, piece, "right")
                for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                    found.update(owner[a:b].tolist())
        return found


def leak_udf(items: Items, n: int, num: int, den: int):
    """A column function from text to its leaks: array of (item_id, n_item, n_shared), by item_id."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))

    def leaks(column: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        data, offsets = buffers(column)
        for i, j in chunks(offsets):
            lo, hi = offsets[i], offsets[j]
            hashes, ranges = word_hashes(data[lo:hi], offsets[i : j + 1] - lo)
            for k in range(j - i):
                seq = shingles(hashes[ranges[k] : ranges[k + 1]], n)
                found = []
                if len(seq) and items.sets:
                    candidates = items.candidates(seq)
                    members = np.unique(seq) if candidates else seq
                    for c in candidates:
                        shared = len(np.intersect1d(items.sets[c], members, assume_unique=True))
                        if den * shared >= num * len(items.sets[c]):
                            found.append({"item_id": items.ids[c], "n_item": len(items.sets[c]), "n_shared": shared})
                out.append(sorted(found, key=lambda x: (x["item_id"] is not None, x["item_id"])))
        return pa.array(out, kind)

    return F.arrow_udf(leaks, "array<struct<item_id:long,n_item:long,n_shared:long>>").asNondeterministic()  # else filters run it twice


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, n: int, num: int, den: int, block_chars: int) -> Iterator[tuple[int, Callable[[Column], Column]]]:
    """Number of blocks, and the leak function of each in turn; the driver holds one block's items at a time."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = int((rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        held = dealt.where(F.col("block") == b).orderBy("item_id", "text").collect()
        yield blocks, leak_udf(Items([r.item_id for r in held], [r.text for r in held], n), n, num, den)


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, num: int = 80, den: int = 100, block_chars: int = 8_000_000
) -> DataFrame:
    """A row for each (document, item) with num/den or more of the item's distinct n-word shingles in the whole text: doc_id, item_id, n_item, n_shared, containment.

    Items are taken in blocks of about block_chars characters, the bound of what the driver and a task hold; there is
    one pass over the documents for each block, and its result is staged before the next. Null and empty items and
    documents match nothing; a text of fewer than n words is one shingle, the whole sequence. Repeated rows and items
    are reported each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = []
    for blocks, found in _blocks(benchmark, item_id, item_text, n, num, den, block_chars):
        part = rows.select("doc_id", F.explode(found(F.col("text"))).alias("x")).select("doc_id", "x.item_id", "x.n_item", "x.n_shared")
        parts.append(part if blocks == 1 else staged(part))
    return reduce(DataFrame.unionByName, parts).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, num: int = 80, den: int = 100, block_chars: int = 8_000_000
) -> DataFrame:
    """docs without those that hold a test item; columns stay as they are. Blocks of items are taken as in leaks."""
    (leaked,) = free(docs, "_leaks")
    hashes = []
    for blocks, found in _blocks(benchmark, item_id, item_text, n, num, den, block_chars):
        held = found(F.coalesce(F.col(text), F.lit("")))
        if blocks == 1:
            return docs.withColumn(leaked, held).where(F.size(leaked) == 0).drop(leaked)
        hashes.append(staged(docs.where(F.size(held) > 0).select(F.sha2(text, 256).alias(leaked)).distinct()))
    gone = reduce(DataFrame.union, hashes).distinct()
    return docs.join(gone, F.coalesce(F.sha2(text, 256), F.lit("")) == F.col(leaked), "left_anti")
