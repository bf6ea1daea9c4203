"""The trie of conversation prefixes by truncation peeling.

Equal conversations are one sequence first. Then the trie is peeled from its deepest turns: at every depth the sequences that end
there join the nodes that survive from below, nodes with the same prefix merge, and the last turn is stripped, which names the
nodes of the depth above. A node's counts are sums over what merges in it, so finding and counting is one descent of depths.

Subtrees of at most `most` sequences are peeled by one task each, in one pass over rows that come in falling depth, with two depths
held at a time. What lies above, the few prefixes that more sequences share, is peeled depth by depth in Spark, with partial sums
before each shuffle; there are as many rounds as such a prefix is long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Sequences of a subtree that one task peels.
MOST = 1024
#: Parts into which the rows below a crowded prefix are dealt when they meet it in a join.
SALTS = 32

_KEY = ("depth", "k1", "k2")
_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, top boolean"


def turn_keys(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, chars): turns without their texts; null roles and texts are empty, rows without conv_id are left out."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"))
    return known.select("conv_id", "turn", "role", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))).alias("digest"), F.length("text").cast("long").alias("chars"))


def placed(keys: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): place from 1 by turn, null first; equal turns by role and digest."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return keys.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "chars")


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: depth, 128-bit keys of it and of the prefix above, length of its last text, whether it ends."""
    order = Window.partitionBy("conv_id").orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = turns.select("conv_id", "place", "chars", F.row_number().over(order).cast("long").alias("depth"), F.lead("place").over(order).isNull().alias("last"), "digest")
    hashed = own.select("*", *(F.xxhash64(F.lit(s), "depth", "digest").alias(f"h{s}") for s in (1, 2)))
    summed = hashed.select("*", *(F.bit_xor(f"h{s}").over(upto).alias(f"k{s}") for s in (1, 2)))
    return summed.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "chars", "last")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys, ids in order, as one row: smallest id, number and the hash of the listed ids."""
    key, first, n, digest = None, 0, 0, hashlib.sha256()
    out: list[tuple] = []
    names = [*_KEY, "conv_id", "n_ended", "ends"]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "ends" else pa.int64()) for name, c in zip(names, zip(*out, strict=True), strict=True)], names)

    for batch in batches:
        for *here, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != key:
                if key is not None:
                    out.append((*key, first, n, digest.hexdigest()))
                    if len(out) >= 4096:
                        yield made()
                        out = []
                key, first, n, digest = here, conv, 0, hashlib.sha256()
            digest.update(f"{',' if n else ''}{conv}".encode())
            n += 1
    if key is not None:
        out.append((*key, first, n, digest.hexdigest()))
    if out:
        yield made()


def sequences(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """Different conversations: key of the whole, smallest id, number of copies and hash of their ids. Conversations without turns end at the root."""
    whole = paths.where("last").select(*_KEY, "conv_id")
    bare = ids.distinct().join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    root = bare.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    ordered = whole.unionByName(root).repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return ordered.mapInArrow(_ended, "depth long, k1 long, k2 long, conv_id long, n_ended long, ends string")


_NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Node:
    __slots__ = ("chars", "children", "conv", "depth", "ends", "key", "leaves", "members", "parent", "saved")

    def __init__(self, depth: int, key: tuple, parent: tuple, chars: int, below: list[_Node]):
        self.depth, self.key, self.parent, self.chars, self.children = depth, key, parent, chars, below
        self.conv = min((c.conv for c in below), default=None)
        self.members = sum(c.members for c in below)
        self.ends = _NO_ENDS

    def end(self, conv: int, n: int, ends: str) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.members += n
        self.ends = ends

    def close(self) -> None:
        self.leaves = sum(c.leaves for c in self.children) if self.children else 1
        self.saved = sum(c.saved for c in self.children) + (self.members - 1) * self.chars

    def row(self, parent: int | None, top: bool) -> tuple:
        return (self.depth, *self.key, *self.parent, self.conv, parent, self.members, len(self.children), self.leaves, self.saved, self.ends, top)


_FIELDS = [*(pa.field(n, pa.int64()) for n in ("depth", "k1", "k2", "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")), pa.field("ends", pa.string()), pa.field("top", pa.bool_())]


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peels subtrees: rows by subtree, falling depth and key."""
    out: list[tuple] = []
    subtree, depth = None, 0
    here: dict[tuple, _Node] = {}
    below: dict[tuple, list[_Node]] = {}

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(_FIELDS, zip(*out, strict=True), strict=True)], schema=pa.schema(_FIELDS))

    def strip() -> None:
        """Closes the nodes of this depth, emits their children and strips the last turn: they wait under the prefix above."""
        nonlocal here, below
        up: dict[tuple, list[_Node]] = {}
        for node in here.values():
            node.close()
            out.extend(c.row(node.conv, False) for c in node.children)
            up.setdefault(node.parent, []).append(node)
            for c in node.children:
                c.children = ()
        here, below = {}, up

    def finish() -> None:
        nonlocal below
        strip()
        out.extend(n.row(None, True) for nodes in below.values() for n in nodes)
        below = {}

    for batch in batches:
        for s1, s2, d, k1, k2, p1, p2, chars, conv, n, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (s1, s2) != subtree:
                if subtree is not None:
                    finish()
                subtree, depth = (s1, s2), d
            elif d != depth:
                strip()
                depth = d
            node = here.get((k1, k2))
            if node is None:
                node = here[k1, k2] = _Node(d, (k1, k2), (p1, p2), chars, below.pop((k1, k2), []))
            if n:
                node.end(conv, n, ends)
            if len(out) >= 8192:
                yield made()
                out = []
    if subtree is not None:
        finish()
    if out:
        yield made()


def _at_prefix(rows: DataFrame, crowded: DataFrame, salt: str, how: str) -> DataFrame:
    """rows joined to the crowded prefixes on depth, k1, k2, with the rows of a prefix dealt to several tasks by the hash of a column."""
    dealt = crowded.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [*_KEY, "_salt"], how).drop("_salt")


def nodes(turns: DataFrame, ids: DataFrame, most: int = MOST) -> DataFrame:
    """All nodes of the trie of `turns` (conv_id, place, digest, chars), with the root when `ids` has a row.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of the
    ids of conversations that end in the node, in order). `ids` names all conversations; those without turns are at the root.
    Prefixes are told apart by 128 bits. No rows for empty `ids`.
    """
    paths = staged(prefixes(turns))
    ended = staged(sequences(paths, ids))
    own = paths.join(ended.where("depth > 0").select("conv_id", "n_ended", "ends"), "conv_id").withColumns({"n_ended": F.expr("if(last, n_ended, 0)"), "ends": F.expr("if(last, ends, null)")})
    counted = own.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    crowded = staged(counted.where(F.col("n") > most).drop("n"))
    flagged = _at_prefix(own, crowded.select(*_KEY, F.lit(True).alias("crowded")), "conv_id", "left").where("crowded is null")
    first = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = flagged.select(F.first("k1").over(first).alias("s1"), F.first("k2").over(first).alias("s2"), *_KEY, "p1", "p2", "chars", "conv_id", "n_ended", "ends")
    ordered = grouped.repartition("s1", "s2").sortWithinPartitions("s1", "s2", F.desc("depth"), "k1", "k2")
    peeled = staged(ordered.mapInArrow(_peel, _NODE))
    tops = peeled.where("top").drop("top", "parent_conv_id")

    deepest = crowded.agg(F.max("depth")).first()[0] or 0
    root = ids.limit(1).select(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(k) for k in ("k1", "k2", "chars", "p1", "p2")))
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        at = crowded.where(F.col("depth") == depth) if depth else root
        survivors = tops.where(F.col("depth") == depth + 1)
        if levels:
            survivors = survivors.unionByName(levels[-1])
        stripped = survivors.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs", F.lit(1).cast("long").alias("child"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends"))
        new = ended.where(F.col("depth") == depth).select("k1", "k2", "conv_id", F.col("n_ended").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in ("child", "n_leaves", "saved")), "ends")
        merged = stripped.unionByName(new).groupBy("k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
            F.sum("saved").alias("saved"), F.coalesce(F.max("ends"), F.lit(_NO_ENDS)).alias("ends"),
        )
        level = at.join(merged, ["k1", "k2"]).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
        levels.append(staged(level.select(*(c for c in tops.columns))))
    above = levels[0]
    for level in levels[1:]:
        above = above.unionByName(level)
    orphans = tops.unionByName(above).withColumns({"up": F.col("depth") - 1})
    parents = above.select(F.col("depth"), "k1", "k2", F.col("conv_id").alias("parent_conv_id"))
    keyed = orphans.select(F.col("up").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    found = _at_prefix(keyed, parents, "conv_id", "left").withColumn("depth", F.col("depth") + 1)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return peeled.where("not top").select(*columns).unionByName(found.select(*columns))
