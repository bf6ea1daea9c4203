"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import free

#: Expected copies are whole multiples of 1 / UNIT, so that prefix sums are exact and reruns agree.
UNIT = 1 << 24


def word_count(text: str):
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """sizes (_source, source_size) with target: weights repeat over sources in order of code points, null last.

    Targets sum to share times all sizes. A target stops at ceiling times its source's size and the excess is shared
    anew by weight: sources in order of cap / weight are full up to the first whose level is below its own ratio.
    The table has a row for each source.
    """
    everywhere = Window.partitionBy(F.lit(0))
    named = everywhere.orderBy(F.col("_source").asc_nulls_last())
    at = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1
    rows = sizes.select("_source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at).alias("weight"))
    rows = rows.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = everywhere.orderBy("ratio", F.col("_source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    goal = F.lit(float(share)) * F.sum("source_size").over(everywhere)
    rows = rows.withColumn("level", (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("found", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everywhere))
    return rows.select("_source", "source_size", F.least("cap", F.coalesce(F.col("found"), F.col("ratio")) * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    slices: int = 64,
    seed: str = "mix",
) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document.

    Every document of a source expects target / source_size copies. Documents are laid out by size class, hashed slice,
    size and id; their expectations are summed up from a random start below one, and a document is taken once for each
    whole number that its stretch crosses. Laying out by size keeps the taken words near the target. A source's prefix
    sums come from the sums of its (class, slice) blocks, of which there are at most 4 * 40 * slices, so a source that
    holds most rows is still summed up in many tasks. Ids that repeat or are null, equal rows and null texts (size 0)
    are laid out like all others; a source without words has target 0. Columns of docs named like the four are replaced.
    """
    clean = docs.drop("size", "source_size", "target", "copies")
    klass, slice_, own, place, s, c, l, before, each, begin = free(clean.withColumns(dict.fromkeys(("size", "source_size", "target", "copies"), F.lit(0))), "_class", "_slice", "_own", "_place", "_s", "_c", "_l", "_before", "_each", "_begin")
    bits = F.bin(F.col("size"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    rows = clean.withColumn("size", word_count(text)).withColumns(
        {klass: F.length(bits) * 10 + F.conv(F.substring(bits, 1, 3), 2, 10).cast("int"), slice_: F.pmod(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), F.lit(slices)), own: F.col(source)}
    )
    blocks = rows.groupBy(F.col(own).alias("_source"), F.col(klass).alias("_class"), F.col(slice_).alias("_slice")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goals = targets(blocks.groupBy("_source").agg(F.sum("words").alias("source_size")), weights, share, ceiling)
    expected = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * UNIT), F.lit(int(ceiling * UNIT)))).otherwise(0)
    goals = goals.withColumn(each, expected.cast("long"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("start"), F.coalesce("_source", F.lit("null")))), 1, 6), 16, 10).cast("long")
    earlier = Window.partitionBy("_source").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col("_source").alias(s), F.col("_class").alias(c), F.col("_slice").alias(l), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(own, klass, slice_).orderBy("size", F.col(doc_id).asc_nulls_first(), F.md5(F.coalesce(F.col(text), F.lit(""))))
    placed = rows.withColumn(place, F.row_number().over(within)).join(offsets, F.col(own).eqNullSafe(F.col(s)) & (F.col(klass) == F.col(c)) & (F.col(slice_) == F.col(l))).drop(s, c, l)
    goals = goals.select(F.col("_source").alias(s), "source_size", "target", each, start.alias(begin))
    placed = placed.join(goals, F.col(own).eqNullSafe(F.col(s)))
    reach = (F.col(before) + F.col(place)).cast("decimal(38,0)") * F.col(each) + F.col(begin)
    crossed = F.floor(reach / UNIT) - F.floor((reach - F.col(each)) / UNIT)
    return placed.withColumn("copies", crossed.cast("long")).select(*clean.columns, "size", "source_size", "target", "copies")


def taken(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs with each row repeated as often as it is taken."""
    mixed = mix(docs, **options).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
