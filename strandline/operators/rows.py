"""Operators on rows: ranking within groups, duplicates, identity keys and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that meet their partners in one task; ids that follow each other for a row's pairs.
BLOCK, RUN = 4096, 256


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank; Spark limits each task's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def mark_duplicates(df: DataFrame, group: str, best: Column, id_: str = "id") -> DataFrame:
    """duplicate_of: the id of the group's row with the largest `best` (which no two rows share) for all others; null keys stand alone.

    One aggregate a group, combined before the shuffle, and a join back, so that a large group is not sorted in one task.
    """
    leads = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.max_by(id_, best).alias("_lead"))
    joined = df.join(leads, F.col(group) == F.col("_g"), "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_lead") != F.col(id_), F.col("_lead"))).drop("_g", "_lead")


def nearest_ranks(df: DataFrame, group: str, value: str, ranks: dict[str, float], buckets: int = 1024) -> DataFrame:
    """group, n and a column for each of ranks: the exact nearest-rank percentiles of value (nulls left out).

    Values are counted in ranges of equal width first; only the ranges that hold a rank are sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    edges = rows.groupBy(F.col("g").alias("e")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")).cast("double")
    spot = F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width * (buckets - 1))).otherwise(0).cast("int")
    placed = rows.join(edges, F.col("g").eqNullSafe(F.col("e"))).select("g", "v", "n", spot.alias("spot"))
    counts = placed.groupBy("g", "n", "spot").agg(F.count("*").alias("k"))
    below = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("g").orderBy("spot")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(p) * F.col("n")).alias("rank")) for name, p in ranks.items()]))
    hit = below.select("g", "spot", "k", "upto", wanted.alias("w")).where((F.col("upto") >= F.col("w.rank")) & (F.col("upto") - F.col("k") < F.col("w.rank")))
    hit = hit.select(F.col("g").alias("h"), F.col("spot").alias("s"), "w.name", (F.col("w.rank") - F.col("upto") + F.col("k")).alias("rank"))
    near = placed.join(F.broadcast(hit), F.col("g").eqNullSafe(F.col("h")) & (F.col("spot") == F.col("s")))  # a row for each group and rank
    at = near.withColumn("at", F.row_number().over(Window.partitionBy("g", "name").orderBy("v"))).where("at = rank")
    found = at.groupBy(F.col("g").alias("f")).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return edges.join(found, F.col("e").eqNullSafe(F.col("f")), "left").select(F.col("e").alias(group), "n", *ranks)


def without_earlier(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Rows with no earlier row in their group (by columns in order), found with one minimum per group."""
    first = df.groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, F.col(group) == F.col("_g"), "left").where(F.col("_g").isNull() | (F.struct(*order) == F.col("_first"))).drop("_g", "_first")


def dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """left and right joined on keys; a key with more than `block` rows on the left is dealt into blocks by its other columns, each of which meets the right's rows of that key in a task of its own."""
    large = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    large = F.broadcast(large)  # no more rows than the left has blocks
    blocks = F.coalesce("_blocks", F.lit(1))
    place = F.pmod(F.xxhash64(*[c for c in left.columns if c not in keys]), blocks).cast("int")
    dealt_left = left.join(large, keys, "left").withColumn("_part", place).drop("_blocks")
    spread = right.join(large, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return dealt_left.join(spread, [*keys, "_part"]).drop("_part")


def identity_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], id_: str = "id") -> DataFrame:
    """Pairs of ids that share any of several keys, by one equi-join over exploded keys instead of an OR-join.

    A pair is told under the first key that its rows share, so none comes twice and none is shuffled to find out. Rows carry
    digests of the keys before theirs for that; ids of a side are taken as distinct.
    """

    def exploded(df: DataFrame, name: str, seen: str) -> DataFrame:
        text = [F.col(k).cast("string") for k in keys]
        earlier = lambda at: F.array(*[F.when(t.isNotNull(), F.md5(t.cast("binary"))) for t in text[:at]]).cast("array<string>")
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("value"), earlier(at).alias("earlier")) for at, (k, t) in enumerate(zip(keys, text, strict=True))])
        return df.select(F.col(id_).alias(name), F.explode(pairs).alias("k")).select(name, "k.kind", "k.value", F.col("k.earlier").alias(seen)).where("value is not null")

    met = dealt(exploded(left, "left_id", "seen_l"), exploded(right, "right_id", "seen_r"), ["kind", "value"])
    told = F.exists(F.zip_with("seen_l", "seen_r", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)
    return met.where(~told).select("left_id", "right_id")


def identity_pairs(df: DataFrame, keys: Sequence[str], id_: str = "id", block: int = BLOCK, run: int = RUN) -> DataFrame:
    """left_id < right_id: each pair of ids that share any of several keys, told under the first key they share.

    Values travel once, as digests; a key's ids are gathered in order into blocks of at most `block` ids that agree in the
    earlier keys, and only blocks meet. Pairs come in runs: the same `run` right ids for one left id after the other. Their
    number is the square of a group, and columnar files keep such repeats in a small part of what mixed pairs take.
    """
    kinds, seen = range(len(keys)), [f"seen{i}" for i in range(len(keys) - 1)]
    told = df.select(F.col(id_).alias("id"), *[F.unhex(F.md5(F.concat(F.lit(f"{i}:"), F.col(k).cast("string")))).alias(f"d{i}") for i, k in enumerate(keys)]).where("id is not null")
    earlier = lambda at: [(F.col(f"d{i}") if i < at else F.lit(None).cast("binary")).alias(name) for i, name in enumerate(seen)]
    rows = told.select("id", F.inline(F.array(*[F.struct(F.col(f"d{at}").alias("key"), *earlier(at)) for at in kinds]))).where("key is not null")
    own = Window.partitionBy("key")
    placed = rows.select("*", F.row_number().over(own.orderBy("id")).alias("at"), F.count("*").over(own).alias("n")).where("n > 1")
    number = lambda at: F.floor((F.col(at) - 1) / block).cast("int")
    blocks = placed.groupBy("key", *seen, number("at").alias("block"), number("n").alias("last")).agg(F.sort_array(F.collect_set("id")).alias("ids"))

    def dealt_out(low: str, high: str, partner: Column, *renamed: Column) -> DataFrame:
        side = blocks.withColumn("partner", F.explode(partner)).select("key", F.col(low).alias("i"), F.col(high).alias("j"), *renamed)
        return side.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j")  # a number, as bytes of blocks don't tell their pairs

    left = dealt_out("block", "partner", F.sequence("block", "last"), *[F.col(c).alias(f"l_{c}") for c in ("ids", *seen)])
    right = dealt_out("partner", "block", F.sequence(F.lit(0), "block"), *[F.col(c).alias(f"r_{c}") for c in ("ids", *seen)])
    met = left.join(right.hint("merge"), ["key", "i", "j"])
    for c in seen:
        met = met.where(~F.coalesce(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(False)))
    starts = F.sequence(F.lit(1), F.size("r_ids"), F.lit(run))
    parts = met.select("l_ids", F.explode(F.transform(starts, lambda at: F.slice("r_ids", at, run))).alias("run"))
    # The filter is a lambda, which ends the generated loop: else Spark holds all pairs of two blocks before it hands on the first.
    lefts = parts.select(F.explode(F.filter("l_ids", lambda left: left < F.element_at("run", -1))).alias("left_id"), "run")
    return lefts.select("left_id", F.explode("run").alias("right_id")).where("left_id < right_id")


def runs(df: DataFrame, group: str, order: Sequence[str], starts: Column, name: str = "run") -> DataFrame:
    """Numbers runs of rows: a new one begins where `starts` holds."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.sum(starts.cast("int")).over(w))
