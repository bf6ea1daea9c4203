"""Rebalance of events: pairs that share a block key are scored for merging, scattered events are named for splitting.

Only open events are dealt with; a block has its first events by id; every pair is looked at once, at its first block. The
work is bounded by budgets and goes on behind a cursor, the place of the last pair looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scores import jaccard

# Size of a block, weights and thresholds of the suggestions, entities that make a key.
BLOCK, LEXICAL, BLOCKS, IDENTIFIER, MERGE, SPLIT, ENTITIES = 50, 0.55, 0.3, 0.15, 0.78, 0.65, 4
OPEN = ("active", "cooling", "reopened")


@dataclass(frozen=True)
class Cursor:
    """The last pair looked at, in order of block, left and right."""

    block: str
    left: int
    right: int


def block_keys(identifiers: Column, versions: Column, entities: Column, action: Column) -> Column:
    """Keys under which an event meets others."""
    named = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(kind), F.lower(x)))
    acted = F.when(F.coalesce(action, F.lit("")) != "", F.array(F.concat(F.lit("action:"), action))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named(identifiers, "id:canonical_identifier:"), named(versions, "id:version:"), named(F.slice(F.coalesce(entities, F.array().cast("array<string>")), 1, ENTITIES), "entity:"), acted))


def candidate_pairs(events: DataFrame) -> DataFrame:
    """(block, left, right): pairs of open events (event_id, status, keys) at the first block that both are in."""
    keyed = events.where(F.col("status").isin(*OPEN)).select("event_id", F.explode("keys").alias("block"))
    first = keyed.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("event_id"))).where(F.col("at") <= BLOCK).drop("at")
    a, b = first.withColumnRenamed("event_id", "left"), first.withColumnRenamed("event_id", "right")
    return a.join(b, "block").where("left < right").groupBy("left", "right").agg(F.min("block").alias("block"))


def run(events: DataFrame, max_pairs: int | None = None, cursor: Cursor | None = None) -> DataFrame:
    """Pairs looked at in this run with their scores, in order of block, left and right behind the cursor, and merge where one is suggested.

    events has event_id, status, keys and tokens. A run with a budget takes that many pairs; the last of them is the next
    run's cursor, and runs one behind the other look at the same pairs as one run without a budget.
    """
    pairs = candidate_pairs(events)
    if cursor is not None:
        pairs = pairs.where(F.struct("block", "left", "right") > F.struct(F.lit(cursor.block).alias("block"), F.lit(cursor.left).alias("left"), F.lit(cursor.right).alias("right")))
    if max_pairs is not None:
        pairs = pairs.orderBy("block", "left", "right").limit(max_pairs)
    side = lambda n: events.select(F.col("event_id").alias(n), F.col("tokens").alias(f"t_{n}"), F.col("keys").alias(f"k_{n}"))
    p = pairs.join(side("left"), "left").join(side("right"), "right")
    common = F.array_sort(F.array_intersect("k_left", "k_right"))
    p = p.withColumns({"lexical": jaccard(F.col("t_left"), F.col("t_right")), "common": common})
    known = F.exists("common", lambda k: k.startswith("id:")).cast("double")
    score = F.round(LEXICAL * F.col("lexical") + BLOCKS * F.least(F.lit(1.0), F.size("common") / 2) + IDENTIFIER * known, 4)
    return p.select("block", "left", "right", score.alias("score"), F.round("lexical", 4).alias("lexical"), F.array_join("common", ",").alias("common"), (score >= MERGE).alias("merge"))


def last_of(looked_at: DataFrame) -> Cursor | None:
    """The cursor behind a run."""
    row = looked_at.agg(F.max(F.struct("block", "left", "right")).alias("m")).first().m
    return Cursor(*row) if row else None


def splits(events: DataFrame) -> DataFrame:
    """Open events (event_id, status, dispersion, feedback) that should be split: too scattered, or reported as a wrong merge."""
    return events.where(F.col("status").isin(*OPEN) & ((F.coalesce("dispersion", F.lit(0.0)) >= SPLIT) | F.coalesce("feedback", F.lit(False)))).select("event_id", F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"))


def dispersion(members: DataFrame, event: str = "event_id") -> DataFrame:
    """Mean of 1 - Jaccard over the pairs of an event's members (id, tokens); 0 for one member."""
    m = members.select(F.col(event).alias("e"), "id", "tokens")
    pairs = m.alias("a").join(m.alias("b"), (F.col("a.e") == F.col("b.e")) & (F.col("a.id") < F.col("b.id")))
    apart = pairs.groupBy(F.col("a.e").alias("e")).agg(F.round(F.avg(1 - jaccard(F.col("a.tokens"), F.col("b.tokens"))), 3).alias("dispersion"))
    return m.select("e").distinct().join(apart, "e", "left").select(F.col("e").alias(event), F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"))
