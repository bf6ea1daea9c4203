"""Lifecycle of events: what time without news makes of their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours that an event stays active after its last news, by type.
HOURS = {"breaking": 72, "product": 336, "policy": 720, "legal": 720, "default": 168}


def event_type(named: Column, action: Column) -> Column:
    """A type that is named, or the one that follows from the event's action."""
    low = F.lower(named)
    return F.when(low.isin(*[k for k in HOURS if k != "default"]), low).when(action == "launch", "product").when(action.isin("sue", "investigate"), "legal").otherwise("default")


def ticked(events: DataFrame, now: Column) -> DataFrame:
    """Events (status, named, action, updated, seen) with type, next_status, reason, checkpoint; the last two null where nothing changes.

    A reopened event becomes active; an active one cools after its type's hours, a cooling one closes after twice as many.
    Age counts from `updated`, or from `seen` where that is null; without either, or in another state, nothing changes.
    Ticks at the same time change nothing more, but for events that were closed or cooled at once by age: these go on by a
    state a tick. One projection, no shuffle.
    """
    kind = event_type(F.col("named"), F.col("action"))
    hours = F.element_at(F.create_map(*[F.lit(x) for p in HOURS.items() for x in p]), F.col("type"))
    e = events.withColumn("type", kind).withColumn("_hours", hours).withColumn("_age", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce("updated", "seen").cast("timestamp")))
    cools, closes = (F.col("status") == "active") & (F.col("_age") >= F.col("_hours") * 3600000000), (F.col("status") == "cooling") & (F.col("_age") >= F.col("_hours") * 7200000000)
    after = F.when(F.col("status") == "reopened", "active").when(cools, "cooling").when(closes, "closed").otherwise(F.col("status"))
    told = lambda n: F.concat(F.lit("no material update for "), n.cast("string"), F.lit("h"))
    reason = F.when(F.col("status") == "reopened", "reopen acknowledged by lifecycle tick").when(cools, told(F.col("_hours"))).when(closes, told(F.col("_hours") * 2))
    out = e.withColumns({"next_status": after, "reason": reason})
    return out.withColumn("checkpoint", F.when(F.col("reason").isNotNull(), F.concat("status", F.lit("->"), "next_status"))).drop("_hours", "_age")
