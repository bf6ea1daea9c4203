"""Recall of the events to which a new row may belong, and what it is to each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import signatures
from strandline.functions.scores import jaccard

# Events that are looked through, candidates of a row, and the least likeness of words.
MOST, CANDIDATES, LEAST = 1500, 50, 0.12
OPEN = ("active", "cooling", "reopened", "closed")
#: Fields that are lists, empty where they are null.
LISTS = ("tokens", "entities", "identifiers", "versions", "dates")


def candidates(rows: DataFrame, events: DataFrame, *, most: int = MOST, least: float = LEAST, limit: int = CANDIDATES) -> DataFrame:
    """id, event_id, rank, reasons, score, conflicts, threshold, relation of the best `limit` events of every row.

    rows: id, signatures.FIELDS, duplicate_of and alias_of (arrays of event ids), commentary. events: event_id,
    signatures.FIELDS, size, dispersion, status, updated.

    A row meets the `most` events with the newest news, which is the rule of the operator and the bound of what is
    broadcast; rows stay where they are, and of a row's events only the best leave the task. An event is recalled by a
    shared entity, identifier or version, the same action, likeness of words, a copy in it or an alias; a closed one only
    by copy, alias or identifier. Ranked by the sum of evidence, then newest, then larger id. Null lists are empty, other
    nulls tell nothing; ids are keys, repeated ones share their ranks.
    """
    newest = events.where(F.col("status").isin(*OPEN)).orderBy(F.desc("updated"), "event_id").limit(most)
    lists = lambda c: F.coalesce(c, F.array().cast("array<string>")) if c in LISTS else F.col(c)
    known = F.concat(F.transform(lists("identifiers"), F.lower), F.transform(lists("versions"), F.lower))
    side = lambda mark: [*(lists(c).alias(f"{mark}_{c}") for c in signatures.FIELDS), known.alias(f"{mark}_known")]
    left = rows.select("id", *side("a"), "duplicate_of", "alias_of", F.coalesce("commentary", F.lit(False)).alias("commentary"))
    right = newest.select("event_id", *side("b"), "size", F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), "status", "updated")
    within = lambda c: F.coalesce(F.array_contains(c, F.col("event_id")), F.lit(False))
    shared = lambda c: F.coalesce(F.arrays_overlap(f"a_{c}", f"b_{c}"), F.lit(False))
    flags = {
        "canonical_identifier": shared("known"), "duplicate_propagation": within("duplicate_of"), "entity_time": shared("entities"), "explicit_alias": within("alias_of"),
        "lexical": jaccard(F.col("a_tokens"), F.col("b_tokens")) >= least, "trigger_action": F.coalesce((F.col("a_action") != "") & (F.col("a_action") == F.col("b_action")), F.lit(False)),
    }
    strong = flags["canonical_identifier"] | flags["duplicate_propagation"] | flags["explicit_alias"]
    met = strong | ((F.col("status") != "closed") & (flags["entity_time"] | flags["trigger_action"] | flags["lexical"]))
    p = left.join(F.broadcast(right), met).withColumns({**flags, "likeness": jaccard(F.col("a_tokens"), F.col("b_tokens"))})
    point = lambda c, n: F.when(F.col(c), n).otherwise(0.0)
    evidence = point("duplicate_propagation", 1.0) + point("explicit_alias", 1.0) + point("canonical_identifier", 1.0) + point("entity_time", 0.5) + F.col("likeness")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("evidence"), F.desc("updated"), F.desc("event_id")))
    p = p.withColumn("evidence", evidence).withColumn("rank", rank).where(F.col("rank") <= limit)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(f), f) for f in flags])), ",")
    p = p.withColumns({"reasons": reasons, "duplicate": F.col("duplicate_propagation"), "alias": F.col("explicit_alias")})
    return signatures.scored(p, known_pair=True, keep=("rank", "reasons"))
