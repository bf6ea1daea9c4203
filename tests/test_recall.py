"""Recall of events against a plain model over all pairs."""

import datetime
import random

from strandline.functions import signatures
from strandline.operators import recall

LIST = "array<string>"
SIDE = f"tokens {LIST}, entities {LIST}, action string, polarity string, place string, modality string, identifiers {LIST}, versions {LIST}, dates {LIST}, publish_time timestamp"
ROW = f"id long, {SIDE}, duplicate_of array<long>, alias_of array<long>, commentary boolean, status string"
EVENT = f"event_id long, {SIDE}, size long, dispersion double, status string, updated timestamp, id string"
DAY = datetime.datetime(2024, 5, 1)


def likeness(a, b):
    a, b = set(a or ()), set(b or ())
    return len(a & b) / len(a | b) if a and b else 0.0


def plain(rows, events, most, limit):
    """Every row with every event, one after the other."""
    newest = sorted((e for e in events if e["status"] in recall.OPEN), key=lambda e: (-e["updated"].timestamp(), e["event_id"]))[:most]
    out = {}
    for r in rows:
        found = []
        for e in newest:
            known = lambda x: {i.lower() for i in (x["identifiers"] or []) + (x["versions"] or [])}
            lexical = likeness(r["tokens"], e["tokens"])
            flags = {
                "canonical_identifier": bool(known(r) & known(e)), "duplicate_propagation": e["event_id"] in (r["duplicate_of"] or []), "entity_time": bool(set(r["entities"] or []) & set(e["entities"] or [])),
                "explicit_alias": e["event_id"] in (r["alias_of"] or []), "lexical": lexical >= recall.LEAST, "trigger_action": bool(r["action"]) and r["action"] == e["action"],
            }
            if not any(flags.values()) or e["status"] == "closed" and not (flags["canonical_identifier"] or flags["duplicate_propagation"] or flags["explicit_alias"]):
                continue
            points = flags["duplicate_propagation"] + flags["explicit_alias"] + flags["canonical_identifier"] + 0.5 * flags["entity_time"] + lexical
            found.append((-points, -e["updated"].timestamp(), -e["event_id"], ",".join(f for f, hit in flags.items() if hit)))
        for rank, (*_, event, reasons) in enumerate(sorted(found)[:limit], 1):
            out[(r["id"], -event)] = (rank, reasons)
    return out


def made(rng, n, more):
    pick = lambda names, k: rng.choice([None, rng.sample(names, rng.randrange(k))])
    return [
        {
            "tokens": pick([f"t{i}" for i in range(12)], 6), "entities": pick(["acme", "nato", "imf", "fed"], 2), "action": rng.choice([None, "", "launch", "deny"]), "polarity": "neutral", "place": "", "modality": "reported",
            "identifiers": rng.choice([None, [], ["A1"], ["b2"]]), "versions": rng.choice([None, [], ["1.2"]]), "dates": [], "publish_time": rng.choice([None, DAY]), **more(i, rng),
        }
        for i in range(n)
    ]


def test_recall_equals_a_walk_over_all_pairs(spark):
    rng = random.Random(11)
    events = made(rng, 30, lambda i, r: {"event_id": i, "size": r.randrange(30), "dispersion": r.choice([None, 0.5]), "status": r.choice([*recall.OPEN, "merged", None]), "updated": DAY - datetime.timedelta(hours=r.randrange(20)), "id": "clash"})
    rows = made(rng, 40, lambda i, r: {"id": i, "duplicate_of": r.choice([None, [], [r.randrange(30)]]), "alias_of": r.choice([None, None, [r.randrange(30), 999]]), "commentary": r.choice([None, False, True]), "status": "clash"})
    for most, limit in ((1500, 50), (9, 50), (1500, 3)):
        got = recall.candidates(spark.createDataFrame(rows, ROW), spark.createDataFrame(events, EVENT), most=most, limit=limit).collect()
        assert {(r.id, r.event_id): (r.rank, r.reasons) for r in got} == plain(rows, events, most, limit) and len(got) == len({(r.id, r.event_id) for r in got})
    assert recall.candidates(spark.createDataFrame([], ROW), spark.createDataFrame(events, EVENT)).count() == 0 == recall.candidates(spark.createDataFrame(rows, ROW), spark.createDataFrame([], EVENT)).count()


def test_relations_scores_and_thresholds(spark):
    base = {"tokens": ["a", "b"], "entities": ["acme"], "action": "launch", "polarity": "positive", "place": "", "modality": "reported", "identifiers": [], "versions": [], "dates": [], "publish_time": DAY}
    row = lambda i, **more: {**base, "id": i, "duplicate_of": None, "alias_of": None, "commentary": False, "status": None, **more}
    event = {**base, "event_id": 1, "size": 3, "dispersion": 0.0, "status": "active", "updated": DAY, "id": None}
    rows = [row(1), row(2, commentary=True), row(3, duplicate_of=[1]), row(4, place="london", duplicate_of=[1]), row(5, modality="denied"), row(6, alias_of=[1]), row(7, tokens=["z"], action="", publish_time=None)]
    got = {r.id: r for r in recall.candidates(spark.createDataFrame(rows, ROW), spark.createDataFrame([{**event, "place": "tokyo"}], EVENT)).collect()}
    # likeness 1, structure 0.65 + 0.25, same time: 0.45 + 0.225 + 0.15; a copy adds 0.1, an alias 0.05; one conflict takes 0.4
    assert [round(got[i].score, 4) for i in (1, 2, 3, 4, 6)] == [0.825, 0.825, 0.925, 0.525, 0.875]
    assert [got[i].relation for i in range(1, 8)] == ["same_event", "commentary", "duplicate", "unrelated", "event_update", "same_event", "unrelated"]
    assert [got[i].threshold for i in (1, 3, 6)] == [signatures.ATTACH, 0.54, 0.6] and got[4].conflicts == "different_location"
    # without a time 0.5 counts: 0.45 * 0.65 + 0.25 * 0.65 + 0.075
    assert round(got[7].score, 4) == 0.53
