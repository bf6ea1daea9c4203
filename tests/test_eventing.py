"""Clustering, online assignment, rebalance, operation logs and upserts against sequential models and replays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import rules
from strandline.operators import clustering, oplog, rebalance
from strandline.plans import eventing, registry
from strandline.sources import sinks
from strandline.streaming import assignment

SF = "/root/testdata/sf0.001"


def plain_clusters(rows):
    """Every entry against every centroid, in order."""
    clusters, by_key = [], {}
    for r in rows:
        at, best = by_key.get(r["explicit_key"]) if r["explicit_key"] else None, 0.0
        if at is None:
            for k, c in enumerate(clusters):
                union = len(r["tokens"] | c["centroid"])
                sim = len(r["tokens"] & c["centroid"]) / union if r["tokens"] and c["centroid"] else 0.0
                if sim > best:
                    best, at = sim, k
            at = at if best >= 0.28 else None
            if at is not None:
                clusters[at]["best"] = max(clusters[at]["best"] or 0.0, best)
        if at is None:
            clusters.append({"ids": [], "tokens": [], "best": None})
            at = len(clusters) - 1
        c = clusters[at]
        c["ids"].append(r["id"])
        c["tokens"].append(r["tokens"])
        c["centroid"] = {t for t in set().union(*c["tokens"]) if sum(t in x for x in c["tokens"]) >= max(1, math.ceil(len(c["ids"]) * 0.3))}
        if r["explicit_key"]:
            by_key.setdefault(r["explicit_key"], at)
    return [(c["ids"], c["best"], " ".join(sorted(c["centroid"]))) for c in clusters]


def test_greedy_equals_a_sequential_model_on_a_thousand_headlines(spark):
    e = eventing.entries(spark, "/root/testdata/sf0.01").withColumn("window", F.lit("all"))
    rows = [r.asDict() for r in e.collect()]
    rows.sort(key=lambda r: (-(r["score"] if r["score"] is not None else -1.0), -len((r["title"] or "").strip()), r["id"]))
    for r in rows:
        r["tokens"], r["explicit_key"] = set(r["tokens"]), r["explicit_key"] or ""
    want = plain_clusters(rows)
    got = {}
    for r in clustering.greedy(e, limit=100000).collect():
        got.setdefault(r.cluster, [set(), r.best_similarity, r.centroid])[0].add(r.id)
    assert [(set(ids), best, centroid) for ids, best, centroid in want] == [tuple(got[k]) for k in range(len(want))]
    assert len(want) < 1000 and max(len(ids) for ids, *_ in want) > 5


def test_greedy_on_odd_entries(spark):
    rows = [("w", 1, None, None, None, None, None, None, None), ("w", 2, "", [], 0, 50.0, "k", "", "a"), ("w", 3, "Some title", ["some", "title"], 9, 50.0, "k", "g", "b"), ("w", 4, "Some title", ["some", "title"], 9, 500.0, "", None, "b"), ("v", 5, "x", ["x"], 1, -3.0, None, None, None)]
    df = spark.createDataFrame(rows, "window string, id long, title string, tokens array<string>, n_text int, score double, explicit_key string, duplicate_group string, source string")
    got = {r.id: r for r in clustering.greedy(df).collect()}
    assert got[2].cluster == got[3].cluster and got[3].event_key == "k" and got[3].reasons == "explicit_event_key,article_duplicate_signal,independent_sources" and got[3].band == "strong" and got[5].band == "explicit_or_single"
    assert got[1].topic == clustering.UNTITLED and got[4].cluster == 0 and got[5].reasons == "single_report_candidate"
    assert {r.id for r in clustering.greedy(df, excluded=["k"]).collect()} == {1, 5}
    assert {r.id for r in clustering.greedy(df, limit=1).collect()} == {4, 5} and clustering.greedy(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        topic = rng.randrange(6)
        title = f"{('Acme', 'Globex', 'Initech')[topic % 3]} {('launches', 'sues', 'acquires')[topic % 3]} {('rocket engine', 'harbour plan')[topic // 3]} v{1 + topic % 2}.{rng.choice((0, 0, 0, 1))} " + " ".join(rng.sample("today news big small deal market wins".split(), 2))
        rows.append((i, f"b{i % 4}", title, f"s{i % 7}", rng.choice(["official", "wire", "original", "commentary", "aggregator"]), f"g{i % 9}" if i % 5 == 0 else None, i * 3600))
    df = spark.createDataFrame(rows, "id long, block string, title string, origin string, role string, duplicate_group string, secs long")
    from strandline.functions import signatures

    return df.select("id", "block", "origin", "role", "duplicate_group", F.timestamp_seconds("secs").alias("publish_time"), rules.tokens(F.col("title")).alias("tokens"), *signatures.columns(F.col("title"), F.lit("")))


def test_three_batches_of_a_stream_equal_one_batch(spark, items, tmp_path):
    """Also with an item that comes again: it is told its event and nothing changes."""
    whole = assignment.prepared(items)
    want = sorted(tuple(r) for r in assignment.assigned(whole).collect())
    assert {r[3] for r in want} >= {"attach", "new"} and max(r[11] for r in want) > 3
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([], whole.schema).write.parquet(str(source))
    stream = assignment.assigned(spark.readStream.schema(whole.schema).parquet(str(source)))
    for low, high in ((0, 80), (80, 160), (160, 240)):
        whole.where((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(str(source))
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(out)).collect()) == want
    whole.where("id < 20").coalesce(1).write.mode("append").parquet(str(source))
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    again = [r for r in spark.read.parquet(str(out)).collect() if r.decision == "idempotent"]
    events = {r[1]: r[2] for r in want}
    assert len(again) == 20 and all(r.event_id == events[r.id] for r in again)


def test_assignment_decisions():
    base = {"tokens": ["acme", "rocket"], "entities": ["acme"], "identifiers": [], "versions": ["2.4"], "dates": [], "action": "launch", "polarity": "positive", "modality": "reported", "place": "", "role": "original", "origin": "s1", "weight": 1.0, "importance": 60.0, "duplicate_group": "", "alias": "", "time": 10.0}
    state = assignment.empty()
    take = lambda i, **other: assignment.take(state, {**base, "id": i, **other})
    first, same, other = take(1), take(2, origin="s2"), take(3, versions=["3.0"])
    assert (first[2], same[2], other[2]) == ("new", "attach", "new") and first[1] == same[1] != other[1] and "different_version" in other[7]
    assert same[9] == "need_to_know" and same[8] == 1 and same[10] == 2
    assert take(4, role="commentary")[2] == "review_new" and take(2)[2] == "idempotent"
    changed = take(5, modality="confirmed")
    assert (changed[2], changed[3], changed[8]) == ("attach", "event_update", 2)
    assert take(6, entities=["else"], versions=[], action="", tokens=["other"])[2:4] == ("new", "same_event")


def test_headlines_meet_events_of_other_days_and_first_entities(spark, tmp_path):
    text = "Harbour plan of Acme approved by the council after long debate"
    rows = [(12, text, "src2"), (12 + 1440, text, "src6"), (13 + 2880, text, "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r for r in registry.QUERIES["online_assignments"](spark, str(tmp_path)).collect()}
    assert got[1452].decision == "attach" and got[1452].event_id == got[12].event_id and got[2893].candidates == 1
    whole = [r.asDict() for r in eventing.items(spark, SF).orderBy("time", "id").collect()]
    state, views = assignment.empty(), {}
    want = sorted(assignment.take(state, i, views) for i in whole)
    assert sorted(tuple(r)[1:] for r in registry.QUERIES["online_assignments"](spark, SF).collect()) == want


def test_index_tells_what_comparing_with_every_event_tells(monkeypatch):
    monkeypatch.setattr(assignment, "OPEN_EVENTS", 21)
    monkeypatch.setattr(assignment, "CANDIDATES", 4)
    rng = random.Random(11)
    some = lambda x, n: rng.sample(x, rng.randrange(n + 1))
    state, plain, views, told = assignment.empty(), assignment.empty(), {}, []
    index = assignment.Index(state, views)
    for i in range(900):
        item = {"id": i if rng.random() < 0.95 else rng.randrange(i + 1), "time": i * 0.4, "tokens": some("abcdefghijkl", 6), "entities": some(["x", "y", "z", "w"], 4), "identifiers": some(["A1", "a1", "B2"], 1), "versions": some(["1.0", "2.0"], 1), "dates": [], "action": rng.choice(["", "launch", "sue"])}
        item |= {"polarity": rng.choice(["positive", "negative", "neutral"]), "modality": rng.choice(["reported", "confirmed"]), "place": rng.choice(["", "", "oslo", "rome"]), "role": rng.choice(["wire", "commentary", "original"]), "origin": f"s{i % 3}", "weight": 1.0, "importance": 30.0, "duplicate_group": rng.choice(["", "", "g", "h"]), "alias": rng.choice(["", "", "", "p"])}
        told.append(assignment.take(state, item, views, index))
        assert told[-1] == assignment.take(plain, item) and list(state["events"]) == list(plain["events"]), i
        if i % 50 == 0:
            for held in (state, plain):
                next(iter(held["events"].values()))["status"] = "closed"
            index.put(next(iter(state["events"].values())))
    assert state == plain and {t[2] for t in told} == {"new", "review_new", "attach", "idempotent"} and len(index.slots) == 21
    assert set(index.rows) == set().union(*index.terms) and not index.bits[index.unused].any()


def test_a_batch_tells_a_repeated_item_its_event(spark, items):
    whole = assignment.prepared(items)
    once, twice = ({tuple(r) for r in assignment.assigned(x).collect()} for x in (whole, whole.union(whole.where("id < 20"))))
    events = {r[1]: r[2] for r in once}
    again = [r for r in twice if r[3] == "idempotent"]
    assert once == {r for r in twice if r[3] != "idempotent"} and len(again) == 20 and all(r[2] == events[r[1]] for r in again)


def plain_pairs(events):
    blocks, seen, out = {}, set(), []
    for e in sorted(events, key=lambda e: e.event_id):
        if e.status in rebalance.OPEN:
            for k in e["keys"]:
                if len(blocks.setdefault(k, [])) < 50:
                    blocks[k].append(e)
    for k in sorted(blocks):
        for i, a in enumerate(blocks[k]):
            for b in blocks[k][i + 1 :]:
                if (a.event_id, b.event_id) not in seen:
                    seen.add((a.event_id, b.event_id))
                    x, y, common = set(a.tokens), set(b.tokens), sorted(set(a["keys"]) & set(b["keys"]))
                    lex = len(x & y) / len(x | y) if x and y else 0.0
                    out.append((k, a.event_id, b.event_id, round(0.55 * lex + 0.3 * min(1.0, len(common) / 2) + 0.15 * any(c.startswith("id:") for c in common), 4)))
    return out


def test_rebalance_in_parts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["active", "active", "cooling", "closed"]), sorted(rng.sample(range(30), rng.randint(0, 6))), sorted({f"entity:{rng.randrange(5)}", f"id:version:{rng.randrange(40)}"} if i % 9 else [])) for i in range(140)]
    events = spark.createDataFrame([(i, s, [str(x) for x in t], k, 0.1, False) for i, s, t, k in rows], "event_id long, status string, tokens array<string>, keys array<string>, dispersion double, feedback boolean")
    want = plain_pairs(events.collect())
    shown = lambda df: [(r.block, r.left, r.right, r.score) for r in df.orderBy("block", "left", "right").collect()]
    assert shown(rebalance.run(events)) == want and len(want) > 500
    closed = {i for i, s, *_ in rows if s == "closed"}
    assert closed and not closed & {x for _, a, b, _ in want for x in (a, b)}
    half = rebalance.run(events, max_pairs=len(want) // 2).cache()
    rest = rebalance.run(events, cursor=rebalance.last_of(half))
    assert shown(half) + shown(rest) == want
    assert rebalance.last_of(rebalance.run(events.limit(0))) is None


def test_revert_undoes_every_kind_of_operation(spark):
    events = spark.createDataFrame([(e, "active") for e in "abcdef"], "event string, status string")
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("c", "4"), ("d", "5"), ("d", "6"), ("d", "7")], "event string, content string")
    ops = [
        (1, "merge", "a", ["b", "c", "b"], None, None), (2, "split", "d", None, [["5"], ["6", "7"]], None), (3, "close", "e", None, None, None), (4, "merge", "a", ["zz"], None, None), (5, "merge", "e", ["b"], None, None), (6, "split", "a", None, [["1"], ["2"]], None),
        (7, "merge", "f", ["f"], None, None), (8, "revert", "a", None, None, 1), (9, "revert", "d", None, None, 2), (10, "revert", "e", None, None, 3), (11, "revert", "a", None, None, 1), (12, "revert", "q", None, None, 999), (13, "odd", "f", None, None, None),
    ]
    log = spark.createDataFrame(ops, "op long, kind string, event string, others array<string>, groups array<array<string>>, target long")

    def state(upto):
        rows = oplog.replay(events, members, log, upto).collect()
        return {r.event: (r.status, r.redirect) for r in rows if r.what == "event"}, sorted((r.event, r.content) for r in rows if r.what == "member"), {r.op: r.outcome for r in rows if r.what == "operation"}

    first, held, _ = state(0)
    mid, moved, _ = state(3)
    assert mid["b"] == ("merged", "a") and mid["d"] == ("split", None) and mid["e"] == ("closed", None) and mid[oplog.part_id(2, 0)] == ("active", None)
    assert moved == sorted([("a", "1"), ("a", "2"), ("a", "3"), ("a", "4"), (oplog.part_id(2, 0), "5"), (oplog.part_id(2, 1), "6"), (oplog.part_id(2, 1), "7")])
    last, back, told = state(None)
    assert {e: s for e, s in last.items() if e in first} == first and back == held
    assert told == {1: "done", 2: "done", 3: "done", 4: "unknown_event", 5: "already_ended", 6: "no_partition", 7: "nothing_to_merge", 8: "done", 9: "done", 10: "done", 11: "nothing_to_revert", 12: "nothing_to_revert", 13: "unknown_kind"}
    after = oplog.replay(events, members, log, 3).where("what = 'event'")
    refs = {r.ref: (r.kind, r.event) for r in oplog.resolved(spark.createDataFrame([("b",), ("d",), ("f",), ("?",)], "ref string"), after).collect()}
    assert refs == {"b": ("redirect", "a"), "d": ("split", "d"), "f": ("canonical", "f"), "?": (None, None)}


FIELDS = ["source_id", "external_id", "url", "body", "title"]


def plain_upsert(table, rows):
    out = []
    for _, source, external, url, body, title, meta in rows:
        key = (source or "", ("id", external) if external else ("url", url or ""))
        new = {"source_id": source, "external_id": external, "url": url, "body": body, "title": title}
        if key not in table:
            table[key] = (new, meta)
            out.append("saved")
            continue
        old, known = table[key]
        kept = {k: v if v is not None else old[k] for k, v in new.items()}
        merged = known if meta is None else {**(known or {}), **meta}
        out.append("substantive_update" if kept["body"] != old["body"] else "non_substantive_update" if kept != old or merged != known else "unchanged")
        table[key] = (kept, merged)
    return out


def test_upserts_equal_a_sequential_model(spark, tmp_path):
    rng = random.Random(4)
    table, path = {}, str(tmp_path / "t")
    for _ in range(3):
        rows = [(i, rng.choice(["a", "b", None]), rng.choice(["1", "2", None, ""]), f"u{rng.randrange(3)}", rng.choice(["x", "y", None]), rng.choice(["t", None]), rng.choice([{"k": "1"}, {"j": "2"}, None])) for i in range(25)]
        df = spark.createDataFrame(rows, "id long, source_id string, external_id string, url string, body string, title string, metadata map<string,string>")
        got = [r.outcome for r in sinks.upsert(path, df, sinks.identity(), FIELDS, ["body"], "metadata", buckets=4).orderBy("at").collect()]
        assert got == plain_upsert(table, rows)
        kept = {(r.identity, r.body, r.title, tuple(sorted((r.metadata or {}).items()))) for r in sinks.stored(spark, path).collect()}
        assert len(kept) == len(table) and {k[1:] for k in kept} == {(v["body"], v["title"], tuple(sorted((m or {}).items()))) for v, m in table.values()}
    before = sorted(map(str, sinks.stored(spark, path).collect()))
    assert {r.outcome for r in sinks.upsert(path, df.where("metadata is not null and id = 24 or id = 3"), sinks.identity(), FIELDS, ["body"], "metadata", buckets=4).collect()} <= {"unchanged", "non_substantive_update", "substantive_update"}
    assert sinks.upsert(path, df.limit(0), sinks.identity(), FIELDS, buckets=4, metadata="metadata").count() == 0
    assert len(sinks.stored(spark, path).collect()) == len(before)


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    """A digest is written from a stream; the same micro-batch run again, as after a failure, finds its rows unchanged."""
    path, source = str(tmp_path / "digests"), str(tmp_path / "in")
    rows = spark.createDataFrame([("2024-01-01", h, f"digest {h}", h) for h in range(8)], "digest_date string, hour int, title string, id long")
    rows.write.parquet(source)
    key = F.concat_ws("|", "digest_date", F.col("hour").cast("string"))
    write = sinks.upserting(path, key, ["digest_date", "hour", "title"], keep_old=False, buckets=3)
    for run in range(2):  # a lost checkpoint replays all
        q = spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted((r.hour, r.title) for r in sinks.stored(spark, path).collect()) == [(h, f"digest {h}") for h in range(8)]
    assert {r.outcome for r in sinks.upsert(path, rows, key, ["digest_date", "hour", "title"], keep_old=False, buckets=3).collect()} == {"unchanged"}
