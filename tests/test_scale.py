"""Steps that grew faster than their input or fell on the other side of a tie on larger tables."""

import datetime
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import rules
from strandline.operators import bootstrap, rows
from strandline.plans import eventing, registry
from strandline.sources import sinks, views
from strandline.streaming import assignment


def test_recovery_times_reads_the_log_once(spark, tmp_path):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 97 == 0 else start + datetime.timedelta(seconds=rng.randrange(4000)), rng.randrange(4) + 50 * rng.randrange(2), rng.choice(["error", "error", "click", "view"]), 1.0, '{"k": 1}') for i in range(3000)]
    at = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(at)
    df = registry.QUERIES["recovery_times"](spark, str(tmp_path))
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    con = duckdb.connect()
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{at}/*.parquet'")
    want = sorted((r[0], r[1], r[2], pytest.approx(r[3])) for r in con.execute(registry.ORACLE["recovery_times"]).fetchall())
    assert sorted((r.source_id, r.recovered, r.failures, r.seconds) for r in df.collect()) == want


def test_bootstrap_in_blocks_draws_as_one_generator(spark):
    n, rounds = 300, 40
    values = [((i * 7919) % 101) / 7 for i in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(3)
    generator = random.Random(bootstrap.SEED)
    drawn = [[generator.randrange(n) for _ in range(n)] for _ in range(rounds)]
    placed = bootstrap.numbered(df.select("v", F.col("i").alias("o")))
    sums = {r["round"]: r.s for r in bootstrap.round_sums(placed, n, rounds, bootstrap.SEED, block=64).collect()}
    assert sums == {r: pytest.approx(sum(values[i] for i in at)) for r, at in enumerate(drawn)}
    assert "Window" not in bootstrap.interval(df, "v", "i", rounds=rounds, block=64)._jdf.queryExecution().toString()


def test_depth_rounds_halves_up_whatever_the_sum_of_doubles(spark):
    cases = [(p, d, k) for p in range(6) for d in range(28) for k in range(6)]
    df = spark.createDataFrame(cases, "p int, d int, k int").withColumn("t", F.concat(F.repeat(F.lit("7"), F.col("d")), F.repeat(F.lit("'"), F.col("k"))))
    got = {(r.p, r.d, r.k): r.x for r in df.select("p", "d", "k", rules.depth(F.col("p"), rules.facts(F.col("t")), F.lit("full"), F.lit("rss")).alias("x")).collect()}
    cents = {c: min(1000, min(400, 80 * c[0]) + min(400, 15 * c[1] + 40 * c[2]) + 100) for c in cases}
    assert got == {c: (n + 5) // 10 / 10 for c, n in cents.items()}


def test_plain_search_and_guards_equal_the_patterns(spark):
    rng, bits = random.Random(5), ["ipo", " ", "  ", "\n", "\n\n", "\t", "Fed.", "nato", "natos", "xnato", "series a", "<b>", "<", "&amp;", "&lt;b&gt;", "a" * 38, "b" * 41, "。", "地震", "!", "ipo?", " ", "'", "7"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(600))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low, t = F.lower("t"), F.col("t")
    terms = ("IPO", "series a", "地震")
    pairs = [(rules.has(low, terms), low.rlike(rules.any_of(terms))), (rules.names(low, ("nato", "fed.")), low.rlike(rules.any_entity(("nato", "fed."))))]
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), "<[^>]+>", ""), r"\s+", " ")
    for name, value in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "...")):
        plain = F.replace(plain, F.lit(name), F.lit(value))
    pairs.append((rules.clean(t), F.trim(plain)))
    parts = F.size(F.filter(F.split(t, r"(?<=[.!?。！？])\s+|\n{2,}"), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s+", " "))) >= 40))
    pairs.append((rules.paragraph_count(t), F.when(parts > 0, parts).when(F.length(t) >= 80, 1).otherwise(0)))
    got = df.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect()
    for r in got:
        for i in range(len(pairs)):
            assert r[f"p{i}"].a == r[f"p{i}"].b, (i, r.t)


def test_hits_hold_no_list_as_one_alternation(spark):
    plan = spark.range(1).select(*rules.hits(F.lit("x") + F.col("id"), F.col("id").cast("string")).values())._jdf.queryExecution().analyzed().toString()
    assert rules.any_of(("deal", "x")) == "deal|x" and "earbuds|" not in plan and "|earbuds" not in plan


def test_fingerprints_work_out_words_and_digests_once(spark):
    df = spark.createDataFrame([("The very same title here 你好",), ("a b",), ("x" * 99 + " yz",), (None,)], "t string").repartition(1)
    out = df.select("t", rules.simhash(rules.title_features(F.col("t"))).alias("fp"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("sha1(") == 1

    def plain(t):
        words = re.findall(r"\w+", (t or "").lower())
        if len(" ".join(words)) < 12 or len(words) < 2:
            return ""
        compact = "".join(words)
        marks = [(int(hashlib.sha1(f.encode()).hexdigest()[:16], 16), min(len(f), 8)) for f in [*words, *(compact[i : i + 3] for i in range(len(compact) - 2))]]
        return f"{sum(1 << b for b in range(64) if sum(w if h >> b & 1 else -w for h, w in marks) >= 0):016x}"

    assert all(r.fp == plain(r.t) for r in out.collect())


def test_grounding_lowers_a_text_once(spark):
    plan = registry.QUERIES["title_grounding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2 and "substring(lower(" not in plan


def test_identity_matches_tells_each_pair_once_without_a_shuffle_of_pairs(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([None, "", "a", "b", "c"]), rng.choice([None, "a", "x", "y"])) for i in range(200)]
    df = spark.createDataFrame(data, "id long, t string, s string").repartition(3)
    out = rows.identity_matches(df, df, ["t", "s"]).where("left_id < right_id")
    same = lambda a, b: a is not None and a == b
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and (same(a[1], b[1]) or same(a[2], b[2])))
    assert sorted(map(tuple, out.collect())) == want
    top = out._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(left_id" not in top and "HashAggregate(keys=[left_id" not in top


@pytest.mark.parametrize(("block", "run"), [(1, 1), (3, 2), (7, 256), (4096, 256)])
def test_identity_pairs_tell_each_pair_once_in_blocks(spark, block, run):
    rng = random.Random(8)
    data = [(i if i % 41 else None, rng.choice([None, "", "a", "b", "c"]), rng.choice([None, "a", "x", "y"]), rng.choice([None, *"pqrstuvw"])) for i in range(1, 200)]
    df = spark.createDataFrame(data, "id long, t string, s string, u string").repartition(3)
    same = lambda a, b: any(x is not None and x == y for x, y in zip(a[1:], b[1:], strict=True))
    rest = [r for r in data if r[0] is not None]
    assert sorted(map(tuple, rows.identity_pairs(df, ["t", "s", "u"], block=block, run=run).collect())) == sorted((a[0], b[0]) for a in rest for b in rest if a[0] < b[0] and same(a, b))


def test_identity_links_are_kept_small_and_carry_no_titles(spark, tmp_path):
    n = 1500
    texts = [(i * 37, f"A title of more than thirty characters, the same for all\n{i}") for i in range(n)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumns({"source": F.lit("src1"), "lang": F.lit("en")}).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["identity_links"](spark, str(tmp_path))
    df.write.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert df.count() == n * (n - 1) // 2 and size < 0.4 * df.count()
    assert not re.search(r"Exchange hashpartitioning\(kind", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("block", [1, 3, 100])
def test_dealt_joins_large_keys_in_blocks(spark, block):
    a = spark.createDataFrame([(i, i % 4) for i in range(40)], "i long, k long").repartition(3)
    b = a.select(F.col("i").alias("j"), F.col("k"))
    assert sorted(map(tuple, rows.dealt(a, b, ["k"], block).select("i", "j").collect())) == sorted((i, j) for i in range(40) for j in range(40) if i % 4 == j % 4)


def test_title_pairs_are_neither_gathered_nor_made_distinct(spark):
    plan = registry.QUERIES["title_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[id#\d+L?, id_b#", plan) and not re.search(r"hashpartitioning\((id|id_b)#\d+L?, \d+\)", plan)


def test_upsert_stages_values_of_last_rows_by_bucket(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 5}", f"text {i}") for i in range(40)], "id long, k string, body string").repartition(3)
    path = str(tmp_path / "t")
    for outcomes in ({"saved": 5, "updated": 35}, {"updated": 40}):
        found = sinks.upsert(path, df, F.col("k"), ["k", "body"], buckets=3)
        files = found.inputFiles()
        assert files and all("/_bucket=" in f and ".zstd." in f for f in files)
        staged = spark.read.parquet(*files)
        assert staged.where("body is not null").count() == staged.where("_final").count() == 5
        counted = {r[0]: r[1] for r in found.groupBy(F.when(F.col("outcome") == "saved", "saved").otherwise("updated")).count().collect()}
        assert counted == outcomes
        assert sorted(r.body for r in sinks.stored(spark, path).collect()) == [f"text {i}" for i in range(35, 40)]


def test_assignment_keeps_sets_of_open_events(spark):
    rng = random.Random(2)
    base = {"identifiers": [], "versions": [], "dates": [], "action": "", "polarity": "neutral", "modality": "reported", "place": "", "role": "wire", "weight": 1.0, "importance": 0.0, "alias": ""}
    items = [{**base, "id": i, "time": i / 24, "tokens": rng.sample("abcdefghij", 4), "entities": rng.sample(["x", "y", "z"], 2), "versions": rng.choice([[], ["V1"], ["v2"]]), "origin": f"s{i % 3}", "duplicate_group": rng.choice(["", "g"])} for i in range(80)]
    kept, plain, views = assignment.empty(), assignment.empty(), {}
    told = [assignment.take(kept, i, views) for i in [*items, items[0]]]
    assert told == [assignment.take(plain, i) for i in [*items, items[0]]] and kept == plain
    assert set(views) == set(kept["events"]) and {t[2] for t in told} >= {"attach", "new", "idempotent"}
    for k, e in kept["events"].items():
        assert views[k] == {**assignment.view(e["signature"], e["tokens"]), "members": [set(m["tokens"]) for m in e["members"]]}


def test_headlines_take_the_standing_of_a_source_without_a_join(spark, tmp_path):
    rows = [(1, "a\nb", "src4"), (2, "b", "src9"), (3, "c", "src14"), (4, None, None), (5, "d", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    h = views.headlines(spark, str(tmp_path))
    joined = h.drop("stars", "kind", "enabled").join(views.sources(spark, str(tmp_path)).withColumnRenamed("authority", "kind"), "source_id", "left").select(h.columns)
    key = lambda r: r.id
    assert sorted(h.collect(), key=key) == sorted(joined.collect(), key=key) and len(h.columns) == len(set(h.columns))
    assert "Join" not in h._jdf.queryExecution().optimizedPlan().toString()


def test_arrivals_are_not_shuffled_and_tokens_fold_a_text_once(spark):
    rows, events = eventing.arrivals(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2 and events.count() > 0
    df = spark.createDataFrame([("The  ABC 地震多地死亡 x1",), (None,), ("地",)], "t string").repartition(1).select(rules.tokens(F.col("t")).alias("k"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [sorted(r.k) for r in df.collect()] == [sorted(["the", "abc", "x1", "地震", "震多", "多地", "地死", "死亡", "地震多", "震多地", "多地死", "地死亡"]), [], []]


def test_greedy_clusters_equal_their_sql_on_entries_without_titles_or_tokens(spark, tmp_path):
    texts = {10: None, 22: "", 34: "\nSecond line only with words", 46: "!!! ---", 58: "Ünï é", 11: "plain words here", 40: None, 1210: "", 1222: "я не"}
    rows = [(i, t, "src4" if i % 4 else None, "en") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["greedy_clusters"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(registry.ORACLE["greedy_clusters"])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, cur.fetchall())) and df.count() == len(rows)
