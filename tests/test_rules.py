"""Rules, signatures, keywords, times, components and landed files on rows written by hand."""

import datetime

from pyspark.sql import functions as F

from strandline.functions import rules, signatures, times
from strandline.operators import graph, keywords, rows
from strandline.sources import landed


def dims(spark, title, summary=""):
    df = spark.createDataFrame([(title, summary)], "title string, summary string")
    head = rules.headline(F.col("title"), F.col("summary"))
    return df.select(head.alias("head"), *(c.alias(k) for k, c in rules.hits(F.lower("title"), head).items())).select(rules.salience(F.col("head")), rules.reach(), rules.cap_scope()).first()


def test_salience_reach_and_scope(spark):
    assert tuple(dims(spark, "Flood kills many: killed in several provinces")) == (9.0, 7.0, None)
    assert tuple(dims(spark, "多地洪水致3人死亡")) == (9.0, 9.0, None)
    assert dims(spark, "NATO summit opens")[0] == 10.0 and dims(spark, "natoms rise")[0] == 4.0
    assert dims(spark, "Best price on earbuds today")[2] == "commerce"
    assert dims(spark, "Firm files for IPO with 10% off")[2] is None
    assert dims(spark, "New keyboard review")[2] == "narrow"
    assert dims(spark, "Global outage")[1] == 9.0 and dims(spark, "county fair")[1] == 3.5 and dims(spark, "imf view")[1] == 6.5


def test_tokens_and_fingerprints(spark):
    df = spark.createDataFrame([("发布新模型 GPT x",), ("",), (None,), ("The very same title here",), ("the very  same title here!",)], "t string")
    got = [set(r[0]) for r in df.select(rules.tokens(F.col("t"))).collect()]
    assert got[0] == {"gpt", "发布", "布新", "新模", "模型", "发布新", "布新模", "新模型", "sem:launch", "sem:model"} and got[1] == got[2] == set()
    prints = [r[0] for r in df.select(rules.simhash(rules.title_features(F.col("t")))).collect()]
    assert prints[1] == prints[2] == "" and len(prints[3]) == 16 and prints[3] == prints[4]


def test_keyword_rules(spark):
    df = spark.createDataFrame([(1, "A NATO day", "x"), (2, "natox", "alliance y"), (3, "v1.2 out", "aaab")], "id long, title string, body string")
    table = [keywords.Rule(1, "NATO", "exact", "title", True), keywords.Rule(2, "nato", "contains", "title_content", False, ("alliance",)), keywords.Rule(3, r"v\d+", "regex"), keywords.Rule(4, "(a+)+b", "regex")]
    got = sorted(tuple(r) for r in keywords.hits(df, table).collect())
    assert got == [(1, 1, "title", "NATO"), (1, 2, "title", "nato"), (2, 2, "title", "nato"), (3, 3, "title", r"v\d+")]
    assert keywords.refusal(r"(a)\1") and keywords.refusal("a+*") and keywords.refusal("x" * 300) and keywords.refusal("(") and keywords.refusal("a+b") is None
    text = spark.createDataFrame([("one Two one",), ("none",), ("zzz",)], "t string")
    assert [r[0] for r in text.select(keywords.snippets(F.col("t"), "one", 2)).collect()] == [["one T...", "...o one"], ["none"], []]


def test_signatures(spark):
    df = spark.createDataFrame([("Acme launches v2.1-beta for $1,200 million on 2024年3月5日", "up 4.5% in Hong Kong")], "t string, s string")
    r = df.select(*signatures.columns(F.col("t"), F.col("s"))).first()
    assert (r.dates, r.versions, r.money, r.percents, r.action, r.place, r.language) == (["2024-03-05"], ["2.1-beta"], ["$ 1200 million"], ["4.5"], "launch", "hong-kong", "en")
    assert r.entities[:2] == ["acme", "launches"]
    size = spark.createDataFrame([(1, 0.0, "active"), (25, 0.5, "closed"), (3, 0.0, "cooling")], "n int, d double, s string")
    assert [x[0] for x in size.select(signatures.threshold(F.col("n"), F.col("d"), F.col("s"))).collect()] == [0.72, 0.95, 0.78]


def test_publish_times(spark):
    now = datetime.datetime(2024, 6, 1, 12)
    want = {
        "2026-07-02T01:02:03Z": "2026-07-02 01:02:03", "2026-07-02T01:02+08:00": "2026-07-01 17:02:00", "30 分钟前": "2024-06-01 11:30:00", "2天前": "2024-05-30 12:00:00", "发布 2026年02月10日 17:02": "2026-02-10 09:02:00",
        "2026/1/2": "2026-01-01 16:00:00", "Feb 12, 2026 6:54 PM EST": "2026-02-12 23:54:00", "May 2026": "2026-05-01 00:00:00", "2026-13-01": None, "no date": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.d for r in df.select("t", F.date_format(times.publish_time(F.col("t"), F.lit(now).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("d")).collect()}
    assert got == want


def test_components_and_ranks(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100)], "a long, b long")
    got = {r.node: r.component for r in graph.connected(pairs).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 100: 100}
    assert graph.connected(pairs.limit(0)).count() == 0
    data = spark.createDataFrame([("a", float(x * x % 97)) for x in range(500)] + [("b", 1.0), (None, 2.0), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95) for r in rows.nearest_ranks(data, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    values = sorted(float(x * x % 97) for x in range(500))
    assert got == {"a": (500, values[249], values[474]), "b": (1, 1.0, 1.0), None: (1, 2.0, 2.0)}


def test_landed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>http://a/1</link><pubDate>x</pubDate></item><item><title></title><link>http://a/2</link></item></channel></rss>")
    (tmp_path / "a.xml").write_text('<feed><entry><title>C</title><id>t:1</id><link href="http://c/1"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>')
    got = sorted((r.id, r.title, r.link) for r in landed.feed_items(spark, f"{tmp_path}/*.xml").collect())
    assert got == [("http://a/1", "A & B", "http://a/1"), ("t:1", "C", "http://c/1")]
    (tmp_path / "s.smap").write_text("<urlset><url><loc> http://a/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a/1</loc><lastmod>2024-02-01</lastmod></url></urlset>")
    assert [tuple(r) for r in landed.sitemap_urls(spark, f"{tmp_path}/s.smap").collect()] == [("http://a/1", "2024-02-01")]
    (tmp_path / "l.jsonl").write_text('# note\n\n{"id": "1", "label": "relevant"}\n{"id": "2", "label": "odd"}\n{bad\n')
    assert [r.outcome for r in landed.labelled_lines(spark, f"{tmp_path}/l.jsonl", ["relevant"]).collect()] == ["ok", "bad_label", "bad_json"]
