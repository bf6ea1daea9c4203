"""Registered queries of evaluation, components, publish times and landed feeds, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import rules, times
from strandline.functions.scores import jaccard
from strandline.operators import graph
from strandline.plans.catalog import query
from strandline.plans.rules import _TOKENS
from strandline.sources.views import CONTENTS, HEADLINES, contents, headlines, table

_JUDGED = "j AS (SELECT d.doc_id AS id, quality AS gain, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def judged(spark, sf) -> DataFrame:
    """Labelled documents with a score that follows from the id."""
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality is not null"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.col("quality").alias("gain"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("score"))


@query(
    f"""WITH {_JUDGED}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM j QUALIFY place <= 20), ideal AS (SELECT gain, row_number() OVER (ORDER BY gain DESC, id) AS place FROM j QUALIFY place <= 20)
 SELECT round(coalesce((SELECT sum((2 ** gain - 1) / log2(place + 1)) FROM top) / nullif((SELECT sum((2 ** gain - 1) / log2(place + 1)) FROM ideal), 0), 0)::DOUBLE, 6) AS ndcg, round(coalesce((SELECT 1.0 / min(place) FROM top WHERE gain > 0), 0)::DOUBLE, 6) AS mrr,
 round(coalesce((SELECT count(*) FROM top WHERE gain > 0)::DOUBLE / nullif((SELECT count(*) FROM j WHERE gain > 0), 0), 0), 6) AS recall"""
)
def ranking_quality(spark, sf):
    """NDCG, mean reciprocal rank and recall of the first 20; the lists are limited before they are numbered."""
    j = judged(spark, sf)

    def listed(order):
        return j.orderBy(*order).limit(20).withColumn("at", F.row_number().over(Window.orderBy(*order)))

    dcg = F.sum((F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("at") + 1.0))
    top, ideal = listed([F.desc("score"), "id"]), listed([F.desc("gain"), "id"])
    found = top.agg(dcg.alias("dcg"), F.min(F.when(F.col("gain") > 0, F.col("at"))).alias("first"), F.count_if(F.col("gain") > 0).alias("hits"))
    best, all_ = ideal.agg(dcg).scalar(), j.agg(F.count_if(F.col("gain") > 0)).scalar()
    return found.select(
        F.round(F.coalesce(F.col("dcg") / F.nullif(best, F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("hits") / F.nullif(all_, F.lit(0)), F.lit(0.0)), 6).alias("recall"),
    )


@query(
    f"""WITH {_JUDGED}, b AS (SELECT least(9, floor(score * 10))::INT AS bin, count(*) AS n, avg(score) AS mean, avg(gain) AS observed, sum((score - gain) ** 2) AS err FROM j GROUP BY 1)
 SELECT bin, n, round(mean, 6) AS mean_probability, round(observed, 6) AS observed_rate, round((SELECT sum(err) / sum(n) FROM b), 6) AS brier, round((SELECT sum(n * abs(mean - observed)) / sum(n) FROM b), 6) AS ece FROM b"""
)
def calibration(spark, sf):
    """Reliability by tenths of the probability, Brier score and expected calibration error."""
    b = judged(spark, sf).groupBy(F.least(F.lit(9), F.floor(F.col("score") * 10)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg("gain").alias("observed"), F.sum(F.pow(F.col("score") - F.col("gain"), 2)).alias("err")
    )
    every = b.agg((F.sum("err") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("mean") - F.col("observed"))) / F.sum("n")).alias("ece"))
    return b.select("bin", "n", F.round("mean", 6).alias("mean_probability"), F.round("observed", 6).alias("observed_rate"), F.round(every.select("brier").scalar(), 6).alias("brier"), F.round(every.select("ece").scalar(), 6).alias("ece"))


@query(
    """WITH c AS (SELECT source AS truth, 'src' || doc_id % 23 AS guess, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2), t AS (SELECT truth, sum(n) AS size FROM c GROUP BY 1), g AS (SELECT guess, sum(n) AS size FROM c GROUP BY 1),
 m AS (SELECT sum(n * n::DOUBLE / g.size) / sum(n) AS p, sum(n * n::DOUBLE / t.size) / sum(n) AS r, sum(CASE WHEN c.truth <> c.guess THEN n ELSE 0 END) / sum(n)::DOUBLE AS churn FROM c JOIN t USING (truth) JOIN g USING (guess))
 SELECT round(p, 6) AS b_cubed_precision, round(r, 6) AS b_cubed_recall, round(2 * p * r / (p + r), 6) AS b_cubed_f1, round(churn, 6) AS id_churn FROM m"""
)
def cluster_quality(spark, sf):
    """B-cubed precision, recall and F1, and the churn of ids, from the counts of the cells of truth and guess, so that no cluster is collected."""
    d = table(spark, sf, "documents").where("source is not null").groupBy(F.col("source").alias("truth"), F.concat(F.lit("src"), F.col("doc_id") % 23).alias("guess")).agg(F.count("*").alias("n"))
    cells = d.join(d.groupBy("truth").agg(F.sum("n").alias("of_truth")), "truth").join(d.groupBy("guess").agg(F.sum("n").alias("of_guess")), "guess")
    share = lambda size: F.sum(F.col("n") * F.col("n") / F.col(size)) / F.sum("n")
    m = cells.agg(share("of_guess").alias("p"), share("of_truth").alias("r"), (F.sum(F.when(F.col("truth") != F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("churn"))
    return m.select(F.round("p", 6).alias("b_cubed_precision"), F.round("r", 6).alias("b_cubed_recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 6).alias("b_cubed_f1"), F.round("churn", 6).alias("id_churn"))


@query(
    f"""WITH {HEADLINES}, {_TOKENS}, p AS (SELECT a.id % 2 = 0 AS truth, len(list_intersect(a.tokens, b.tokens)) / greatest(1, len(list_distinct(a.tokens || b.tokens)))::DOUBLE >= 0.28 AS guess FROM tn a JOIN tn b ON b.id = a.id + 12)
 SELECT count(*) AS pairs, count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE NOT truth AND guess) AS fp, count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn, count(*) FILTER (WHERE truth AND NOT guess) AS fn,
 round(coalesce(count(*) FILTER (WHERE truth AND guess) / nullif(count(*) FILTER (WHERE guess), 0)::DOUBLE, 0), 4) AS precision, round(coalesce(count(*) FILTER (WHERE truth AND guess) / nullif(count(*) FILTER (WHERE truth), 0)::DOUBLE, 0), 4) AS recall,
 round(coalesce(count(*) FILTER (WHERE truth = guess) / nullif(count(*), 0)::DOUBLE, 0), 4) AS accuracy FROM p"""
)
def pairwise_events(spark, sf):
    """Judged pairs of headlines against the decision by token similarity."""
    h = headlines(spark, sf).select("id", rules.tokens(F.col("title")).alias("t"))
    other = h.select((F.col("id") - 12).alias("id"), F.col("t").alias("u"))
    p = h.join(other, "id").select((F.col("id") % 2 == 0).alias("truth"), (jaccard(F.col("t"), F.col("u")) >= 0.28).alias("guess"))
    t, g = F.col("truth"), F.col("guess")
    n = p.agg(F.count("*").alias("pairs"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(~t & ~g).alias("tn"), F.count_if(t & ~g).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    tp = F.col("tp")
    return n.select("*", ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"), ratio(tp + F.col("tn"), F.col("pairs")).alias("accuracy"))


_RECORDS = f"""{HEADLINES}, r AS (SELECT h.*, quality, CASE WHEN publish_time IS NOT NULL THEN greatest(0, date_diff('minute', publish_time, fetched_at)) END AS lag FROM h LEFT JOIN labels ON labels.doc_id = h.id),
 top AS (SELECT * FROM r ORDER BY id * 37 % 101 DESC, CAST(id AS VARCHAR) DESC LIMIT 20)"""


@query(
    f"""WITH {_RECORDS} SELECT count(*) AS total, round((SELECT count(*) FILTER (WHERE quality = 1) / greatest(1, count(*))::DOUBLE FROM top), 4) AS precision_20, round((count(*) FILTER (WHERE title <> '') - count(DISTINCT nullif(title, ''))) / count(*)::DOUBLE, 4) AS duplicate_rate,
 quantile_disc(lag, 0.5)::BIGINT AS lag_p50, quantile_disc(lag, 0.9)::BIGINT AS lag_p90, round(count(*) FILTER (WHERE length(trim(body)) >= 280) / count(*)::DOUBLE, 4) AS fulltext_rate, round(count(*) FILTER (WHERE coalesce(trim(body), '') = '') / count(*)::DOUBLE, 4) AS title_only_rate,
 (SELECT count(DISTINCT source_id) FROM top) AS diversity_20, round((SELECT count(DISTINCT source_id) FROM top) / nullif(count(DISTINCT source_id), 0)::DOUBLE, 4) AS coverage_20, count(DISTINCT source_id) AS sources FROM r"""
)
def offline_metrics(spark, sf):
    """Precision of the first 20, rate of copies, freshness by nearest rank, completeness and spread over sources.

    Lags are counted by value first, so that ranks are found in a table of different lags.
    """
    r = headlines(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
    top = r.orderBy(F.desc(F.col("id") * 37 % 101), F.desc(F.col("id").cast("string"))).limit(20).agg(F.count_if(F.col("quality") == 1).alias("hits"), F.greatest(F.lit(1), F.count("*")).alias("n"), F.count_distinct("source_id").alias("spread"))
    lag = F.greatest(F.lit(0), F.timestamp_diff("MINUTE", F.col("publish_time"), F.col("fetched_at")))
    counted = r.where("publish_time is not null").groupBy(lag.alias("lag")).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("upto", F.sum("n").over(Window.orderBy("lag"))).withColumn("all", F.sum("n").over(Window.partitionBy()))

    def rank(p: float):
        return ranked.where(F.col("upto") >= F.ceil(F.lit(p) * F.col("all"))).agg(F.min("lag").cast("long")).scalar()

    share = lambda c: F.round(F.count_if(F.coalesce(c, F.lit(False))) / F.count("*"), 4)
    named = F.nullif(F.col("title"), F.lit(""))
    hits, n, spread = (top.select(c).scalar() for c in ("hits", "n", "spread"))
    return r.agg(
        F.count("*").alias("total"), F.round((F.count(named) - F.count_distinct(named)) / F.count("*"), 4).alias("duplicate_rate"), share(F.length(F.trim("body")) >= 280).alias("fulltext_rate"),
        share(F.coalesce(F.trim("body"), F.lit("")) == "").alias("title_only_rate"), F.count_distinct("source_id").alias("sources"),
    ).select("*", F.round(hits / n, 4).alias("precision_20"), rank(0.5).alias("lag_p50"), rank(0.9).alias("lag_p90"), spread.alias("diversity_20"), F.round(spread / F.nullif(F.col("sources"), F.lit(0)), 4).alias("coverage_20"))


@query(
    f"""WITH RECURSIVE {CONTENTS}, e AS (SELECT id AS a, id + 17 AS b FROM c WHERE id % 3 = 0 UNION SELECT min(id) OVER (PARTITION BY title) AS a, id AS b FROM c WHERE title <> ''), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 w(node, r) AS (SELECT a, a FROM u UNION SELECT b, b FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.r WHERE u.b < w.node OR true) SELECT node, min(r) AS component FROM w GROUP BY node"""
)
def linked_components(spark, sf):
    """Components of predicted pairs; equal titles are linked by their first item, so that copies are no pairs of all with all."""
    c = contents(spark, sf)
    firsts = c.where("title <> ''").groupBy("title").agg(F.min("id").alias("a"))
    pairs = c.where("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") + 17).alias("b")).union(c.join(firsts, "title").select("a", F.col("id").alias("b")))
    return graph.connected(pairs)


_STAMP = "make_timestamp(1704067200000000 + id * 3661 * 1000000)"


@query(
    f"""WITH {CONTENTS}, t AS (SELECT id, {_STAMP} AS s FROM c) SELECT id, strftime(CASE id % 8 WHEN 0 THEN s WHEN 1 THEN TIMESTAMP '2024-06-01 12:00:00' - to_hours((id % 50)::INT) WHEN 2 THEN date_trunc('minute', s) - INTERVAL 8 HOUR WHEN 3 THEN s - INTERVAL 8 HOUR
 WHEN 4 THEN date_trunc('day', s) - INTERVAL 8 HOUR WHEN 5 THEN date_trunc('minute', s) + INTERVAL 5 HOUR WHEN 6 THEN date_trunc('month', s) END, '%Y-%m-%d %H:%M:%S') AS published FROM t"""
)
def publish_times(spark, sf):
    """Times in seven written forms, and a text that is none, parsed to UTC."""
    s = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 3661).cast("decimal(18,6)"))
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", None, "yyyy年MM月dd日 HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MMM d, yyyy h:mm a 'EST'", "MMMM yyyy", None)
    text = F.when(F.col("id") % 8 == 1, F.concat((F.col("id") % 50).cast("string"), F.lit(" 小时前")))
    for k, form in enumerate(forms):
        if form:
            text = text.when(F.col("id") % 8 == k, F.date_format(s, form))
    found = times.publish_time(text.otherwise("no date"), F.lit("2024-06-01 12:00:00").cast("timestamp_ntz"))
    return contents(spark, sf).select("id", F.date_format(found, "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(f"""WITH {HEADLINES} SELECT id, CASE WHEN title <> '' THEN title END AS title, 'https://example.org/' || id AS link, 'guid-' || id AS guid, (id % 3 * 3600 + id % 60 * 60 + id % 7)::INT AS seconds FROM h""")
def feed_entries(spark, sf):
    """Entries of landed feed items (XML), with durations of H:MM:SS in seconds."""
    escape = F.col("title")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escape = F.replace(escape, F.lit(a), F.lit(b))
    length = F.format_string("%d:%02d:%02d", F.col("id") % 3, F.col("id") % 60, F.col("id") % 7)
    item = F.concat(F.lit("<item><title>"), escape, F.lit("</title><link>https://example.org/"), F.col("id"), F.lit("</link><guid>guid-"), F.col("id"), F.lit("</guid><duration>"), length, F.lit("</duration></item>"))
    parsed = headlines(spark, sf).select("id", F.from_xml(item, "title string, link string, guid string, duration string").alias("e"))
    parts = F.split("e.duration", ":")
    seconds = F.aggregate(parts, F.lit(0), lambda total, p: total * 60 + p.cast("int"))
    return parsed.select("id", F.trim("e.title").alias("title"), "e.link", "e.guid", seconds.alias("seconds"))
