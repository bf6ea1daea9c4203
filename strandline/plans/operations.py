"""Registered queries of ingest, upkeep, metrics and schedules, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import rows
from strandline.plans.catalog import AS_OF, query
from strandline.sources.views import CONTENTS, FETCH_LOG, SOURCES, contents, fetch_log, sources, table

# Lanes in the order in which they win ties, with their terms.
LANES = (("market", ("ent", "ing")), ("policy", ("der", "que")), ("science", ("tion", "ich")))


@query(
    """WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 0)
 SELECT CASE WHEN o.doc_id IS NULL THEN 'saved' WHEN n.doc_id IS NULL THEN 'kept' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1"""
)
def upsert_outcomes(spark, sf):
    """Every stored and arriving item as saved, updated, unchanged or kept, by one outer join on the identity."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.xxhash64("text").alias("was"), F.lit(1).alias("o"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 4 <> 0").select("doc_id", F.xxhash64(changed).alias("now"), F.lit(1).alias("n"))
    outcome = F.when(F.col("o").isNull(), "saved").when(F.col("n").isNull(), "kept").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    return old.join(new, "doc_id", "full").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {CONTENTS} SELECT id FROM c WHERE NOT coalesce(fetched_at < TIMESTAMP '2024-01-01 12:00:00' AND CASE WHEN id % 13 <> 0 THEN favorited END = false AND archived = false, false)")
def retention_survivors(spark, sf):
    """Items that retention keeps; an unknown flag keeps an item."""
    known = F.when(F.col("id") % 13 != 0, F.col("favorited"))
    gone = (F.col("fetched_at") < F.lit("2024-01-01 12:00:00").cast("timestamp")) & (known == F.lit(False)) & ~F.col("archived")
    return contents(spark, sf).where(~F.coalesce(gone, F.lit(False))).select("id")


@query(f"WITH {FETCH_LOG}, m AS (SELECT max(attempted_at) AS t FROM l) SELECT source_id, CASE WHEN count(*) FILTER (WHERE outcome = 'failure' AND attempted_at > t - INTERVAL 24 HOUR) = 0 THEN 0 ELSE count(*) FILTER (WHERE outcome = 'failure') END AS errors FROM l, m GROUP BY 1")
def error_resets(spark, sf):
    """Error counts, reset for sources without a failure in the last day."""
    log = fetch_log(spark, sf)
    bad, last = F.col("outcome") == "failure", log.agg(F.max("attempted_at")).scalar()
    recent = F.count_if(bad & (F.col("attempted_at") > last - F.expr("interval 24 hours")))
    return log.groupBy("source_id").agg(F.when(recent == 0, 0).otherwise(F.count_if(bad)).alias("errors"))


@query(f"WITH {CONTENTS} SELECT id, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS turn FROM c WHERE source_id IS NOT NULL ORDER BY turn, source_id LIMIT 60")
def interleaved_sources(spark, sf):
    """One item of each source in turn, newest first, 60 in all."""
    turn = rows.top_per_group(contents(spark, sf).where("source_id is not null"), ["source_id"], [F.desc("fetched_at"), F.desc("id")], 60, "turn")
    return turn.orderBy("turn", "source_id").limit(60).select("id", "turn")


@query(f"WITH {CONTENTS} SELECT DISTINCT source_id, content_type FROM c WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.id % 40 = 0 AND o.source_id = c.source_id AND o.content_type = c.content_type)")
def new_edges(spark, sf):
    """Edges that are not there yet, each once."""
    c = contents(spark, sf).where("source_id is not null")
    key = ["source_id", "content_type"]
    return c.select(*key).distinct().join(c.where("id % 40 = 0").select(*key), key, "left_anti")


@query(f"WITH {CONTENTS}, w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(title), '[^a-z]+')) AS term FROM c) SELECT term, count(*) AS df, min(id) AS first_id FROM w WHERE length(term) >= 3 GROUP BY 1")
def term_index(spark, sf):
    """Terms of titles with their document counts."""
    w = contents(spark, sf).select("id", F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z]+"))).alias("term")).where(F.length("term") >= 3)
    return w.groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("first_id"))


@query(f"WITH {CONTENTS} SELECT id FROM c WHERE list_has_all(regexp_split_to_array(lower(body), '[^a-z]+'), ['the', 'and', 'of'])")
def all_terms_match(spark, sf):
    """Items with all words of a search."""
    words = F.split(F.lower("body"), "[^a-z]+")
    return contents(spark, sf).where(F.forall(F.array(*map(F.lit, ("the", "and", "of"))), lambda t: F.array_contains(words, t))).select("id")


@query("SELECT page_id, n AS listing, 'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) || '/list?page=' || n AS listing_url FROM pages, (SELECT unnest([1, 2, 3]) AS n)")
def listing_urls(spark, sf):
    """Listing addresses from a page template."""
    p = table(spark, sf, "pages").select("page_id", text.host(F.col("url")).alias("h"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("listing"))
    return p.select("page_id", "listing", F.format_string("https://%s/list?page=%d", "h", "listing").alias("listing_url"))


@query("SELECT event_id, CAST(value AS INT) AS seconds FROM events")
def durations(spark, sf):
    """HH:MM:SS texts as seconds, by one fold over their parts."""
    s = F.floor("value").cast("int")
    s = F.when(F.col("value") - s > 0.5, s + 1).when((F.col("value") - s == 0.5) & (s % 2 == 1), s + 1).otherwise(s)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    e = table(spark, sf, "events").select("event_id", clock.alias("clock"))
    return e.select("event_id", F.aggregate(F.split("clock", ":"), F.lit(0), lambda a, x: a * 60 + x.cast("int")).alias("seconds"))


@query(f"WITH {CONTENTS}, m AS (SELECT source_id, max(fetched_at) AS t FROM c WHERE archived GROUP BY 1) SELECT id FROM c LEFT JOIN m USING (source_id) WHERE t IS NULL OR fetched_at > t")
def after_marker(spark, sf):
    """Items newer than their source's marker."""
    c = contents(spark, sf)
    marks = c.where("archived").groupBy("source_id").agg(F.max("fetched_at").alias("t"))
    return c.join(marks, "source_id", "left").where("t is null or fetched_at > t").select("id")


@query("WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|mobile|amp)[.]', '') AS host FROM pages) SELECT host, min(page_id) AS first_page FROM p GROUP BY 1 HAVING min(page_id) >= 20")
def imported_hosts(spark, sf):
    """Hosts of an import, each once, without those that are known (first twenty pages)."""
    p = table(spark, sf, "pages").select("page_id", text.bare_host(F.col("url")).alias("host"))
    fresh = p.where("page_id >= 20").groupBy("host").agg(F.min("page_id").alias("first_page"))
    return fresh.join(p.where("page_id < 20").select("host"), "host", "left_anti")


@query(f"WITH {CONTENTS}, k AS (SELECT title AS v FROM c WHERE archived AND title <> '' UNION SELECT sha1(body) FROM c WHERE archived) SELECT id FROM c WHERE NOT archived AND (title IN (SELECT v FROM k WHERE v IS NOT NULL) OR sha1(body) IN (SELECT v FROM k WHERE v IS NOT NULL))")
def known_items(spark, sf):
    """Items whose title or body is stored already, by a semi join over exploded keys."""
    c = contents(spark, sf).select("id", "archived", F.explode(F.array("title", F.sha1("body"))).alias("v")).where("v <> ''")
    return c.where("not archived").join(c.where("archived").select("v"), "v", "left_semi").select("id").distinct()


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) // 10 AS decade, count(*) AS n, count(json_extract_string(props, '$.missing')) AS present FROM events GROUP BY 1")
def json_fields(spark, sf):
    """Values at JSON paths, and whether a path is there."""
    e = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("m"))
    return e.groupBy(F.floor(F.col("k") / 10).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.count("m").alias("present"))


@query(f"WITH {CONTENTS} SELECT CASE content_type WHEN 'x' THEN 'posts' WHEN 'youtube' THEN 'videos' WHEN 'rss' THEN 'feeds' ELSE 'websites' END AS category, count(*) AS n, list_sort(list(id)) AS ids FROM c WHERE fetched_at::DATE = DATE '2024-01-01' GROUP BY 1")
def digest_categories(spark, sf):
    """Items of a day's digest by category, with a default; a day bounds the lists."""
    names = F.create_map(*map(F.lit, ("x", "posts", "youtube", "videos", "rss", "feeds")))
    c = contents(spark, sf).where(F.to_date("fetched_at") == F.lit("2024-01-01").cast("date"))
    return c.groupBy(F.coalesce(F.try_element_at(names, "content_type"), F.lit("websites")).alias("category")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


@query(f"WITH {CONTENTS} SELECT a.id, min(b.id) AS other_id FROM c a JOIN c b ON a.title = b.title AND a.content_type = b.content_type AND a.source_id <> b.source_id GROUP BY 1")
def cross_source_matches(spark, sf):
    """The first item of another source with the same title and type, from two minima a group instead of a self join."""
    c = contents(spark, sf).where("title is not null and source_id is not null").select("id", "title", "content_type", "source_id")
    firsts = c.groupBy("title", "content_type", "source_id").agg(F.min("id").alias("first"))
    two = firsts.groupBy("title", "content_type").agg(F.min_by("source_id", "first").alias("lead"), F.min("first").alias("first"))
    others = firsts.join(two.select("title", "content_type", "lead"), ["title", "content_type"]).where("source_id <> lead").groupBy("title", "content_type").agg(F.min("first").alias("second"))
    both = two.select("title", "content_type", "lead", "first").join(others, ["title", "content_type"])
    return c.join(both, ["title", "content_type"]).select("id", F.when(F.col("source_id") == F.col("lead"), F.col("second")).otherwise(F.col("first")).alias("other_id"))


@query("WITH m AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) SELECT c.conv_id, c.turn, c.role, length(c.text) AS n FROM conversations c JOIN m USING (conv_id, turn)")
def newest_versions(spark, sf):
    """Rows joined to the newest version of their key."""
    c = table(spark, sf, "conversations")
    newest = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return c.join(newest, ["conv_id", "turn"]).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query(f"WITH RECURSIVE {CONTENTS}, e AS (SELECT id AS child, id // 2 AS parent FROM c WHERE id > 0), r(id, ancestor, hops) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT r.id, e.parent, hops + 1 FROM r JOIN e ON e.child = r.ancestor WHERE hops < 3) SELECT id, ancestor, hops FROM r")
def lineage_ancestors(spark, sf):
    """What an item derives from, up to three hops."""
    e = contents(spark, sf).where("id > 0").select(F.col("id").alias("child"), F.floor(F.col("id") / 2).alias("parent"))
    step = e.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    out = step
    for _ in range(2):
        step = step.join(e, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor"), (F.col("hops") + 1).alias("hops"))
        out = out.unionByName(step)
    return out


@query(
    """WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-09', INTERVAL 1 DAY))::DATE AS day), n AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
 SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day)"""
)
def days_with_gaps(spark, sf):
    """Counts of every day of a range, also of days without rows: the daily counts of a weekly summary alone."""
    days = spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-09', interval 1 day)")).alias("day"))
    n = table(spark, sf, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM d")
def metric_deltas(spark, sf):
    """A metric's change from run to run; windows run over the daily counts."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day")))


@query("SELECT ts::DATE AS day, count(*) AS n, max(value) AS peak, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1 HAVING ts::DATE >= (SELECT max(ts)::DATE - 7 FROM events)")
def daily_fold(spark, sf):
    """Hourly partial states folded into days, of which the last seven stay."""
    e = table(spark, sf, "events")
    hours = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.max("value").alias("peak"), F.count_if(F.col("event_type") == "error").alias("errors"))
    days = hours.groupBy(F.to_date("hour").alias("day")).agg(F.sum("n").alias("n"), F.max("peak").alias("peak"), F.sum("errors").cast("long").alias("errors"))
    return days.where(F.col("day") >= F.date_sub(e.agg(F.to_date(F.max("ts"))).scalar(), 7))


@query(f"WITH {FETCH_LOG}, n AS (SELECT *, min(CASE WHEN outcome = 'success' THEN attempted_at END) OVER (PARTITION BY source_id ORDER BY attempted_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS up FROM l) SELECT source_id, count(up) AS recovered, count(*) AS failures, avg(date_diff('second', date_trunc('second', attempted_at), date_trunc('second', up))) AS seconds FROM n WHERE outcome = 'failure' GROUP BY 1")
def recovery_times(spark, sf):
    """Mean time from a failure to the next success; the log is read backwards, so that the earliest success so far is a running minimum."""
    w = Window.partitionBy("source_id").orderBy(F.desc_nulls_first("attempted_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    log = fetch_log(spark, sf).withColumn("up", F.min(F.when(F.col("outcome") == "success", F.col("attempted_at"))).over(w)).where("outcome = 'failure'")
    return log.groupBy("source_id").agg(F.count("up").alias("recovered"), F.count("*").alias("failures"), F.avg(F.unix_timestamp("up") - F.unix_timestamp("attempted_at")).alias("seconds"))


@query(f"WITH {CONTENTS}, {SOURCES}, g AS (SELECT title, authority, max(stars / 3.0) AS w FROM c JOIN s USING (source_id) GROUP BY ALL) SELECT title, sum(least(1.0, w)) AS independence, count(*) AS origins FROM g GROUP BY 1")
def source_independence(spark, sf):
    """An origin counts once, by its heaviest member."""
    c = contents(spark, sf).join(sources(spark, sf), "source_id").groupBy("title", "authority").agg(F.max(F.col("stars") / 3.0).alias("w"))
    return c.groupBy("title").agg(F.sum(F.least(F.lit(1.0), "w")).alias("independence"), F.count("*").alias("origins"))


@query(
    f"""WITH {CONTENTS}, f AS (SELECT doc_id, quality * 2 - 1 AS d FROM labels ORDER BY doc_id DESC LIMIT 240), j AS (SELECT d, source_id, content_type FROM f JOIN c ON id = doc_id)
 SELECT scope, key, greatest(-3.0, least(3.0, sum(w))) AS weight FROM (SELECT 'source' AS scope, source_id AS key, d * 1.0 AS w FROM j UNION ALL SELECT 'type', content_type, d * 0.35 FROM j) GROUP BY ALL"""
)
def preference_profile(spark, sf):
    """Weights of sources and types from the newest 240 judgments, within bounds."""
    f = table(spark, sf, "labels").orderBy(F.desc("doc_id")).limit(240).select(F.col("doc_id").alias("id"), (F.col("quality") * 2 - 1).alias("d"))
    j = contents(spark, sf).join(f, "id")
    scopes = F.array(F.struct(F.lit("source").alias("scope"), F.col("source_id").alias("key"), F.lit(1.0).alias("w")), F.struct(F.lit("type").alias("scope"), F.col("content_type").alias("key"), F.lit(0.35).alias("w")))
    x = j.select("d", F.explode(scopes).alias("x")).groupBy("x.scope", "x.key").agg(F.sum(F.col("d") * F.col("x.w")).alias("s"))
    return x.select("scope", "key", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), "s")).alias("weight"))


@query("SELECT lang, count(*) FILTER (WHERE quality = 1) AS up, count(*) FILTER (WHERE quality = 0) AS down, count(*) FILTER (WHERE quality = 1) / count(*) AS share FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def feedback_directions(spark, sf):
    """Judgments by language and direction, as a pivot."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    p = d.groupBy("lang").pivot("quality", [1, 0]).agg(F.count("doc_id"))
    up, down = F.coalesce("1", F.lit(0)), F.coalesce("0", F.lit(0))
    return p.select("lang", up.alias("up"), down.alias("down"), (up / (up + down)).alias("share"))


@query(
    """WITH m AS (SELECT max(ts) AS t FROM events), w(name, h) AS (VALUES ('1h', 1), ('24h', 24), ('7d', 168)), x AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM events, m, w WHERE ts > t - to_hours(h))
 SELECT name, n, max(CASE WHEN i = floor((n - 1) * 0.5) THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95) THEN value END) AS p95 FROM x GROUP BY ALL"""
)
def reliability_windows(spark, sf):
    """Counts and floor-index percentiles over several windows, from counts by value that Spark combines before the shuffle."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("t")).scalar()
    spans = F.array(*[F.when(F.col("ts") > last - F.expr(f"interval {h} hours"), F.lit(name)) for name, h in (("1h", 1), ("24h", 24), ("7d", 168))])
    by_value = e.select("value", F.explode(F.array_compact(spans)).alias("name")).groupBy("name", "value").agg(F.count("*").alias("k"))
    w = Window.partitionBy("name")
    x = by_value.select("name", "value", F.sum("k").over(w).alias("n"), F.sum("k").over(w.orderBy("value")).alias("upto"))
    at = {p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q), F.col("value"))).alias(p) for p, q in (("p50", 0.5), ("p95", 0.95))}
    return x.groupBy("name", "n").agg(*at.values())


@query(f"WITH {CONTENTS}, w AS (SELECT DISTINCT id, source_id, unnest(regexp_split_to_array(lower(summary), '[^a-z]+')) AS token FROM c), n AS (SELECT source_id, count(*) AS n FROM c GROUP BY 1) SELECT source_id, token, count(*) AS k FROM w JOIN n USING (source_id) WHERE length(token) >= 2 GROUP BY source_id, token, n HAVING count(*) >= greatest(1, ceil(0.3 * n))")
def centroid_tokens(spark, sf):
    """Tokens that three tenths of a group's members have."""
    c = contents(spark, sf).where("source_id is not null")
    n = c.groupBy("source_id").agg(F.count("*").alias("n"))
    w = c.select("source_id", F.explode(F.array_distinct(F.split(F.lower("summary"), "[^a-z]+"))).alias("token")).where(F.length("token") >= 2)
    k = w.groupBy("source_id", "token").agg(F.count("*").alias("k")).join(n, "source_id")
    return k.where(F.col("k") >= F.greatest(F.lit(1), F.ceil(0.3 * F.col("n")))).select("source_id", "token", "k")


@query(f"WITH {CONTENTS}, g AS (SELECT source_id, count(*) AS n, avg(length(body)) AS m FROM c WHERE source_id IS NOT NULL GROUP BY 1) SELECT source_id, row_number() OVER (ORDER BY n DESC, source_id) - row_number() OVER (ORDER BY m DESC, source_id) AS delta FROM g")
def rank_deltas(spark, sf):
    """Change of rank between two orders of the sources."""
    g = contents(spark, sf).where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"), F.avg(F.length("body")).alias("m"))
    one = Window.partitionBy(F.lit(0))
    return g.select("source_id", (F.row_number().over(one.orderBy(F.desc("n"), "source_id")) - F.row_number().over(one.orderBy(F.desc("m"), "source_id"))).alias("delta"))


@query(f"WITH {CONTENTS} SELECT title, min(id) AS canonical, bool_or(is_read) AS is_read, bool_or(favorited) AS favorited, min(coalesce(publish_time, fetched_at)) AS first_seen, max(coalesce(publish_time, fetched_at)) AS last_seen FROM c GROUP BY 1")
def merged_state(spark, sf):
    """A group's user state and times."""
    seen = F.coalesce("publish_time", "fetched_at")
    return contents(spark, sf).groupBy("title").agg(F.min("id").alias("canonical"), F.bool_or("is_read").alias("is_read"), F.bool_or("favorited").alias("favorited"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


@query("SELECT u.user_id, seen, newest, newest > seen AS unread FROM (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'view') AS seen FROM events GROUP BY 1) u JOIN (SELECT user_id, max(event_id) AS newest FROM events GROUP BY 1) v USING (user_id)")
def read_states(spark, sf):
    """The last version seen against the newest, in one pass."""
    seen, newest = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))), F.max("event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(seen.alias("seen"), newest.alias("newest"), (newest > seen).alias("unread"))


@query("SELECT lower(role) AS term, min(pos) AS pos FROM (SELECT upper(role) AS role, conv_id * 1000 + turn AS pos FROM conversations UNION ALL SELECT event_type, 1000000000 + event_id FROM events) GROUP BY 1")
def ordered_term_union(spark, sf):
    """Terms of two lists, regardless of case, at their first place."""
    a = table(spark, sf, "conversations").select(F.upper("role").alias("role"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    b = table(spark, sf, "events").select("event_type", 1000000000 + F.col("event_id"))
    return a.union(b).groupBy(F.lower("role").alias("term")).agg(F.min("pos").alias("pos"))


@query("WITH p AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F') SELECT (SELECT count(*) FROM (SELECT id FROM p EXCEPT SELECT c_custkey FROM customer)) AS unknown, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT id FROM p)) AS missing")
def partition_check(spark, sf):
    """Members that a split invents or loses, from one outer join."""
    parts = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("p", F.lit(1))
    both = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("c")).join(parts, "id", "full")
    return both.agg(F.count_if(F.col("c").isNull()).alias("unknown"), F.count_if(F.col("p").isNull()).alias("missing"))


@query(f"WITH {CONTENTS}, g AS (SELECT id, list_distinct(list_transform(range(1, length(title) - 2), lambda i: substr(lower(title), i, 4))) AS a, list_distinct(list_transform(range(1, length(summary) - 2), lambda i: substr(lower(summary), i, 4))) AS b FROM c WHERE length(title) >= 4) SELECT id, len(list_intersect(a, b)) / len(a) AS grounded FROM g")
def title_grounding(spark, sf):
    """Share of a title's 4-grams that its summary holds."""

    def grams(c: str):
        # the length stays that of the text itself: lower-casing may add a character, which the grams end before
        return text.once(F.struct(F.lower(c).alias("low"), F.length(c).alias("n")), lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), x.n - 3), lambda i: F.substring(x.low, i, F.lit(4)))))

    c = contents(spark, sf).where(F.length("title") >= 4).select("id", grams("title").alias("a"), grams("summary").alias("b"))
    return c.select("id", (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("grounded"))


@query("SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def business_days(spark, sf):
    """Counts by local date (eight hours east)."""
    return table(spark, sf, "events").groupBy(F.to_date(F.col("ts") + F.expr("interval 8 hours")).alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {SOURCES} SELECT source_id, 3600 * (0.9 + 0.2 * (('0x' || substr(sha256(source_id), 1, 8))::BIGINT / 4294967296)) AS seconds FROM s WHERE enabled")
def jittered_intervals(spark, sf):
    """Fetch intervals that a hash spreads by a tenth."""
    part = F.conv(F.substring(F.sha2("source_id", 256), 1, 8), 16, 10).cast("double") / 4294967296
    return sources(spark, sf).where("enabled").select("source_id", (3600 * (0.9 + 0.2 * part)).alias("seconds"))


@query(f"WITH {CONTENTS} SELECT id, coalesce(exp(-abs(date_diff('second', publish_time, TIMESTAMP '2024-01-02 00:00:00')) / 86400.0 / 7), 0.5) AS closeness FROM c")
def temporal_similarity(spark, sf):
    """Closeness in time, one half where it is unknown."""
    gap = F.abs(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("publish_time"))
    return contents(spark, sf).select("id", F.coalesce(F.exp(-gap / 86400.0 / 7), F.lit(0.5)).alias("closeness"))


@query(f"WITH {CONTENTS} SELECT min(id) AS id FROM c WHERE title IS NOT NULL GROUP BY title, publish_time")
def batch_dedup(spark, sf):
    """The first item of each title and publication time."""
    return contents(spark, sf).where("title is not null").groupBy("title", "publish_time").agg(F.min("id").alias("id")).select("id")


@query(
    f"""WITH {FETCH_LOG}, r AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY attempted_at, id) AS run FROM l), z AS (SELECT source_id, max(run) AS run FROM r GROUP BY 1)
 SELECT *, least(n * CASE outcome WHEN 'failure' THEN 900 ELSE 300 END, 21600) AS cooldown FROM (SELECT source_id, outcome, count(*) AS n FROM r JOIN z USING (source_id, run) WHERE outcome <> 'success' GROUP BY 1, 2)"""
)
def cooldowns(spark, sf):
    """Failures of each kind since the last success, and the pause they cause."""
    log = fetch_log(spark, sf)
    last = log.where("outcome = 'success'").groupBy("source_id").agg(F.max(F.struct("attempted_at", "id")).alias("ok"))
    since = log.where("outcome <> 'success'").join(last, "source_id", "left").where(F.col("ok").isNull() | (F.struct("attempted_at", "id") > F.col("ok")))
    n = since.groupBy("source_id", "outcome").agg(F.count("*").alias("n"))
    return n.withColumn("cooldown", F.least(F.col("n") * F.when(F.col("outcome") == "failure", 900).otherwise(300), F.lit(21600)))


@query("WITH m AS (SELECT max(ts) AS t FROM events) SELECT user_id, CASE WHEN max(ts) >= any_value(t) - INTERVAL 72 HOUR THEN 'active' WHEN max(ts) >= any_value(t) - INTERVAL 14 DAY THEN 'cooling' ELSE 'closed' END AS state FROM events, m GROUP BY 1")
def lifecycle_states(spark, sf):
    """Active, cooling or closed by the age of the last activity."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("t")).scalar()
    u = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    state = F.when(F.col("seen") >= last - F.expr("interval 72 hours"), "active").when(F.col("seen") >= last - F.expr("interval 14 days"), "cooling").otherwise("closed")
    return u.select("user_id", state.alias("state"))


@query("SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) AS bucket, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def scheduled_once(spark, sf):
    """One run for each schedule and minute."""
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("minute", "ts").alias("bucket")).agg(F.min("event_id").alias("event_id"))


@query("WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events, m WHERE ts > t - INTERVAL 48 HOUR QUALIFY rank <= 3")
def catch_up(spark, sf):
    """The last three runs of each schedule in a window."""
    e = table(spark, sf, "events")
    recent = e.where(F.col("ts") > e.agg(F.max("ts").alias("t")).scalar() - F.expr("interval 48 hours"))
    return rows.top_per_group(recent, ["event_type"], [F.desc("ts"), F.desc("event_id")], 3).select("event_type", "event_id", "rank")


@query(f"WITH {FETCH_LOG}, g AS (SELECT *, lag(attempted_at) OVER (PARTITION BY source_id ORDER BY attempted_at, id) AS before FROM l WHERE outcome = 'failure') SELECT id FROM g WHERE before IS NULL OR attempted_at - before >= INTERVAL 6 HOUR")
def throttled_alerts(spark, sf):
    """Failures that alert, as none came in the six hours before."""
    w = Window.partitionBy("source_id").orderBy("attempted_at", "id")
    g = fetch_log(spark, sf).where("outcome = 'failure'").withColumn("before", F.lag("attempted_at").over(w))
    return g.where(F.col("before").isNull() | (F.col("attempted_at") - F.expr("interval 6 hours") >= F.col("before"))).select("id")


def _lane_sql(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 2 WHEN contains(lower(body), '{t}') THEN 1 ELSE 0 END" for t in terms)


@query(f"WITH {CONTENTS}, h AS (SELECT id, " + ", ".join(f"{_lane_sql(t)} AS {n}" for n, t in LANES) + " FROM c) SELECT id, CASE WHEN greatest(market, policy, science) = 0 THEN 'general' WHEN market >= greatest(policy, science) THEN 'market' WHEN policy >= science THEN 'policy' ELSE 'science' END AS lane FROM h")
def lanes(spark, sf):
    """The lane with most hits (title 2, body 1), the first on ties."""

    def hits(terms):
        return sum((F.when(F.contains(F.lower("title"), F.lit(t)), 2).when(F.contains(F.lower("body"), F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))

    c = contents(spark, sf).select("id", *[hits(t).alias(n) for n, t in LANES])
    best = F.greatest(*[F.col(n) for n, _ in LANES])
    lane = F.when(best == 0, "general")
    for n, _ in LANES:
        lane = lane.when(F.col(n) == best, n)
    return c.select("id", lane.alias("lane"))


@query(
    f"""WITH {CONTENTS}, x AS (SELECT title AS p, source_id AS g, count(*) AS n FROM c WHERE title IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL), y AS (SELECT *, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY g) AS ng FROM x)
 SELECT sum(n * n / np) / sum(n) AS bcubed_precision, sum(n * n / ng) / sum(n) AS bcubed_recall FROM y"""
)
def bcubed(spark, sf):
    """B-cubed precision and recall from the sizes of overlaps, without pairs of items."""
    x = contents(spark, sf).where("title is not null and source_id is not null").groupBy("title", "source_id").agg(F.count("*").alias("n"))
    y = x.withColumns({"np": F.sum("n").over(Window.partitionBy("title")), "ng": F.sum("n").over(Window.partitionBy("source_id"))})
    share = lambda c: F.sum(F.col("n") * F.col("n") / F.col(c)) / F.sum("n")
    return y.agg(share("np").alias("bcubed_precision"), share("ng").alias("bcubed_recall"))


@query(f"WITH {CONTENTS}, m AS (SELECT lang, avg(CASE WHEN length(body) >= 280 THEN 1.0 ELSE 0.0 END) AS full_share, count(*) AS n FROM c GROUP BY 1) SELECT lang, full_share, CASE WHEN n < 20 THEN 'unknown' WHEN full_share >= 0.9 THEN 'pass' ELSE 'fail' END AS gate FROM m")
def quality_gates(spark, sf):
    """Shares of full texts by stratum, against a threshold."""
    m = contents(spark, sf).groupBy("lang").agg(F.avg(F.when(F.length("body") >= 280, 1.0).otherwise(0.0)).alias("full_share"), F.count("*").alias("n"))
    return m.select("lang", "full_share", F.when(F.col("n") < 20, "unknown").when(F.col("full_share") >= 0.9, "pass").otherwise("fail").alias("gate"))


@query(f"WITH {CONTENTS}, d AS (SELECT id, body AS a, trim(body) || CASE WHEN id % 6 = 0 THEN '.' ELSE '' END AS b FROM c) SELECT id, length(b) - length(a) AS delta, sha256(a) <> sha256(b) AS changed FROM d WHERE a IS NOT NULL")
def shadow_diff(spark, sf):
    """Two versions of a text by length and hash."""
    new = F.concat(F.trim("body"), F.when(F.col("id") % 6 == 0, ".").otherwise(""))
    c = contents(spark, sf).where("body is not null")
    return c.select("id", (F.length(new) - F.length("body")).alias("delta"), (F.sha2("body", 256) != F.sha2(new, 256)).alias("changed"))


@query("SELECT page_id, coalesce(regexp_extract(url, '/([0-9]+)(?:[/?#]|$)', 1), '') AS article_no, CASE WHEN regexp_extract(url, '/([0-9]+)(?:[/?#]|$)', 1) <> '' THEN regexp_extract(url, '/([0-9]+)(?:[/?#]|$)', 1) ELSE 'hash:' || sha1(url) END AS external_id FROM pages")
def article_ids(spark, sf):
    """The number in an article's path, else a hash."""
    n = F.regexp_extract("url", r"/([0-9]+)(?:[/?#]|$)", 1)
    return table(spark, sf, "pages").select("page_id", n.alias("article_no"), F.when(n != "", n).otherwise(F.concat(F.lit("hash:"), F.sha1("url"))).alias("external_id"))


@query("SELECT page_id, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS origin FROM pages WHERE contains(url, 'utm_source=')")
def query_parameters(spark, sf):
    """A parameter looked up in a map made of the query text."""
    q = F.str_to_map(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
    p = table(spark, sf, "pages").where(F.contains("url", F.lit("utm_source=")))
    return p.select("page_id", F.coalesce(F.try_element_at(q, F.lit("utm_source")), F.lit("")).alias("origin"))


@query("SELECT event_type AS route, count(*) AS n, avg(value) AS mean, max(value) AS slowest, count(*) FILTER (WHERE value >= 100) AS slow FROM events GROUP BY 1")
def request_metrics(spark, sf):
    """Requests by route."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("slowest"), F.count_if(F.col("value") >= 100).alias("slow"))


@query("SELECT 'documents' AS name, count(*) AS n, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status FROM documents UNION ALL SELECT 'events', count(*), CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END FROM events UNION ALL SELECT 'pages', count(*), CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END FROM pages")
def table_doctor(spark, sf):
    """Row counts of tables, with a status."""
    out = None
    for name in ("documents", "events", "pages"):
        n = table(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.when(F.col("n") == 0, "empty").otherwise("ok").alias("status"))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {CONTENTS}, k AS (SELECT DISTINCT source_id FROM c WHERE archived) SELECT id FROM c WHERE source_id IN (SELECT source_id FROM k WHERE source_id IS NOT NULL)")
def keyword_gate(spark, sf):
    """Items whose source passes a gate (semi join)."""
    c = contents(spark, sf)
    return c.join(c.where("archived").select("source_id").distinct(), "source_id", "left_semi").select("id")


@query(f"WITH {CONTENTS} SELECT id, regexp_replace(regexp_replace(regexp_replace(title, '[*_`]+', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '^#+ *', '') AS plain, 'Digest ' || strftime(fetched_at, '%Y-%m-%d %H:00') AS heading FROM c")
def markdown_plain(spark, sf):
    """Markdown marks taken off a title, and a digest's heading."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("title", "[*_`]+", ""), r"\[([^\]]*)\]\([^)]*\)", "$1"), "^#+ *", "")
    return contents(spark, sf).select("id", t.alias("plain"), F.concat(F.lit("Digest "), F.date_format("fetched_at", "yyyy-MM-dd HH:00")).alias("heading"))
