"""Registered queries of links, sentences, highlights, relations and projections, each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import sentences as st
from strandline.functions import text
from strandline.plans.catalog import query
from strandline.plans.rules import _RULES, q, rule_scored
from strandline.plans.upkeep import _ATOMS, atoms
from strandline.sources.views import CONTENTS, FETCH_LOG, HEADLINES, SOURCES, contents, fetch_log, headlines, sources, table

# First path segments that hold no articles, and segments that articles follow.
SECTIONS = ("/video", "/videos", "/podcasts", "/newsletters", "/livecoverage", "/live", "/search", "/topics", "/topic", "/tag", "/tags", "/authors", "/author", "/account", "/subscribe", "/login", "/signin", "/category", "/list", "/channel",
            "/channels", "/special", "/zhuanti", "/fenlei", "/pindao")
HUBS = ("article", "articles", "blog", "blogs", "news", "post", "posts", "story", "stories")
# Certainty by modality.
CERTAINTY = {"retracted": 1, "disputed": 2, "denied": 3, "question": 4, "alleged": 5, "planned": 6, "reported": 7, "confirmed": 8}


def article_path(path):
    """Whether a path is shaped like an article's: not of a section, and behind a hub or with a slug at its end."""
    p = F.lower(F.coalesce(path, F.lit("")))
    tail = F.regexp_extract(p, "([^/]*)/*$", 1)
    hub = p.rlike("/(" + "|".join(HUBS) + ")/+[^/]")
    return ~p.isin("", "/") & ~p.rlike("^(" + "|".join(SECTIONS) + ")") & (hub | tail.rlike("[-.0-9]"))


@query(
    "WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS p FROM pages) SELECT page_id, p NOT IN ('', '/') AND NOT regexp_matches(p, '^("
    + "|".join(SECTIONS) + ")') AND (regexp_matches(p, '/(" + "|".join(HUBS) + ")/+[^/]') OR regexp_matches(regexp_extract(p, '([^/]*)/*$', 1), '[-.0-9]')) AS article FROM pages JOIN p USING (page_id)"
)
def article_urls(spark, sf):
    """Paths that are shaped like an article's; with the site and wrappers it is link_outcomes."""
    return table(spark, sf, "pages").select("page_id", article_path(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)).alias("article"))


@query(
    """WITH l AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS site, list_distinct(regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1)) AS x, regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1) AS y FROM pages)
 SELECT page_id, array_to_string(list_transform(list_filter(y, lambda h, i: list_position(y, h) = i)[1:4], lambda h: site || h), ' ') AS links, len(x) AS n FROM l"""
)
def page_links(spark, sf):
    """Links of a page to its own site in order, each once, up to a cap that is the feature, and how many there are."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('<a [^>]*href="(/[^"]*)"'), F.lit(1)))
    site = F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1)
    rows = table(spark, sf, "pages").select("page_id", site.alias("site"), found.alias("x"))
    return rows.select("page_id", F.array_join(F.transform(F.slice("x", 1, 4), lambda h: F.concat("site", h)), " ").alias("links"), F.size("x").alias("n"))


_S = f"""sn AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(title || chr(10) || body, ''), '([。！？!?；;])\\s*', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: length(s) >= 8) AS l FROM h),
 su AS (SELECT id, unnest(list_distinct(l)) AS s FROM sn), sw AS (SELECT id, s, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS w, regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]') AS han, regexp_matches(s, {q(st.VERBS)}) AS verb FROM su),
 sr AS (SELECT id, CASE WHEN regexp_matches(lower(s), {q("|".join(st.NOTICES))}) THEN 'boilerplate' WHEN len(regexp_extract_all(s, '[{{}}\\[\\]();=<>|/\\\\`$#*]')) / length(s) > 0.20 THEN 'code_like' WHEN han AND length(s) < 20 THEN 'short_cjk' WHEN NOT han AND len(w) < 6 THEN 'short_en'
  WHEN regexp_matches(s, '[:：]$') AND (han OR NOT verb) THEN 'label_like' WHEN NOT han AND len(w) <= 6 AND NOT regexp_matches(s, '[0-9]') AND NOT verb AND len(list_filter(w, lambda x: regexp_matches(substr(x, 1, 1), '\\p{{Lu}}'))) >= greatest(1, len(w) - 1) THEN 'title_like' END AS reason FROM sw)"""


@query(f"WITH {HEADLINES}, {_S} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM sr GROUP BY 1")
def sentence_candidates(spark, sf):
    """Sentences of all texts, each once a text, by the reason for which they are left out."""
    s = headlines(spark, sf).select(F.explode(st.sentences(F.concat("title", F.lit("\n"), "body"))).alias("s"))
    return s.groupBy(F.coalesce(st.refusal(F.col("s")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_EVENTS = f"""{_RULES}, ev AS (SELECT 'e' || rs.id % 30 AS event, max(score) AS importance, count(DISTINCT rs.source_id) AS sources, max(h.fetched_at) AS seen, min(h.lane_) AS lane FROM rs JOIN (SELECT id, fetched_at, content_type AS lane_ FROM h) h USING (id) GROUP BY 1)"""


@query(
    f"""WITH {_EVENTS}, rl(scope, key, rule) AS (VALUES ('event', 'e7', 'mute'), ('event', 'e8', 'highlight'), ('content_type', 'rss', 'quiet'), ('content_type', 'x', 'notify'), ('event', 'e9', 'highlight')),
 ca AS (SELECT * FROM ev, (SELECT max(seen) AS now FROM ev) WHERE seen >= now - INTERVAL 48 HOUR AND importance >= 45 AND sources >= 2), sp AS (SELECT event, 'event' AS scope, event AS key FROM ca UNION ALL SELECT event, 'content_type', lane FROM ca),
 mt AS (SELECT event, bool_or(rule = 'mute') AS muted, max(CASE rule WHEN 'notify' THEN 2 WHEN 'highlight' THEN 1 WHEN 'quiet' THEN -1 END) AS priority FROM sp JOIN rl USING (scope, key) GROUP BY 1)
 SELECT event, importance, coalesce(priority, 0) AS priority FROM ca LEFT JOIN mt USING (event) WHERE NOT coalesce(muted, false) ORDER BY coalesce(priority, 0) DESC, importance DESC, seen DESC, event LIMIT 20"""
)
def highlights(spark, sf):
    """Important events of two sources and more in 48 hours under the user's rules: muted ones go, others are sorted by rule, then importance."""
    r = rule_scored(spark, sf)
    ev = r.groupBy(F.concat(F.lit("e"), F.col("id") % 30).alias("event")).agg(F.max("score").alias("importance"), F.count_distinct("source_id").alias("sources"), F.max("fetched_at").alias("seen"), F.min("content_type").alias("lane"))
    now = ev.agg(F.max("seen")).scalar()
    ca = ev.where((F.col("seen") >= now - F.expr("interval 48 hours")) & (F.col("importance") >= 45) & (F.col("sources") >= 2))
    rows = [("event", "e7", "mute"), ("event", "e8", "highlight"), ("content_type", "rss", "quiet"), ("content_type", "x", "notify"), ("event", "e9", "highlight")]
    known = spark.createDataFrame(rows, "scope string, key string, rule string")
    scopes = ca.select("event", F.explode(F.array(F.struct(F.lit("event").alias("scope"), F.col("event").alias("key")), F.struct(F.lit("content_type").alias("scope"), F.col("lane").alias("key")))).alias("s")).select("event", "s.scope", "s.key")
    priority = F.when(F.col("rule") == "notify", 2).when(F.col("rule") == "highlight", 1).when(F.col("rule") == "quiet", -1)
    matched = scopes.join(F.broadcast(known), ["scope", "key"]).groupBy("event").agg(F.bool_or(F.col("rule") == "mute").alias("muted"), F.max(priority).alias("priority"))
    left = ca.join(matched, "event", "left").where(~F.coalesce("muted", F.lit(False))).withColumn("priority", F.coalesce("priority", F.lit(0)))
    return left.orderBy(F.desc("priority"), F.desc("importance"), F.desc("seen"), "event").limit(20).select("event", "importance", "priority")


_SCORES = " ".join(f"WHEN '{k}' THEN {n}" for k, n in CERTAINTY.items())
_NAMES = list(CERTAINTY)


@query(f"WITH {CONTENTS}, m AS (SELECT id, ['{"','".join(_NAMES)}'][id % 8 + 1] AS up, ['{"','".join(_NAMES)}'][id * 5 % 8 + 1] AS brief FROM c) SELECT id, up, brief, CASE brief {_SCORES} END > CASE up {_SCORES} END AS blocked FROM m")
def modality_checks(spark, sf):
    """Briefs that assert more certainty than their sources are blocked."""
    scores = F.create_map(*[F.lit(x) for p in CERTAINTY.items() for x in p])
    pick = lambda n: F.element_at(F.array(*map(F.lit, _NAMES)), (n % 8 + 1).cast("int"))
    m = contents(spark, sf).select("id", pick(F.col("id")).alias("up"), pick(F.col("id") * 5).alias("brief"))
    return m.select("id", "up", "brief", (F.element_at(scores, F.col("brief")) > F.element_at(scores, F.col("up"))).alias("blocked"))


@query(f"WITH {_ATOMS}, e AS (SELECT atom_id AS x, atom_id * 7 % 1000 AS y FROM a) SELECT 'out' AS side, x AS atom, y AS other FROM e UNION ALL SELECT 'in', y, x FROM e WHERE x <> y")
def relations_of_atom(spark, sf):
    """The edges of every atom, whichever end it stands at: two projections instead of an OR; an edge to itself once."""
    e = atoms(spark, sf).select(F.col("atom_id").alias("x"), (F.col("atom_id") * 7 % 1000).alias("y"))
    return e.select(F.lit("out").alias("side"), F.col("x").alias("atom"), F.col("y").alias("other")).unionAll(e.where("x <> y").select(F.lit("in"), "y", "x"))


@query(f"WITH {_ATOMS} SELECT domain AS entity, count(DISTINCT content_id) AS contents, count(*) AS mentions FROM a GROUP BY 1")
def entity_atoms(spark, sf):
    """Entities with their distinct contents and mentions."""
    return atoms(spark, sf).groupBy(F.col("domain").alias("entity")).agg(F.count_distinct("content_id").alias("contents"), F.count("*").alias("mentions"))


@query(f"WITH {HEADLINES} SELECT id, (length(trim(title)) > 0 AND NOT regexp_matches(title, '[\\x{{4e00}}-\\x{{9fff}}]') AND id % 3 <> 0) OR (length(trim(summary)) >= 5 AND NOT regexp_matches(summary, '[\\x{{4e00}}-\\x{{9fff}}]') AND id % 4 <> 0) AS wanted FROM h")
def translation_wanted(spark, sf):
    """rows whose title or summary is in another language and has no translation."""
    han = lambda c: F.col(c).rlike(r"[\x{4e00}-\x{9fff}]")
    title = (F.length(F.trim("title")) > 0) & ~han("title") & (F.col("id") % 3 != 0)
    return headlines(spark, sf).select("id", (title | (F.length(F.trim("summary")) >= 5) & ~han("summary") & (F.col("id") % 4 != 0)).alias("wanted"))


@query(
    f"""WITH {CONTENTS}, v AS (SELECT source_id, id, title, content_type, lag(title) OVER w AS t0, lag(content_type) OVER w AS c0, row_number() OVER w AS version FROM c WHERE source_id IS NOT NULL WINDOW w AS (PARTITION BY source_id, id % 16 ORDER BY id))
 SELECT source_id, id, version, version = 1 OR title IS DISTINCT FROM t0 OR content_type IS DISTINCT FROM c0 AS changed FROM v"""
)
def snapshot_changes(spark, sf):
    """Snapshots of an event that differ from the one before in any field."""
    v = contents(spark, sf).where("source_id is not null").select("source_id", "id", "title", "content_type")
    w = Window.partitionBy("source_id", F.col("id") % 16).orderBy("id")
    differs = [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("title", "content_type")]
    version = F.row_number().over(w)
    return v.select("source_id", "id", version.alias("version"), ((version == 1) | differs[0] | differs[1]).alias("changed"))


@query(f"WITH {FETCH_LOG}, n AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') / count(*)::DOUBLE AS rate FROM l GROUP BY 1) SELECT source_id, n, round(rate, 6) AS rate, row_number() OVER (ORDER BY n DESC, source_id) AS place FROM n")
def sources_by_count(spark, sf):
    """Sources in order of their number of fetches, with the rate of success."""
    ok = F.count_if(F.col("outcome") == "success") / F.count("*")
    n = fetch_log(spark, sf).groupBy("source_id").agg(F.count("*").alias("n"), F.round(ok, 6).alias("rate"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source_id")))


@query(f"WITH {FETCH_LOG}, {SOURCES}, k AS (SELECT source_id, CAST(regexp_extract(source_id, '([0-9]+)', 1) AS INT) AS num, stars FROM s) SELECT l.id, k.source_id AS source, stars, outcome FROM l JOIN k ON l.source_id = k.num")
def fetches_with_source(spark, sf):
    """Fetch attempts with their source; the table of sources is joined as the small side when it is one."""
    k = sources(spark, sf).select(F.col("source_id").alias("source"), F.regexp_extract("source_id", "([0-9]+)", 1).cast("int").alias("num"), "stars")
    return fetch_log(spark, sf).join(k, F.col("source_id") == F.col("num")).select("id", "source", "stars", "outcome")


@query(
    """WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m|mobile|amp)\\.', '') AS host FROM pages), n AS (SELECT host, count(*) AS n FROM p GROUP BY 1), b AS (SELECT host, n % 3 = 0 AS ready FROM n WHERE n % 2 = 0)
 SELECT page_id, host, ready, page_id % 5 = 0 OR ready IS NOT NULL AS paid FROM p LEFT JOIN b USING (host)"""
)
def host_sessions(spark, sf):
    """Pages with the browser session of their host, and which belong to paid sources by flag or session."""
    p = table(spark, sf, "pages").select("page_id", text.bare_host(F.col("url")).alias("host"))
    b = p.groupBy("host").agg(F.count("*").alias("n")).where("n % 2 = 0").select("host", (F.col("n") % 3 == 0).alias("ready"))
    return p.join(b, "host", "left").select("page_id", "host", "ready", ((F.col("page_id") % 5 == 0) | F.col("ready").isNotNull()).alias("paid"))


@query(f"WITH {_RULES} SELECT rs.id, score, confidence, status FROM rs JOIN h USING (id) WHERE status IN ('full', 'partial') AND score BETWEEN 50 AND 80 AND title ILIKE '%s%' ORDER BY score DESC, rs.id LIMIT 40")
def score_lab(spark, sf):
    """columns of the score, filtered by status, range and title, the best first."""
    r = rule_scored(spark, sf).where(F.col("status").isin("full", "partial") & F.col("score").between(50, 80) & F.col("title").ilike("%s%"))
    return r.orderBy(F.desc("score"), "id").limit(40).select("id", "score", "confidence", "status")


@query(f"WITH {SOURCES} SELECT '{{\"id\":\"' || source_id || '\",\"stars\":' || stars || ',\"authority\":\"' || authority || '\",\"enabled\":' || enabled || '}}' AS line FROM s")
def source_export(spark, sf):
    """A line of JSON for each source."""
    return sources(spark, sf).select(F.to_json(F.struct(F.col("source_id").alias("id"), "stars", "authority", "enabled")).alias("line"))


@query(f"WITH {CONTENTS} SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN id % 2 = 0 THEN 'added' END AS c FROM c")
def metadata_merge(spark, sf):
    """New metadata over old, key by key."""
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("added"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_zip_with(old, new, lambda k, x, y: F.coalesce(y, x))
    return contents(spark, sf).select("id", *[F.try_element_at(merged, F.lit(k)).alias(k) for k in "abc"])


@query(f"WITH {HEADLINES}, x AS (SELECT id, coalesce(source_id, '') AS s, length(title) AS n FROM h) SELECT id, row_number() OVER (PARTITION BY id % 25 ORDER BY n DESC, id DESC) AS rank FROM x")
def candidate_ranks(spark, sf):
    """Rank of each candidate for its content, by score and id."""
    x = headlines(spark, sf).select("id", F.length("title").alias("n"))
    return x.select("id", F.row_number().over(Window.partitionBy(F.col("id") % 25).orderBy(F.desc("n"), F.desc("id"))).alias("rank"))
