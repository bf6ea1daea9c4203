"""Registered queries of admission: rejected items, links of listing pages, captions, event lifecycle; each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import captions
from strandline.operators import admission as ad
from strandline.operators import lifecycle
from strandline.plans.catalog import query
from strandline.plans.rules import q
from strandline.sources.views import HEADLINES, headlines, table

#: Hosts, paths and titles dealt out by id, so that every rule has rows that it meets and rows that it spares.
HOSTS = ("example.org", "www.hbr.org", "www.businessinsider.com", "engadget.com", "news.example.co.uk", "techmeme.com", "blog.example.org")
PATHS = (
    "/2024/03/a-long-story-of-5-words.html", "/", "/topics", "/story/best-promo-codes-2024", "/photos/week", "/gallery/12", "/world", "/big-science-news-3", "/guides/travel-hub", "/markets/asia", "/caf%C3%A9", "/tech/ai-index",
    "/opinion/editors/what-now", "/a+b%2",
)
TITLES = ("", "Subscribe", "Latest", "Save up to $30: promo code", "The week in pictures", "图集：今日", "Travel &amp; retail", "My library: strategy", "<b>Markets</b>", "Law", "市场【要闻】", "Review recap: phones")


def items(spark, sf) -> DataFrame:
    """Fetched items that follow from documents."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    h = headlines(spark, sf).withColumn("host", pick(HOSTS))
    i = F.col("id")
    return h.select(
        "id", F.when(i % 3 == 0, F.concat(pick(TITLES), F.lit(" "), "title")).otherwise(pick(TITLES)).alias("title"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("source_url"),
        F.when(i % 17 != 16, F.concat(F.lit("https://"), F.when(i % 10 == 9, "elsewhere.net").otherwise(F.col("host")), pick(PATHS))).alias("url"),
        F.when(i % 5 < 2, F.substring("body", 1, 60)).when(i % 5 == 2, F.col("body")).when(i % 5 == 3, pick(TITLES)).alias("content"), F.when(i % 4 == 0, F.repeat("body", F.lit(2))).alias("html"),
        F.when(i % 6 == 0, F.array(F.lit(" Coupons "))).when(i % 6 == 3, F.array(F.lit("news"))).alias("tags"),
    )


def _names(names) -> str:
    return "[" + ", ".join(map(q, names)) + f"][id % {len(names)} + 1]"


_ITEMS = f"""{HEADLINES}, hh AS (SELECT *, {_names(HOSTS)} AS host FROM h),
 it AS (SELECT id, CASE WHEN id % 3 = 0 THEN {_names(TITLES)} || ' ' || title ELSE {_names(TITLES)} END AS title, 'https://' || host || '/' AS source_url, CASE WHEN id % 17 <> 16 THEN 'https://' || CASE WHEN id % 10 = 9 THEN 'elsewhere.net' ELSE host END || {_names(PATHS)} END AS url,
  CASE WHEN id % 5 < 2 THEN substr(body, 1, 60) WHEN id % 5 = 2 THEN body WHEN id % 5 = 3 THEN {_names(TITLES)} END AS content, CASE WHEN id % 4 = 0 THEN body || body END AS html, CASE WHEN id % 6 = 0 THEN [' Coupons '] WHEN id % 6 = 3 THEN ['news'] END AS tags FROM hh)"""


def _plain(c: str) -> str:
    out = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')"
    for name, value in ad.ENTITIES:
        out = f"replace({out}, {q(name)}, {q(value)})"
    return f"trim({out})"


def _key(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(translate(replace({_plain(c)}, '&', ' and '), '/-', '  ')), '[^0-9a-z\x{{4e00}}-\x{{9fff}} ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _host(c: str) -> str:
    return rf"regexp_replace(lower(regexp_extract(coalesce({c}, ''), {q(ad.HOST)}, 2)), '^www\.', '')"


def _part(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in parts) + ")"


def _in(h: str, domain: str) -> str:
    return f"({h} = '{domain}' OR ends_with({h}, '.{domain}'))"


def _meets(parts) -> str:
    return "len(list_intersect(parts, [" + ", ".join(map(q, parts)) + "])) > 0"


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, {q(ad.WORDS)}))"


def _decoded(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN {c} ELSE lower(url_decode(replace({c}, '+', '%2B'))) END"


_SHAPED = rf"""{_ITEMS}, s0 AS (SELECT id, {_plain("title")} AS title, {_key("title")} AS key, trim(coalesce(url, '')) AS url, {_host("source_url")} AS site, {_host("url")} AS host, {_plain("content")} AS text, {_key("content")} AS text_key, coalesce(length(html), 0) AS html,
  coalesce(tags, []) AS tags, lower(regexp_extract(coalesce(url, ''), {q(ad.PATH)}, 1)) AS path FROM it),
 s1 AS (SELECT *, {_decoded("path")} AS open, list_filter(list_transform(string_split(path, '/'), lambda s: trim({_decoded("s")})), lambda s: s <> '') AS parts FROM s0),
 s2 AS (SELECT *, coalesce(parts[-1], '') AS tail, list_filter(regexp_split_to_array(coalesce(parts[-1], ''), '[-_]+'), lambda w: w <> '') AS tw FROM s1),
 s3 AS (SELECT *, url <> '' AND site <> '' AND (host = site OR ends_with(host, '.' || site)) AND (len(parts) = 0 OR {_meets(ad.SEGMENTS)} OR (NOT contains(tail, '.') AND (coalesce(tw[-1], '') IN ({", ".join(map(q, ad.SECTION_ENDS))})
   OR (len(parts) = 1 AND NOT regexp_matches(tail, '\p{{Nd}}') AND len(tw) <= 4) OR (len(parts) <= 2 AND regexp_matches(tail, '^\p{{L}}+$'))))) AS section,
  (length(text) < 250 AND {_words("text")} < 40 AND html < 2000) OR (text <> '' AND text_key = key) AS thin FROM s2)"""


@query(
    rf"""WITH {_SHAPED} SELECT id, CASE
  WHEN (({_part("open", ad.COUPON_PATHS)} OR regexp_matches(title, {q(ad.COUPON_TITLE)})) AND len(list_filter(tags, lambda t: lower(trim(t)) IN ('coupon', 'coupons'))) > 0) OR ({_part("open", ad.COUPON_PATHS)} AND regexp_matches(title, {q(ad.COUPON_TITLE)}) AND regexp_matches(title, {q(ad.COUPON_LANDING)})) THEN 'blocked_promotional_coupon_page'
  WHEN {_in("host", ad.ROUNDUP_SITE)} AND ({_part("path", ad.ROUNDUP_SLUGS)} OR {_part("key", ad.ROUNDUP_TITLES)} OR starts_with(key, {q(ad.ROUNDUP_START)})) THEN 'blocked_engadget_roundup' WHEN {_meets(ad.GALLERIES)} THEN 'blocked_non_article_format'
  WHEN {" OR ".join(f"starts_with(title, {q(p)})" for p in ad.GALLERY_PREFIXES)} OR ({_part("key", ad.GALLERY_TITLES)} AND (len(parts) = 0 OR parts[1] IN ('photos', 'photo'))) THEN 'blocked_gallery_title' END AS format_reason,
 CASE WHEN key = '' THEN NULL WHEN regexp_matches(key, {q(ad.known(ad.NAVIGATION))}) THEN 'blocked_navigation_title' WHEN {" OR ".join(f"({_in('site', d)} AND thin AND {_meets(p)})" for d, p in ad.SITE_SEGMENTS.items())} THEN 'blocked_domain_non_article_path'
  WHEN section AND ({" OR ".join(f"({_in('site', d)} AND regexp_matches(key, {q(ad.known(t))}))" for d, t in ad.SITE_TITLES.items())}) THEN 'blocked_section_hub_title' WHEN section AND ({_words("key")} <= 3 OR regexp_matches(title, '[【】|]')) THEN 'blocked_cjk_nav_pattern'
  WHEN (section OR {_words("key")} <= 2) AND thin AND (NOT regexp_matches(title, '\p{{Nd}}') OR section) THEN 'low_content_single_phrase_link' END AS website_reason FROM s3"""
)
def admission_reasons(spark, sf):
    """the reason for which an item is no article in any channel, and the one for which a site's page is navigation, a section or a teaser."""
    return ad.reasons(items(spark, sf))


NOW = "2024-02-01 00:00:00"
LINK = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def links(spark, sf) -> DataFrame:
    """Links of pages as a listing's candidates, in their order; some repeat, leave the site or lack a time."""
    each = F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("t")))
    p = table(spark, sf, "pages").select("page_id", "url", each).select("page_id", "url", (F.col("pos") + 1).cast("long").alias("position"), F.col("col.h").alias("h"), F.col("col.t").alias("t"))
    n = F.col("page_id") + F.col("position")
    tail = F.substring("h", 2, 1000)
    href = F.when(n % 12 == 0, "").when(n % 12 == 1, F.lit("https://elsewhere.example/x-1")).when(n % 12 == 2, F.concat(F.lit("/login/"), tail)).when(n % 12 == 3, F.concat(F.lit("/story/"), tail)).when(n % 12 < 8, F.concat(F.lit("/a-"), F.col("position") % 2)).when(n % 12 == 8, F.lit("/world")).otherwise(F.concat("h", F.lit("-"), F.col("position") % 4))
    age = F.col("page_id") * F.col("position") % 11
    return p.select(
        F.col("page_id").alias("page"), "position", F.col("url").alias("base_url"), href.alias("href"), F.when(n % 5 != 0, F.concat(F.lit("A story of "), "t")).otherwise(F.col("t")).alias("title"),
        F.when(n % 7 != 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(age)).alias("publish_time"),
    )


def _registrable(h: str) -> str:
    l = f"list_filter(string_split({h}, '.'), lambda p: p <> '')"
    return f"CASE WHEN len({l}) < 2 THEN {h} WHEN len({l}) >= 3 AND array_to_string({l}[-2:], '.') IN ({', '.join(map(q, ad.SUFFIXES))}) THEN array_to_string({l}[-3:], '.') ELSE array_to_string({l}[-2:], '.') END"


def _same(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR ends_with({b}, '.' || {a}) OR {_registrable(a)} = {_registrable(b)}))"


def _article(path: str) -> str:
    return f"({path} NOT IN ('', '/') AND NOT regexp_matches({path}, '^({'|'.join(ad.STARTS)})') AND (regexp_matches({path}, '/({'|'.join(ad.HUBS)})/+[^/]') OR regexp_matches(regexp_extract({path}, '([^/]*)/*$', 1), '[-.0-9]')))"


_DROPS = rf"""l0 AS (SELECT page_id AS page, url AS base_url, unnest(range(1, len(h) + 1)) AS position, unnest(h) AS h, unnest(t) AS t FROM (SELECT page_id, url, regexp_extract_all(html, {q(LINK)}, 1) AS h, regexp_extract_all(html, {q(LINK)}, 2) AS t FROM pages)),
 l1 AS (SELECT page, position, base_url, (page + position) AS n, CASE WHEN n % 12 = 0 THEN '' WHEN n % 12 = 1 THEN 'https://elsewhere.example/x-1' WHEN n % 12 = 2 THEN '/login/' || substr(h, 2) WHEN n % 12 = 3 THEN '/story/' || substr(h, 2) WHEN n % 12 < 8 THEN '/a-' || position % 2 WHEN n % 12 = 8 THEN '/world' ELSE h || '-' || position % 4 END AS href,
  trim(CASE WHEN n % 5 <> 0 THEN 'A story of ' || t ELSE t END) AS title, CASE WHEN n % 7 <> 0 THEN TIMESTAMP '{NOW}' - to_days((page * position % 11)::INT) END AS publish_time FROM l0),
 l2 AS (SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(base_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') || href ELSE trim(href) END AS url FROM l1), l3 AS (SELECT *, {_host("url")} AS hu, {_host("base_url")} AS hb, lower(regexp_extract(url, {q(ad.PATH)}, 1)) AS p FROM l2),
 l4 AS (SELECT page, position, url, coalesce(publish_time < TIMESTAMP '{NOW}' - INTERVAL 7 DAY, false) AS stale, CASE WHEN url = '' THEN 'dropped_no_url' WHEN NOT {_same("hb", "hu")} THEN 'dropped_off_domain' WHEN {_part("lower(url)", ad.DENIED)} THEN 'dropped_deny'
  WHEN NOT {_article("p")} THEN 'dropped_non_article_url' WHEN length(title) < 8 THEN 'dropped_short_title' END AS early FROM l3),
 l5 AS (SELECT page, url, min(position) AS f FROM l4 WHERE early IS NULL AND NOT stale GROUP BY ALL), l6 AS (SELECT * FROM l5 QUALIFY row_number() OVER (PARTITION BY page ORDER BY f) <= 4),
 dr AS (SELECT page, position, url, coalesce(early, CASE WHEN f < position THEN 'dropped_duplicate' WHEN stale THEN 'dropped_stale' WHEN f = position THEN 'kept' ELSE 'truncated' END) AS outcome FROM l4 LEFT JOIN l6 USING (page, url))"""


def outcomes(spark, sf) -> DataFrame:
    return ad.discovered(links(spark, sf), F.lit(NOW).cast("timestamp"), most=4, articles=True, days=7)


@query(f"WITH {_DROPS} SELECT page, position, url, outcome FROM dr")
def link_outcomes(spark, sf):
    """what becomes of every link of a listing page; the cap on kept links is the feature."""
    return outcomes(spark, sf)


@query(f"WITH {_DROPS} SELECT page, count(*) AS total, {', '.join(f'''count(*) FILTER (WHERE outcome = '{o}') AS {o}''' for o in ad.OUTCOMES)} FROM dr GROUP BY 1")
def discovery_counters(spark, sf):
    """a listing page's counters of dropped, truncated and kept links."""
    return ad.counters(outcomes(spark, sf))


_LINE = "CASE WHEN i % 3 = 0 THEN '<c>' || s || '</c> &amp; more' ELSE s END"
_CUES = f"""w0 AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
 cu AS (SELECT doc_id, i, {_LINE} AS s FROM w0)"""


@query(
    rf"""WITH {_CUES}, vl AS (SELECT doc_id, i, regexp_replace(s, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g') AS s FROM cu), vk AS (SELECT doc_id, i, regexp_replace(replace(regexp_replace(s, '<[^>]+>', '', 'g'), '&amp;', '&'), '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g') AS s FROM vl
  WHERE s <> '' AND NOT regexp_matches(s, '^(?i:WEBVTT|NOTE|STYLE|REGION|KIND:|LANGUAGE:)') AND NOT contains(s, '-->') AND NOT regexp_matches(s, '^\p{{Nd}}+$')),
 vd AS (SELECT doc_id, i, s, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM vk WHERE s <> ''), vt AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM vd WHERE s IS DISTINCT FROM before GROUP BY 1),
 js AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM vl WHERE s <> '' GROUP BY 1)
 SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(vt.t, '') ELSE coalesce(js.t, '') END AS caption FROM documents d LEFT JOIN vt USING (doc_id) LEFT JOIN js USING (doc_id)"""
)
def caption_texts(spark, sf):
    """Text of a caption track: lines of documents as cues of WebVTT (even ids) or as segments of JSON events (odd ids)."""
    d = table(spark, sf, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("<c>"), s, F.lit("</c> &amp; more"))).otherwise(s)).alias("l"))
    at = F.lit("00:00:01.000 --> 00:00:02.000\n")
    track = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("l", lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), at, F.replace(s, F.lit("\n"), F.lit(" ")))), "\n\n"))
    events = F.to_json(F.struct(F.transform("l", lambda s: F.struct(F.array(F.struct(s.alias("utf8"))).alias("segs"))).alias("events")))
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, captions.vtt(track)).otherwise(captions.json3(events)).alias("caption"))


_HOURS = " ".join(f"WHEN '{k}' THEN {h}" for k, h in lifecycle.HOURS.items() if k != "default")


@query(
    f"""WITH e AS (SELECT event_id, ['active', 'cooling', 'reopened', 'closed'][event_id % 4 + 1] AS status, ['policy', 'Legal', 'product', 'breaking', 'other', NULL][event_id % 6 + 1] AS named, ['launch', 'sue', 'investigate', 'plan', ''][event_id % 5 + 1] AS action,
  CASE WHEN event_id % 7 <> 0 THEN ts - to_hours((value * 10)::INT) END AS updated, ts AS seen FROM events), m AS (SELECT max(ts) AS t FROM events),
 k AS (SELECT *, CASE WHEN lower(named) IN ('policy', 'legal', 'product', 'breaking') THEN lower(named) WHEN action = 'launch' THEN 'product' WHEN action IN ('sue', 'investigate') THEN 'legal' ELSE 'default' END AS kind FROM e),
 j AS (SELECT *, CASE kind {_HOURS} ELSE {lifecycle.HOURS["default"]} END AS hours, epoch(t) - epoch(coalesce(updated, seen)) AS age FROM k, m)
 SELECT event_id, status, CASE WHEN status = 'reopened' THEN 'active' WHEN status = 'active' AND age >= hours * 3600 THEN 'cooling' WHEN status = 'cooling' AND age >= hours * 7200 THEN 'closed' ELSE status END AS next_status, CASE WHEN status = 'reopened' THEN 'reopen acknowledged by lifecycle tick'
  WHEN status = 'active' AND age >= hours * 3600 THEN 'no material update for ' || hours || 'h' WHEN status = 'cooling' AND age >= hours * 7200 THEN 'no material update for ' || 2 * hours || 'h' END AS reason FROM j"""
)
def lifecycle_ticks(spark, sf):
    """Lifecycle of events under a time to live by type: reopened to active, active to cooling, cooling to closed, with the reason."""
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    e = table(spark, sf, "events")
    e = e.select("event_id", pick("active", "cooling", "reopened", "closed").alias("status"), pick("policy", "Legal", "product", "breaking", "other", None).alias("named"), pick("launch", "sue", "investigate", "plan", "").alias("action"),
                 F.when(F.col("event_id") % 7 != 0, F.col("ts") - F.make_dt_interval(hours=F.rint(F.col("value") * 10).cast("int"))).alias("updated"), F.col("ts").alias("seen"))
    return lifecycle.ticked(e, e.agg(F.max("seen")).scalar()).select("event_id", "status", "next_status", "reason")
