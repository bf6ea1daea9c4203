"""Registered queries of the rule score, text quality, tokens, keyword rules and event signatures, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import rules, signatures
from strandline.functions import vocabulary as v
from strandline.operators import keywords
from strandline.plans.catalog import query
from strandline.sources.views import HEADLINES, headlines


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def has(column: str, terms) -> str:
    return f"regexp_matches({column}, {q(rules.any_of(terms))})"


def _entity(column: str, terms) -> str:
    return f"regexp_matches({column}, {q(rules.any_entity(terms))})"


_PARTS = r"list_filter(regexp_split_to_array(regexp_replace({0}, '([.!?。！？])\s+', '\1' || chr(10) || chr(10), 'g'), '\n{{2,}}'), lambda p: length(trim(regexp_replace(p, '\s+', ' ', 'g'))) >= 40)"


def _paragraphs(column: str) -> str:
    parts = f"len({_PARTS.format(column)})"
    return f"CASE WHEN {parts} > 0 THEN {parts} WHEN length({column}) >= 80 THEN 1 ELSE 0 END"


def _clean(column: str) -> str:
    out = rf"regexp_replace(regexp_replace(coalesce({column}, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')"
    for name, value in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&hellip;", "...")):
        out = f"replace({out}, '{name}', '{value}')"
    return f"trim({out})"


_QUALITY = f"""{HEADLINES}, t AS (SELECT *, {_clean("title")} AS t_title, {_clean("body")} AS t_body, {_clean("summary")} AS t_summary FROM h),
 p AS (SELECT *, {_paragraphs("t_body")} AS paragraphs FROM t),
 st AS (SELECT *, CASE WHEN length(t_body) >= 1200 AND paragraphs >= 3 THEN 'full' WHEN length(t_body) >= 400 OR length(t_body) >= 220 AND paragraphs >= 2 THEN 'partial'
  WHEN length(t_summary) >= 50 THEN 'summary_only' WHEN length(t_title) > 0 THEN 'title_only' ELSE 'blocked' END AS status,
  least(1.0, length(t_body) / 1600.0) AS size, least(1.0, paragraphs / 5.0) AS parts, least(1.0, length(t_summary) / 300.0) * 0.45 AS brief FROM p),
 ql AS (SELECT *, round(CASE status WHEN 'full' THEN greatest(0.78, 0.65 * size + 0.35 * parts) WHEN 'partial' THEN greatest(0.45, least(0.74, 0.55 * size + 0.35 * parts + 0.10 * brief))
  WHEN 'summary_only' THEN greatest(0.24, least(0.48, brief)) WHEN 'title_only' THEN 0.12 ELSE 0.0 END::DOUBLE, 3) AS quality FROM st)"""


def qualified(spark, sf):
    """Headlines with the status and quality of their texts; every text is cleaned once, in a projection of its own."""
    h = headlines(spark, sf)
    h = h.withColumns({f"t_{c}": rules.clean(F.col(c)) for c in ("title", "body", "summary")})
    h = h.withColumn("t_paragraphs", rules.paragraph_count(F.col("t_body"), folded=True))
    status, quality = rules.text_status(F.col("t_title"), F.col("t_body"), F.col("t_summary"), paragraphs=F.col("t_paragraphs"))
    return h.withColumn("status", status).withColumn("quality", quality(F.col("status"))).drop("t_title", "t_body", "t_summary", "t_paragraphs")


@query(f"WITH {_QUALITY} SELECT id, status, quality FROM ql")
def content_quality(spark, sf):
    """Availability of every text and its quality."""
    return qualified(spark, sf).select("id", "status", "quality")


_LOW = "lower(substr(title || ' ' || coalesce(summary, ''), 1, 600))"
_EVENT = ", ".join(f"CASE WHEN {has('head', t)} THEN {a} ELSE 0.0 END" for a, t in v.EVENTS.values())
_BONUS = " ".join(f"WHEN '{k}' THEN {v.AUTHORITY_BONUS[n]}" for k, n in {**{k: k for k in v.AUTHORITY_BONUS}, **v.AUTHORITY_NAMES}.items())


def _cap(dimension: str, expression: str) -> str:
    return f"CASE scope {' '.join(f'''WHEN '{n}' THEN round(least({expression}, {c[dimension]}), 1)''' for n, c in v.CAPS.items())} ELSE {expression} END"


_RULES = f"""{_QUALITY}, hd AS (SELECT *, {_LOW} AS head, lower(title) AS low FROM ql),
 sc AS (SELECT *, CASE WHEN {has("head", v.EXEMPT)} THEN NULL WHEN {has("low", v.COMMERCE)} OR {has("head", v.COMMERCE)} THEN 'commerce' WHEN {has("low", v.NARROW)} OR {has("head", v.NARROW)} THEN 'narrow' END AS scope,
  round(least(10.0, greatest(CASE WHEN {_entity("head", v.TIERS["S"])} THEN 9.0 WHEN {_entity("head", v.TIERS["A"])} THEN 7.5 WHEN {_entity("head", v.TIERS["B"])} THEN 6.0 ELSE 4.0 END + greatest({_EVENT}),
   CASE WHEN {has("low", v.DISASTERS)} AND {has("low", v.CASUALTIES)} THEN 9.0 WHEN {has("head", v.DISASTERS)} AND {has("head", v.CASUALTIES)} THEN 8.5 WHEN {has("head", v.DISASTERS)} THEN 7.5 ELSE 0.0 END))::DOUBLE, 1) AS sal0,
  CASE WHEN {has("head", v.DISASTERS)} AND {has("low", v.SEVERAL_PLACES)} AND {has("low", v.CASUALTIES)} THEN 9.0 WHEN {has("head", v.DISASTERS)} AND {has("low", v.SEVERAL_PLACES)} THEN 7.0
   WHEN {has("head", v.REACH["systemic"])} THEN 9.0 WHEN {has("head", v.REACH["sector"])} THEN 7.0 WHEN {has("head", v.REACH["local"])} THEN 3.5 WHEN {has("head", v.TIERS["S"])} THEN 6.5 ELSE 5.5 END::DOUBLE AS reach0,
  round(least(10.0, CASE greatest(1, least(3, coalesce(stars, 1))) WHEN 1 THEN 4.0 WHEN 2 THEN 6.5 ELSE 8.5 END + CASE lower(trim(kind)) {_BONUS} ELSE 0.0 END)::DOUBLE, 1) AS authority,
  round(least(10.0, least(4.0, 0.8 * ({_paragraphs("trim(body)")})) + least(4.0, 0.15 * length(regexp_replace(body, '[^0-9]', '', 'g')) + 0.4 * (2 * length(regexp_replace(body, '[^"]', '', 'g')) + length(regexp_replace(body, '[^'']', '', 'g')) + length(regexp_replace(body, '[^「]', '', 'g'))))
   + CASE WHEN content_type = 'x' THEN 2.0 WHEN status = 'full' THEN 1.0 ELSE 0.0 END)::DOUBLE, 1) AS depth0 FROM hd),
 dm AS (SELECT id, source_id, scope, status, {_cap("salience", "sal0")} AS salience, {_cap("reach", "reach0")} AS reach, authority, {_cap("depth", "depth0")} AS depth,
  round((0.65::DOUBLE * CASE status {" ".join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in v.STATUS_CONFIDENCE.items())} END + 0.35::DOUBLE * quality)::DOUBLE, 3) AS confidence FROM sc),
 rs AS (SELECT *, round((0.30::DOUBLE * salience + 0.25::DOUBLE * reach + 0.25::DOUBLE * authority + 0.20::DOUBLE * depth) * 10, 2) AS score FROM dm)"""


def rule_scored(spark, sf):
    """Headlines with all dimensions of the rule score, capped, the score and its confidence."""
    h = qualified(spark, sf).withColumns({"head": rules.headline(F.col("title"), F.col("summary")), "low": F.lower("title"), "text": F.trim("body")})
    h = h.withColumns({**rules.hits(F.col("low"), F.col("head")), "facts": rules.facts(F.col("text")), "paragraphs": rules.paragraph_count(F.col("text"))})
    h = h.withColumn("scope", rules.cap_scope())
    dims = {"salience": rules.salience(F.col("head")), "reach": rules.reach(), "depth": rules.depth(F.col("paragraphs"), F.col("facts"), F.col("status"), F.col("content_type"))}
    h = h.withColumns(dims).withColumns({f"{k}_before": F.col(k) for k in dims})
    h = h.withColumns({k: rules.capped(F.col(k), k, F.col("scope")) for k in dims}).withColumn("authority", rules.authority(F.col("stars"), F.col("kind")))
    h = h.drop(*rules.HITS, "head", "low", "text", "facts", "paragraphs")
    total = 0.30 * F.col("salience") + 0.25 * F.col("reach") + 0.25 * F.col("authority") + 0.20 * F.col("depth")
    return h.withColumns({"score": F.round(total * 10, 2), "confidence": rules.confidence(F.col("status"), F.col("quality"))})


@query(f"WITH {_RULES} SELECT id, scope, salience, reach, authority, depth, confidence, score, CASE WHEN score >= 70 AND confidence >= 0.65 THEN 'selected' WHEN score >= 55 THEN 'candidate' ELSE 'rejected' END AS selection FROM rs")
def rule_scores(spark, sf):
    """Dimensions with vocabularies and caps, article score, confidence and selection."""
    h = rule_scored(spark, sf)
    return h.select("id", "scope", "salience", "reach", "authority", "depth", "confidence", "score", rules.selection(F.col("score"), F.col("confidence")).alias("selection"))


_EVENT_KEY = "CASE WHEN id % 5 = 0 THEN 'e' || (id % 40) ELSE 'x' || (id % 7) || coalesce(rs.source_id, '') END"


@query(
    f"""WITH {_RULES}, m AS (SELECT rs.*, {_EVENT_KEY} AS event, coalesce(h.publish_time, h.fetched_at) AS seen, h.stars, h.kind, h.title AS group_title FROM rs JOIN h USING (id)),
 n AS (SELECT max(seen) AS newest FROM m),
 d AS (SELECT event, count(DISTINCT source_id) AS independent FROM (SELECT event, group_title, min(id) AS id FROM m GROUP BY ALL) JOIN (SELECT id, source_id FROM m) USING (id) GROUP BY event),
 e AS (SELECT event, count(*) AS size, count(*) FILTER (WHERE seen >= newest - INTERVAL 6 HOUR) AS recent, max(score) AS best, max(greatest(1, least(3, coalesce(stars, 1)))) AS stars, bool_or(coalesce(kind = 'official', false)) AS official FROM m, n GROUP BY event),
 f AS (SELECT event, best, round(least(10.0, 2.5 * log2(1 + size) + least(2.0, 0.5 * recent))::DOUBLE, 2) AS momentum, CASE WHEN independent = 0 THEN size ELSE independent END AS independent, stars, official FROM e JOIN d USING (event)),
 g AS (SELECT *, CASE WHEN independent >= 3 THEN 9.0 WHEN independent = 2 THEN 6.5 WHEN independent = 1 AND (stars >= 3 OR official) THEN 5.5 ELSE 2.5 END AS points,
  CASE WHEN independent >= 3 THEN 'strong' WHEN independent = 2 THEN 'moderate' WHEN independent = 1 AND (stars >= 3 OR official) THEN 'single_high' ELSE 'single_low' END AS tier FROM f)
 SELECT event, momentum, independent, tier, round(least(100.0, 0.50 * best + 3.0 * momentum + 2.0 * points)::DOUBLE + 1e-9, 2) AS event_score FROM g"""
)
def event_ranking(spark, sf):
    """Event score of best article, momentum of the last six hours, and independent sources, each group of equal titles once."""
    key = F.when(F.col("id") % 5 == 0, F.concat(F.lit("e"), F.col("id") % 40)).otherwise(F.concat(F.lit("x"), F.col("id") % 7, F.coalesce("source_id", F.lit(""))))
    m = rule_scored(spark, sf).select("id", "source_id", "title", "stars", "kind", "score", key.alias("event"), F.coalesce("publish_time", "fetched_at").alias("at"))
    firsts = m.groupBy("event", "title").agg(F.min_by("source_id", "id").alias("source_id"))
    independent = firsts.groupBy("event").agg(F.count_distinct("source_id").alias("independent"))
    now = m.agg(F.max("at")).scalar()
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("stars", F.lit(1))))
    e = m.groupBy("event").agg(
        F.count("*").alias("size"), F.count_if(F.col("at") >= now - F.expr("interval 6 hours")).alias("recent"), F.max("score").alias("best"), F.max(level).alias("stars"), F.bool_or(F.coalesce(F.col("kind") == "official", F.lit(False))).alias("official")
    ).join(independent, "event")
    e = e.withColumns({"momentum": rules.momentum(F.col("size"), F.col("recent")), "independent": F.when(F.col("independent") == 0, F.col("size")).otherwise(F.col("independent"))})
    points, tier = rules.corroboration(F.col("independent"), F.col("stars"), F.col("official"))
    score = F.round(F.least(F.lit(100.0), 0.50 * F.col("best") + 3.0 * F.col("momentum") + 2.0 * points) + 1e-9, 2)  # halves up
    return e.select("event", "momentum", "independent", tier.alias("tier"), score.alias("event_score"))


_GRAMS = "CASE WHEN length(han) >= {0} THEN list_transform(range(1, length(han) - {0} + 2), lambda i: substr(han, i, {0})) ELSE [] END"
_ANCHORS = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{a}') THEN 'sem:{b}' END" for a, b in v.ANCHORS) + "], lambda x: x IS NOT NULL)"
_TOKENS = rf"""tk AS (SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS low, regexp_replace(lower(title), '[^\x{{4e00}}-\x{{9fff}}]', '', 'g') AS han FROM h),
 tn AS (SELECT *, list_distinct(regexp_extract_all(low, '[a-z0-9]{{2,}}') || {_GRAMS.format(2)} || {_GRAMS.format(3)} || {_ANCHORS}) AS tokens FROM tk)"""


@query(f"WITH {HEADLINES}, {_TOKENS} SELECT id, array_to_string(list_sort(tokens), ' ') AS tokens FROM tn")
def title_tokens(spark, sf):
    """Token set of every title."""
    return headlines(spark, sf).select("id", F.array_join(F.array_sort(rules.tokens(F.col("title"))), " ").alias("tokens"))


_BITS = "list_aggregate(list_transform(range(0, 64), lambda b: CASE WHEN list_sum(list_transform(fs, lambda x: CASE WHEN (x.h >> b) & 1 = 1 THEN x.w ELSE -x.w END)) >= 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END), 'sum')::UBIGINT"


@query(
    rf"""WITH {HEADLINES}, w AS (SELECT id, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') AS words FROM h), k AS (SELECT id, words, array_to_string(words, '') AS compact FROM w),
 f AS (SELECT id, CASE WHEN length(array_to_string(words, ' ')) >= 12 AND len(words) >= 2 THEN words || list_transform(range(1, length(compact) - 1), lambda i: substr(compact, i, 3)) ELSE [] END AS features FROM k),
 g AS (SELECT id, list_transform(features, lambda t: {{'h': ('0x' || substr(sha1(t), 1, 16))::UBIGINT, 'w': least(length(t), 8)}}) AS fs FROM f)
 SELECT id, CASE WHEN len(fs) > 0 THEN lpad(lower(to_hex({_BITS})), 16, '0') ELSE '' END AS title_fp FROM g"""
)
def title_fingerprints(spark, sf):
    """SimHash of every title, which names its default duplicate group."""
    h = headlines(spark, sf).select("id", rules.title_features(F.col("title")).alias("f"))
    return h.select("id", rules.simhash(F.col("f")).alias("title_fp"))


#: id, keyword, match type, scope, case matters, further terms.
KEYWORDS = (
    keywords.Rule(1, "NATO", "exact", "title_content", True, ("alliance",)), keywords.Rule(2, "ipo", "exact", "title", False, ()), keywords.Rule(3, "tion", "contains", "content", False, ()), keywords.Rule(4, "地震", "exact", "title", False, ("flood",)),
    keywords.Rule(5, r"v\d+\.\d+", "regex", "title_content", False, ()), keywords.Rule(6, "(a+)+b", "regex", "title_content", False, ()), keywords.Rule(7, "sanctions", "contains", "title_content", False, ("earbuds", "firmware")),
)


@query(f"WITH {HEADLINES} " + " UNION ALL ".join(keywords.sql(r, "h") for r in KEYWORDS))
def keyword_rule_hits(spark, sf):
    """hits of a table of keyword rules (type, scope, case, further terms), with the scope and term that matched first; unsafe patterns never match."""
    return keywords.hits(headlines(spark, sf), KEYWORDS)


@query(f"WITH {HEADLINES} " + r"""SELECT id, array_to_string(list_transform(list_filter(range(1, length(body) - 3), lambda i: lower(substr(body, i, 4)) = 'tion'),
 lambda i: CASE WHEN i > 11 THEN '...' ELSE '' END || substr(body, greatest(1, i - 10), i + 14 - greatest(1, i - 10)) || CASE WHEN i + 13 < length(body) THEN '...' ELSE '' END), '|') AS snippets FROM h""")  # fmt: skip
def match_snippets(spark, sf):
    """Ten characters on either side of every hit of a term."""
    return headlines(spark, sf).select("id", F.array_join(keywords.snippets(F.col("body"), "tion", 10), "|").alias("snippets"))


@query(f"WITH {HEADLINES}, {signatures.SQL} SELECT id, dates, identifiers, versions, money, percents, action, polarity, modality, place, language, entities FROM sg")
def event_signatures(spark, sf):
    """Dates, identifiers, quantities, action, modality, place, language and entities that the title and the beginning of the text name."""
    h = headlines(spark, sf).select("id", *signatures.columns(F.col("title"), F.col("summary")))
    lists = [F.array_join(c, ",").alias(c) for c in ("dates", "identifiers", "versions", "money", "percents", "entities")]
    return h.select("id", *lists, "action", "polarity", "modality", "place", "language")


@query(
    f"""WITH {HEADLINES}, {signatures.SQL}, {_TOKENS}, x AS (SELECT sg.*, tn.tokens, tn.source_id, tn.publish_time, list_filter(string_split(entities, ','), lambda e: e <> '') AS ents, string_split(dates, ',')[1] AS day FROM sg JOIN tn USING (id)),
 ev AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS size FROM x WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC) = 1),
 pr AS (SELECT a.id, b.id AS event_id, b.size, a.tokens AS ta, b.tokens AS tb, a.ents AS ea, b.ents AS eb, a.action AS aa, b.action AS ab, a.polarity AS pa, b.polarity AS pb, a.place AS la, b.place AS lb, a.modality AS ma, b.modality AS mb,
  a.identifiers AS ia, b.identifiers AS ib, a.versions AS va, b.versions AS vb, coalesce(try_strptime(nullif(a.day, ''), '%Y-%m-%d'), a.publish_time) AS da, coalesce(try_strptime(nullif(b.day, ''), '%Y-%m-%d'), b.publish_time) AS db
  FROM x a JOIN ev b ON a.id <> b.id AND len(list_intersect(a.ents, b.ents)) > 0),
 {signatures.PAIR_SQL} SELECT id, event_id, round(greatest(0.0, least(1.0, score)), 4) AS score, conflicts, threshold, CASE WHEN conflicts <> '' THEN 'unrelated' WHEN ma <> mb THEN 'event_update' WHEN score >= threshold THEN 'same_event' WHEN score >= 0.56 THEN 'related_context' ELSE 'unrelated' END AS relation FROM cl"""
)
def signature_pairs(spark, sf):
    """Every headline against the newest one of each source with which it shares an entity: score, hard conflicts, threshold, relation."""
    h = headlines(spark, sf)
    x = h.select("id", "source_id", "publish_time", rules.tokens(F.col("title")).alias("tokens"), *signatures.columns(F.col("title"), F.col("summary")))
    newest = h.where("source_id is not null").groupBy("source_id").agg(F.max("id").alias("id"), F.count("*").alias("size"))
    events = x.join(newest.select("id", "size"), "id")
    return signatures.classified(x, events)
