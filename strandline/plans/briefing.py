"""Registered queries of score explanation and briefings, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import explain, rules
from strandline.functions import vocabulary as v
from strandline.operators import briefing
from strandline.plans import upkeep
from strandline.plans.catalog import ORACLE, query
from strandline.plans.rules import _RULES, has, q, rule_scored
from strandline.sources.views import headlines


def _found(terms, most: int) -> str:
    return f"array_to_string(list_filter([{', '.join(map(q, terms))}], lambda t: contains(head, t))[1:{most}], '|')"


_EVENTS = ", ".join(f"CASE WHEN {has('head', t)} THEN {q(f'{n}+{b}=')} || {_found(t, explain.EVENT_TERMS)} END" for n, (b, t) in v.EVENTS.items())
_CAPPED = ", ".join(f"CASE WHEN sc.scope = '{n}' AND rs.{d} < {d_} THEN '{d}<={c}' END" for n, cs in v.CAPS.items() for d, c in cs.items() for d_ in [{"salience": "sal0", "reach": "reach0", "depth": "depth0"}[d]])


@query(
    f"""WITH {_RULES} SELECT id, sc.scope, {", ".join(f"{_found([t.strip() for t in terms], explain.TERMS)} AS {n}" for n, terms in explain.SIGNALS.items())},
 array_to_string(list_filter([{", ".join(map(q, explain.entities()))}], lambda t: contains(head, substr(t, 3)))[1:{explain.ENTITIES}], '|') AS entities, array_to_string(list_filter([{_EVENTS}], lambda t: t IS NOT NULL), ';') AS events,
 CASE WHEN {has("head", v.DISASTERS)} AND {has("low", v.SEVERAL_PLACES)} THEN CASE WHEN {has("low", v.CASUALTIES)} THEN 'systemic' ELSE 'sector' END {" ".join(f"WHEN {has('head', v.REACH[n])} THEN '{n}'" for n in ("systemic", "sector", "local"))} ELSE 'entity' END AS reach_level,
 array_to_string(list_filter([{_CAPPED}], lambda t: t IS NOT NULL), '|') AS caps, {", ".join(f"round(rs.{d} * {w}::DOUBLE, 3) AS {d}_part" for d, w in explain.WEIGHTS.items())},
 round({" + ".join(f"round(rs.{d} * {w}::DOUBLE, 3)" for d, w in explain.WEIGHTS.items())}, 3) AS total, rs.score, round(rs.score - CASE WHEN id % 4 <> 0 THEN (50 + id % 7)::DOUBLE END, 2) AS delta FROM rs JOIN sc USING (id)"""
)
def score_explanations(spark, sf):
    """Terms found in a headline by list, tier and event type, reach, caps that took effect, what each dimension adds, and the difference from the score that was stored.

    Lane scores and terms of users are not told.
    """
    h = rule_scored(spark, sf).withColumns({"head": rules.headline(F.col("title"), F.col("summary")), "low": F.lower("title")})
    parts = {f"{d}_part": explain.weighted(d) for d in explain.WEIGHTS}
    stored = F.when(F.col("id") % 4 != 0, (50 + F.col("id") % 7).cast("double"))
    h = h.withColumns(parts)
    total = sum((F.col(p) for p in list(parts)[1:]), F.col("salience_part"))
    signals = [explain.found(F.col("head"), [t.strip() for t in terms], explain.TERMS).alias(n) for n, terms in explain.SIGNALS.items()]
    return h.select("id", "scope", *signals, explain.entity_hits(F.col("head")).alias("entities"), explain.event_hits(F.col("head")).alias("events"), explain.reach_level(F.col("low"), F.col("head")).alias("reach_level"),
                    explain.caps_applied(F.col("scope")).alias("caps"), *parts, F.round(total, 3).alias("total"), "score", F.round(F.col("score") - stored, 2).alias("delta"))


_LATE = "{c} = '' THEN {o} ELSE {c} END"
_SHORT = "CASE WHEN length(trim(coalesce(summary, ''))) > 300 THEN substr(trim(summary), 1, 297) || '...' ELSE trim(coalesce(summary, '')) END"
_CARDS = f"""{ORACLE["event_sections"].split(" SELECT event, confidence, round(least(100")[0]}, sx AS (SELECT *, round(least(100, greatest(0, inc))::DOUBLE, 1) AS incremental,
  CASE WHEN best < {briefing.LEAST_IMPORTANCE} THEN 'later' WHEN best >= 70 AND inc >= 45 AND confidence >= 55 THEN 'need_to_know' WHEN inc >= 45 OR sources < 2 THEN 'brewing' ELSE 'later' END AS section FROM f),
 tp AS (SELECT *, row_number() OVER (ORDER BY best DESC, event) AS rank FROM sx QUALIFY rank <= {briefing.EVENTS}),
 im AS (SELECT cc.event, cc.id, cc.source_id, title, {_SHORT} AS s, row_number() OVER (PARTITION BY cc.event ORDER BY cc.score DESC, cc.id) AS r FROM cc JOIN h USING (id) WHERE cc.event IN (SELECT event FROM tp)),
 sn AS (SELECT event, sum(n)::BIGINT AS n_contents, string_agg(name, '、' ORDER BY r) AS names FROM (SELECT event, coalesce(source_id, 'Unknown') AS name, min(r) AS r, count(*) AS n FROM im GROUP BY ALL) GROUP BY 1),
 cd AS (SELECT rank, event, section, id, n_contents, names AS sources, CASE WHEN trim(coalesce(title, '')) = '' THEN '{briefing.UNNAMED}' ELSE trim(title) END AS title, CASE WHEN s = '' THEN '{briefing.HAPPENED}' ELSE s END AS what_happened,
  CASE WHEN tp.sources >= 3 THEN '{briefing.WHY_THREE}' WHEN tp.sources = 2 THEN '{briefing.WHY_TWO}' WHEN id % 4 = 0 THEN '{briefing.WHY_LANE}' ELSE '{briefing.WHY_ELSE}' END AS why, CASE WHEN s = '' THEN '{briefing.SIGNAL}' ELSE s END AS new_signal,
  CASE WHEN confidence < 55 THEN '{briefing.MISSING_TEXT}' WHEN tp.sources < 2 THEN '{briefing.MISSING_SOURCE}' ELSE '{briefing.MISSING_OFFICIAL}' END AS missing, round(best, 1) AS importance, incremental, confidence FROM tp JOIN im USING (event) JOIN sn USING (event) WHERE r = 1)"""


def _made(spark, sf):
    e = upkeep.events_with_sections(spark, sf)
    top = e.select("event", F.col("best").alias("importance"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "incremental")), 1).alias("incremental"), "confidence", F.col("sources").alias("independent"), "tier")
    i = F.col("id")
    items = rule_scored(spark, sf).select("id", F.concat(F.lit("e"), i % 30).alias("event"), "score", "source_id", "title", "summary", F.when(i % 4 == 0, "policy").otherwise("other").alias("lane"))
    return briefing.cards(top, items)


@query(f"{_CARDS} SELECT * FROM cd")
def briefing_cards(spark, sf):
    """A card of each of the twelve most important events, spoken for by its best item."""
    return _made(spark, sf)


_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), {1}, ''))"


def _clean(c: str) -> str:
    return _CLEAN.format(c, q(briefing.BYLINE))


_LINK = f"'[' || {_clean('title')} || '](/reader/' || id || ')'"
_TOLD = {
    "need_to_know": f"'**' || {_LINK} || '**' || chr(10) || '发生了什么：' || {_clean('what_happened')} || chr(10) || '为什么重要：' || why || chr(10) || '来源：' || sources || '；本地阅读：' || {_LINK} || chr(10)",
    "brewing": f"'**' || {_LINK} || '**' || chr(10) || '新信号：' || {_clean('new_signal')} || chr(10) || '还缺什么确认：' || missing || chr(10)",
    "later": f"'- ' || {_LINK} || '（' || sources || '，重要性 ' || regexp_replace(importance::VARCHAR, '\\.0$', '') || '）'",
}
_BLOCKS = " || chr(10) || ".join(f"{q(briefing.HEADINGS[s])} || chr(10) || chr(10) || coalesce((SELECT string_agg({told}, chr(10) ORDER BY rank) FROM pos WHERE section = '{s}' AND place <= {briefing.CARDS[s]}), {q(briefing.NONE[s])})" for s, told in _TOLD.items())


@query(
    f"""{_CARDS}, pos AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank) AS place FROM cd), ld AS (SELECT {_clean("title")} AS t FROM pos WHERE section <> 'later' ORDER BY section = 'brewing', rank LIMIT 1)
 SELECT trim('## 每小时快报' || chr(10) || chr(10) || coalesce((SELECT {q(briefing.LEAD.split("{0}")[0])} || t || {q(briefing.LEAD.split("{0}")[1])} FROM ld), {q(briefing.NO_LEAD)}) || chr(10) || chr(10) || {_BLOCKS}) AS briefing"""
)
def briefing_text(spark, sf):
    """The briefing of the cards as text, by section."""
    return briefing.text(_made(spark, sf), "每小时快报")
