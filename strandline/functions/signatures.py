"""Event signatures: facts that a title and the beginning of a text name, and how near two of them are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as v
from .rules import any_of, has
from .scores import jaccard

# Patterns of the facts.
DATE = r"\b20\d{2}[-/.年](?:0?[1-9]|1[0-2])[-/.月](?:0?[1-9]|[12]\d|3[01])日?\b"
IDENTIFIER = r"(?i)\b(?:case|bill|act|flight|法案|案件|航班|编号)[\s:#-]*([A-Z]{0,5}\d[\w.-]{1,20})\b"
VERSION = r"(?i)\bv(?:ersion)?\s*(\d+(?:\.\d+){1,3})(?:[-_ ]?(alpha|beta|rc\d*))?\b"
MONEY = r"(?i)(US\$|S\$|HK\$|￥|¥|€|£|\$)\s?([\d,.]+(?:\s?(?:million|billion|万|亿))?)"
PERCENT = r"(?i)(?:^|\W)(\d+(?:\.\d+)?)\s?(?:%|％|percent|个百分点)"
ENTITY = r"[A-Za-z][A-Za-z0-9._-]{2,}|[\x{4e00}-\x{9fff}]{2,8}"
ENTITIES = 8
# Thresholds of assignment, and what size, dispersion, state, copies and aliases add to or take from them.
ATTACH, REVIEW, LOWEST, HIGHEST = 0.72, 0.56, 0.45, 0.95
SIZE_STEP, SIZE_MOST, DISPERSION_MOST = 0.015, 0.15, 0.18
STATE = {"cooling": 0.06, "closed": 0.18, "archived": 0.18}
DUPLICATE_BONUS, ALIAS_BONUS = 0.18, 0.12


def _first(low: Column, rows, value: int, default: str) -> Column:
    """The value of the first row of which the text has a term."""
    out = None
    for r in rows:
        hit = has(low, r[1])
        out = F.when(hit, r[value]) if out is None else out.when(hit, r[value])
    return out.otherwise(default)


def columns(title: Column, summary: Column) -> list[Column]:
    """dates, identifiers, versions, money, percents, entities (arrays), action, polarity, modality, place, language."""
    title = F.trim(F.coalesce(title, F.lit("")))
    text = F.trim(F.concat(title, F.lit(" "), F.substring(F.trim(F.coalesce(summary, F.lit(""))), 1, 800)))
    low = F.lower(text)
    pick = lambda x, p, g: F.regexp_extract(x, p, g)

    def found(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def day(x: Column) -> Column:
        p = F.split(x, "[-/.年月日]")
        return F.concat_ws("-", F.get(p, 0), F.lpad(F.get(p, 1), 2, "0"), F.lpad(F.get(p, 2), 2, "0"))

    versions = F.transform(found(VERSION), lambda x: F.concat(pick(x, VERSION, 1), F.when(pick(x, VERSION, 2) != "", F.concat(F.lit("-"), F.lower(pick(x, VERSION, 2)))).otherwise("")))
    money = F.transform(found(MONEY), lambda x: F.concat(pick(x, MONEY, 1), F.lit(" "), F.replace(pick(x, MONEY, 2), F.lit(","), F.lit(""))))
    words = F.transform(F.regexp_extract_all(title, F.lit(ENTITY), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"^[._-]+|[._-]+$", ""))
    words = F.filter(words, lambda x: (F.length(x) >= 2) & ~x.isin(*v.STOP_ENTITIES))
    names = F.filter(F.transform(words, lambda x: F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), "^-+|-+$", "")), lambda x: x != "")
    han = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    place = F.lit("")
    for marker, name in reversed(v.PLACES):
        place = F.when(low.contains(marker), name.lower().replace(" ", "-")).otherwise(place)
    return [
        F.array_distinct(F.transform(found(DATE), day)).alias("dates"), F.transform(found(IDENTIFIER, 1), F.upper).alias("identifiers"), versions.alias("versions"), money.alias("money"), found(PERCENT, 1).alias("percents"),
        F.slice(F.array_distinct(names), 1, ENTITIES).alias("entities"), _first(low, v.ACTIONS, 0, "").alias("action"), _first(low, v.ACTIONS, 2, "neutral").alias("polarity"),
        _first(low, v.MODALITIES, 0, "reported").alias("modality"), place.alias("place"), F.when(han > latin / 2, "zh").when(latin > 0, "en").otherwise("unknown").alias("language"),
    ]


def threshold(size: Column, dispersion: Column | float = 0.0, state: Column | None = None, duplicate: Column | None = None, alias: Column | None = None) -> Column:
    """The score from which a row is attached to an event."""
    dispersion = dispersion if isinstance(dispersion, Column) else F.lit(float(dispersion))
    out = ATTACH + F.least(F.lit(SIZE_MOST), F.greatest(F.lit(0), size - 5) * SIZE_STEP) + F.least(F.lit(DISPERSION_MOST), F.greatest(F.lit(0.0), dispersion) * 0.2)
    if state is not None:
        for name, penalty in STATE.items():
            out = out + F.when(state == name, penalty).otherwise(0.0)
    for flag, bonus in ((duplicate, DUPLICATE_BONUS), (alias, ALIAS_BONUS)):
        if flag is not None:
            out = out - F.when(flag, bonus).otherwise(0.0)
    return F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), out)), 3)


FIELDS = ("tokens", "entities", "action", "polarity", "place", "modality", "identifiers", "versions", "dates", "publish_time")


def classified(rows: DataFrame, events: DataFrame) -> DataFrame:
    """id, event_id, score, conflicts, threshold, relation of each row with each other event with which it shares an entity.

    Both have id, tokens, publish_time and the columns of columns(); events have a size. Pairs come from an equi-join on
    entities, of which a row has ENTITIES at most.
    """
    named = lambda df, out: df.select(F.col("id").alias(out), F.explode("entities").alias("entity"))
    pairs = named(rows, "id").join(named(events, "event_id"), "entity").where("id <> event_id").select("id", "event_id").distinct()
    left = rows.select("id", *[F.col(c).alias(f"a_{c}") for c in FIELDS])
    right = events.select(F.col("id").alias("event_id"), "size", *[F.col(c).alias(f"b_{c}") for c in FIELDS])
    return scored(pairs.join(left, "id").join(right, "event_id"))


def scored(p: DataFrame, known_pair: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, event_id, score, conflicts, threshold, relation of pairs with size and FIELDS of both sides, as a_ and b_.

    known_pair: pairs also have duplicate, alias, commentary (booleans), dispersion and status of the event, which then
    count for score, threshold and relation. keep: further columns of the pairs that are returned.
    """
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    when = lambda x: F.coalesce(F.try_to_timestamp(F.get(x("dates"), 0), F.lit("yyyy-MM-dd")), x("publish_time"))
    apart = F.abs(F.unix_micros(when(a)) - F.unix_micros(when(b))) / 86400e6

    def differ(c: str) -> Column:
        return (F.size(a(c)) > 0) & (F.size(b(c)) > 0) & ~F.arrays_overlap(a(c), b(c))

    def known(x) -> Column:
        return F.concat(F.transform(x("identifiers"), F.lower), F.transform(x("versions"), F.lower))

    opposite = (a("action") != "") & (b("action") != "") & (a("action") != b("action")) & F.concat_ws(" ", F.array_sort(F.array(a("polarity"), b("polarity")))).isin("negative positive")
    conflicts = F.array_compact(F.array(
        F.when(differ("identifiers"), "different_canonical_identifier"), F.when((a("place") != "") & (b("place") != "") & (a("place") != b("place")), "different_location"),
        F.when(differ("versions"), "different_version"), F.when(apart > 45, "incompatible_time"), F.when(opposite, "opposite_action"),
    ))
    overlap = F.size(F.array_intersect(a("entities"), b("entities"))) / F.greatest(F.lit(1), F.size(F.array_union(a("entities"), b("entities"))))
    same = lambda x, y: ((x != "") & (x == y)).cast("double")
    third = lambda x: F.coalesce(F.get(x("entities"), 2), F.lit(""))
    p = p.withColumns({"conflicts": conflicts, "overlap": overlap, "match": F.coalesce(F.arrays_overlap(known(a), known(b)), F.lit(False)).cast("double"), "lexical": jaccard(a("tokens"), b("tokens"))})
    structure = 0.65 * F.col("overlap") + 0.25 * same(a("action"), b("action")) + 0.10 * same(third(a), third(b))
    semantic = F.greatest("lexical", 0.65 * F.col("overlap") + 0.35 * F.col("match"))
    score = 0.45 * semantic + 0.25 * structure + 0.15 * F.coalesce(F.exp(-apart / 7.0), F.lit(0.5))
    bar = threshold(F.col("size"))
    if known_pair:
        score = score + 0.10 * F.col("duplicate").cast("double") + 0.05 * F.col("alias").cast("double")
        bar = threshold(F.col("size"), F.col("dispersion"), F.col("status"), F.col("duplicate"), F.col("alias"))
    p = p.withColumns({"raw": score - F.least(F.lit(0.8), F.size("conflicts") * 0.4), "threshold": bar})
    relation = F.when(F.size("conflicts") > 0, "unrelated")
    if known_pair:
        relation = relation.when(F.col("commentary"), "commentary").when(F.col("duplicate"), "duplicate")
    relation = relation.when(a("modality") != b("modality"), "event_update").when(F.col("raw") >= F.col("threshold"), "same_event").when(F.col("raw") >= REVIEW, "related_context").otherwise("unrelated")
    return p.select("id", "event_id", *keep, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))), 4).alias("score"), F.array_join("conflicts", ",").alias("conflicts"), "threshold", relation.alias("relation"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(rows, value: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(low, {_q(any_of(r[1]))}) THEN '{r[value]}'" for r in rows) + f" ELSE '{default}' END"


_HAN = r"[^\x{4e00}-\x{9fff}]"
#: The same columns in SQL, from a view h with title and summary; lists joined by commas.
SQL = rf"""sx AS (SELECT id, trim(coalesce(title, '')) AS t, trim(trim(coalesce(title, '')) || ' ' || substr(trim(coalesce(summary, '')), 1, 800)) AS text FROM h),
 sy AS (SELECT *, lower(text) AS low, list_transform(regexp_extract_all(text, {_q(DATE)}), lambda x: regexp_split_to_array(x, '[-/.年月日]')) AS ds,
  list_filter(list_transform(list_filter(list_transform(regexp_extract_all(t, {_q(ENTITY)}), lambda x: regexp_replace(lower(x), '^[._-]+|[._-]+$', '', 'g')), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(map(_q, v.STOP_ENTITIES))})),
   lambda x: regexp_replace(regexp_replace(x, '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> '') AS es FROM sx),
 sz AS (SELECT *, list_transform(ds, lambda p: p[1] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0')) AS dd FROM sy),
 sg AS (SELECT id, array_to_string(list_filter(dd, lambda x, i: list_position(dd, x) = i), ',') AS dates, array_to_string(list_transform(regexp_extract_all(text, {_q(IDENTIFIER)}, 1), lambda x: upper(x)), ',') AS identifiers,
  array_to_string(list_transform(regexp_extract_all(text, {_q(VERSION)}), lambda x: regexp_extract(x, {_q(VERSION)}, 1) || CASE WHEN regexp_extract(x, {_q(VERSION)}, 2) <> '' THEN '-' || lower(regexp_extract(x, {_q(VERSION)}, 2)) ELSE '' END), ',') AS versions,
  array_to_string(list_transform(regexp_extract_all(text, {_q(MONEY)}), lambda x: regexp_extract(x, {_q(MONEY)}, 1) || ' ' || replace(regexp_extract(x, {_q(MONEY)}, 2), ',', '')), ',') AS money,
  array_to_string(regexp_extract_all(text, {_q(PERCENT)}, 1), ',') AS percents, {_case(v.ACTIONS, 0, "")} AS action, {_case(v.ACTIONS, 2, "neutral")} AS polarity, {_case(v.MODALITIES, 0, "reported")} AS modality,
  CASE {" ".join(f"WHEN contains(low, '{m}') THEN '{n.lower().replace(' ', '-')}'" for m, n in v.PLACES)} ELSE '' END AS place,
  CASE WHEN length(regexp_replace(text, '{_HAN}', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / 2 THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language,
  array_to_string(list_filter(es, lambda x, i: list_position(es, x) = i)[1:{ENTITIES}], ',') AS entities FROM sz)"""

_LIST = "list_filter(string_split(lower({0}), ','), lambda x: x <> '')"
_BAR = f"round(greatest({LOWEST}, least({HIGHEST}, {ATTACH} + least({SIZE_MOST}, greatest(0, size - 5) * {SIZE_STEP})))::DOUBLE, 3)"


def pair_sql(more: str = "", bar: str = _BAR) -> str:
    """SQL from pairs pr (see the queries that use it) to cl with score, conflicts and threshold; `more` is added to the score."""
    return f"""c0 AS (SELECT *, {_LIST.format("ia")} AS il, {_LIST.format("ib")} AS ir, {_LIST.format("va")} AS vl, {_LIST.format("vb")} AS vr, abs(epoch_us(da) - epoch_us(db)) / 86400e6 AS apart FROM pr),
 c1 AS (SELECT *, array_to_string(list_filter([CASE WHEN len(il) > 0 AND len(ir) > 0 AND len(list_intersect(il, ir)) = 0 THEN 'different_canonical_identifier' END, CASE WHEN la <> '' AND lb <> '' AND la <> lb THEN 'different_location' END,
  CASE WHEN len(vl) > 0 AND len(vr) > 0 AND len(list_intersect(vl, vr)) = 0 THEN 'different_version' END, CASE WHEN apart > 45 THEN 'incompatible_time' END,
  CASE WHEN aa <> '' AND ab <> '' AND aa <> ab AND (pa = 'positive' AND pb = 'negative' OR pa = 'negative' AND pb = 'positive') THEN 'opposite_action' END], lambda x: x IS NOT NULL), ',') AS conflicts,
  len(list_intersect(ea, eb)) / greatest(1, len(list_distinct(ea || eb)))::DOUBLE AS overlap, CASE WHEN len(list_intersect(il || vl, ir || vr)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit,
  CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE ELSE 0.0 END AS lexical FROM c0),
 cl AS (SELECT *, 0.45::DOUBLE * greatest(lexical, 0.65::DOUBLE * overlap + 0.35::DOUBLE * hit) + 0.25::DOUBLE * (0.65::DOUBLE * overlap + CASE WHEN aa <> '' AND aa = ab THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN coalesce(ea[3], '') <> '' AND ea[3] = eb[3] THEN 0.10 ELSE 0 END::DOUBLE)
  + 0.15::DOUBLE * coalesce(exp(-apart / 7.0), 0.5){more} - least(0.8, 0.4 * CASE WHEN conflicts = '' THEN 0 ELSE len(string_split(conflicts, ',')) END)::DOUBLE AS score,
  {bar} AS threshold FROM c1)"""


PAIR_SQL = pair_sql()
