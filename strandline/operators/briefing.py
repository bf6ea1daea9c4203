"""Briefing cards of the most important events, and the text that is made of them without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import upkeep
from strandline.functions.captions import unescaped

# Events of a briefing, cards of each section, the least importance of an event that is more than later reading.
EVENTS, CARDS, LEAST_IMPORTANCE = 12, {"need_to_know": 4, "brewing": 4, "later": 5}, 30
# Sentences of cards and of the text.
WHY_THREE, WHY_TWO, WHY_LANE, WHY_ELSE = "已有多个独立来源互相确认，优先级上升。", "已有两个独立来源出现相近信号，值得提前留意。", "匹配高优先级主题，可能影响后续判断。", "综合评分较高，适合纳入本小时观察。"
LANES = ("must_read", "policy", "ai", "finance")
MISSING_TEXT, MISSING_SOURCE, MISSING_OFFICIAL = "正文或信源质量还不足，需要更多细节确认。", "目前仍偏单源，需要独立来源跟进。", "后续还需要观察是否有一手材料或官方确认。"
BYLINE = r"^[A-Za-z][A-Za-z0-9 .&/'()_-]{1,80}:\s*"
DOUBLE_BYLINE = r"^[A-Za-z][A-Za-z0-9 .&/'()_-]{1,80}\s*/\s*[A-Za-z][A-Za-z0-9 .&/'()_-]{1,80}:\s*"
UNNAMED, HAPPENED, SIGNAL = "未命名事件", "本小时出现新的相关信号。", "出现新的报道或材料。"
LEAD, NO_LEAD = "一句话：过去一小时真正值得注意的是，{0}。", "一句话：过去一小时没有足够重要、增量明确且可信的新增事件。"
HEADINGS = {"need_to_know": "### 需要你现在知道", "brewing": "### 正在发酵", "later": "### 可稍后看"}
NONE = {"need_to_know": "本小时没有达到“需要现在知道”阈值的事件。\n", "brewing": "暂无需要持续跟踪但尚未确认的明显信号。\n", "later": "暂无高分但不紧急的补充素材。"}


def shortened(text: Column, most: int = 300) -> Column:
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def why(sources: Column, lane: Column) -> Column:
    return F.when(sources >= 3, WHY_THREE).when(sources == 2, WHY_TWO).when(lane.isin(*LANES), WHY_LANE).otherwise(WHY_ELSE)


def missing(sources: Column, sure: Column) -> Column:
    return F.when(sure < 55, MISSING_TEXT).when(sources < 2, MISSING_SOURCE).otherwise(MISSING_OFFICIAL)


def cards(events: DataFrame, items: DataFrame, limit: int = EVENTS) -> DataFrame:
    """A card of each of the `limit` most important events: rank, event, section, id, n_contents, sources, title, what_happened, why, new_signal, missing and the scores.

    events: event, importance, incremental, confidence, independent (sources), tier. items: event, id, score, source_id, title, summary,
    lane. The limit is the feature and bounds what is broadcast. Of an event's items the best by score (ties: smaller id)
    speaks for it; they are aggregated by event and source, then by event, never listed; its sources are, best item first. Nulls count as empty; events without items
    have no card.
    """
    top = events.orderBy(F.desc("importance"), "event").limit(limit)
    met = items.join(F.broadcast(top.select("event")), "event")
    best = F.struct(-F.coalesce("score", F.lit(0.0)), "id")
    name = F.coalesce("source_id", F.lit("Unknown"))
    each = met.groupBy("event", name.alias("name")).agg(F.min_by(F.struct("id", "title", "summary", "lane"), best).alias("p"), F.min(best).alias("best"), F.count("*").alias("n"))
    said = each.groupBy("event").agg(F.min_by("p", "best").alias("p"), F.sum("n").alias("n_contents"), F.array_sort(F.collect_list(F.struct("best", "name"))).alias("names"))
    e = top.join(said, "event").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "event")))
    section = F.when(F.col("importance") < LEAST_IMPORTANCE, "later").otherwise(upkeep.section(F.col("importance"), F.col("incremental"), F.col("confidence"), F.col("tier")))
    summary, title = shortened(F.col("p.summary")), F.trim(F.coalesce("p.title", F.lit("")))
    or_else = lambda text, other: F.when(text == "", other).otherwise(text)
    return e.select(
        "rank", "event", section.alias("section"), F.col("p.id").alias("id"), "n_contents", F.array_join(F.transform("names", lambda n: n["name"]), "、").alias("sources"), or_else(title, UNNAMED).alias("title"),
        or_else(summary, HAPPENED).alias("what_happened"), why(F.col("independent"), F.col("p.lane")).alias("why"), or_else(summary, SIGNAL).alias("new_signal"), missing(F.col("independent"), F.col("confidence")).alias("missing"),
        F.round("importance", 1).alias("importance"), "incremental", "confidence",
    )


def link(c) -> Column:
    return F.concat(F.lit("["), c["title"], F.lit("](/reader/"), c["id"].cast("string"), F.lit(")"))


def cleaned(c: Column) -> Column:
    """Text in one line without the name of an agency or author in front."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), BYLINE, ""), DOUBLE_BYLINE, ""))


def text(made: DataFrame, title: str) -> DataFrame:
    """One row, briefing: the text of at most EVENTS cards, by section in the order of their rank; without cards, the sentences for none."""
    said = unescaped(F.array("title", "what_happened", "new_signal"))
    made = made.withColumn("said", said).withColumns({n: cleaned(F.get("said", F.lit(i))) for i, n in enumerate(("title", "what_happened", "new_signal"))})
    a = made.agg(F.array_sort(F.collect_list(F.struct("rank", "section", "id", "sources", "title", "what_happened", "why", "new_signal", "missing", "importance"))).alias("c"))
    part = lambda s: F.slice(F.filter("c", lambda c: c["section"] == s), 1, CARDS[s]).alias(s)
    a = a.select(*map(part, CARDS))
    told = {
        "need_to_know": lambda c: F.concat(F.lit("**"), link(c), F.lit("**\n发生了什么："), c["what_happened"], F.lit("\n为什么重要："), c["why"], F.lit("\n来源："), c["sources"], F.lit("；本地阅读："), link(c), F.lit("\n")),
        "brewing": lambda c: F.concat(F.lit("**"), link(c), F.lit("**\n新信号："), c["new_signal"], F.lit("\n还缺什么确认："), c["missing"], F.lit("\n")),
        "later": lambda c: F.concat(F.lit("- "), link(c), F.lit("（"), c["sources"], F.lit("，重要性 "), F.regexp_replace(c["importance"].cast("string"), r"\.0$", ""), F.lit("）")),
    }
    first = F.coalesce(F.get("need_to_know", F.lit(0))["title"], F.get("brewing", F.lit(0))["title"])
    before, after = LEAD.split("{0}")
    lead = F.when(first.isNull(), NO_LEAD).otherwise(F.concat(F.lit(before), first, F.lit(after)))
    blocks = [F.concat(F.lit(f"{HEADINGS[s]}\n\n"), F.when(F.size(s) == 0, NONE[s]).otherwise(F.array_join(F.transform(s, told[s]), "\n"))) for s in CARDS]
    return a.select(F.trim(F.concat_ws("\n", F.lit(f"## {title}\n"), F.concat(lead, F.lit("\n")), *blocks)).alias("briefing"))
