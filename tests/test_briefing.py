"""Explanation of scores and briefings on rows written by hand."""

from pyspark.sql import functions as F

from strandline.functions import explain
from strandline.operators import briefing

EVENT = "event string, importance double, incremental double, confidence double, independent long, tier string, id string"
ITEM = "event string, id long, score double, source_id string, title string, summary string, lane string, rank string"


def test_terms_events_and_reach(spark):
    df = spark.createDataFrame([("nato summit: flood, 3 killed in several provinces",), ("%s" % " ".join(t for t in explain.v.COMMERCE),), ("",)], "head string")
    got = df.select(explain.found(F.col("head"), explain.v.COMMERCE, 12).alias("c"), explain.entity_hits(F.col("head")).alias("e"), explain.event_hits(F.col("head")).alias("v"), explain.reach_level(F.col("head"), F.col("head")).alias("r")).collect()
    assert got[0].c == "" and got[0].e == "S:nato" and got[0].v == "summit_visit+1.0=summit;disaster_casualty+1.5=killed" and got[0].r == "sector"
    assert got[1].c.split("|") == list(explain.v.COMMERCE[:12]) and tuple(got[2]) == ("", "", "", "entity")


def test_cards_and_text(spark):
    events = [("a", 90.0, 91.0, 80.0, 2, "moderate", "x"), ("b", 60.0, 72.0, 50.0, 1, "single_low", "x"), ("c", 20.0, 91.0, 90.0, 3, "moderate", "x"), ("d", 89.0, 0.0, 0.0, 0, None, "x"), *((f"z{i:02}", 10.0, 0.0, 60.0, 2, "moderate", "x") for i in range(20))]
    items = [("a", 1, 5.0, "s1", "Low", "no", "other", ""), ("a", 3, 9.0, "s2", " Acme: Flood &amp; rain ", "x" * 400, "policy", ""), ("a", 2, 9.0, None, "Reuters: Flood &amp;\n rain", "y" * 301, None, ""), ("a", 2, 9.0, None, "Reuters: Flood &amp;\n rain", "y" * 301, None, ""),
             ("b", 4, None, "s1", None, None, "ai", ""), ("c", 5, 1.0, "s1", "Later", "s", "", ""), ("unknown", 6, 1.0, "s1", "t", "s", "", "")]
    items += [(f"z{i:02}", 100 + i, 1.0, "s1", f"Z{i}", "s", "", "") for i in range(20)]
    made = briefing.cards(spark.createDataFrame(events, EVENT), spark.createDataFrame(items, ITEM))
    got = {r.event: r for r in made.collect()}
    assert set(got) == {"a", "b", "c", *(f"z{i:02}" for i in range(8))} and len(got) == 11  # d is among the twelve, but has no items
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.rank, a.section, a.id, a.n_contents, a.sources, a.why) == (1, "need_to_know", 2, 4, "Unknown、s2、s1", briefing.WHY_TWO) and a.what_happened == "y" * 297 + "..."
    assert (b.section, b.title, b.what_happened, b.new_signal, b.why, b.missing) == ("brewing", briefing.UNNAMED, briefing.HAPPENED, briefing.SIGNAL, briefing.WHY_LANE, briefing.MISSING_TEXT)
    assert c.section == "later" and c.why == briefing.WHY_THREE
    text = briefing.text(made, "T").first().briefing.split("\n")
    assert text[:4] == ["## T", "", briefing.LEAD.format("Flood & rain"), ""] and text[4:7] == [briefing.HEADINGS["need_to_know"], "", "**[Flood & rain](/reader/2)**"]
    assert f"还缺什么确认：{briefing.MISSING_TEXT}" in text and text[-5:] == ["- [Later](/reader/5)（s1，重要性 20）", *(f"- [Z{i}](/reader/{100 + i})（s1，重要性 10）" for i in range(4))]
    none = briefing.text(made.where("false"), "T").first().briefing
    assert none.split("\n")[2] == briefing.NO_LEAD and all(n.strip() in none for n in briefing.NONE.values())
