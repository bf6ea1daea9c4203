"""Admission, discovery, captions and lifecycle on rows written by hand and against plain models."""

import datetime
import random

from pyspark.sql import functions as F

from strandline.functions import captions
from strandline.operators import admission as ad
from strandline.operators import lifecycle

ITEM = "id long, title string, url string, source_url string, content string, html string, tags array<string>, path string"


def told(spark, title, url, source="https://www.example.org/news", content="x", html=None, tags=None):
    r = ad.reasons(spark.createDataFrame([(1, title, url, source, content, html, tags, "clash")], ITEM)).first()
    return r.format_reason, r.website_reason


LONG = "word and more " * 60


def test_formats_that_are_no_articles(spark):
    e = "https://example.org"
    assert told(spark, "Save $5: Acme promo code", f"{e}/story/acme-promo-code", content=LONG)[0] == "blocked_promotional_coupon_page"
    assert told(spark, "Acme promo code fraud explained in full", f"{e}/story/acme-promo-code", content=LONG)[0] is None
    assert told(spark, "Acme discount codes", f"{e}/x-1", content=LONG, tags=[None, " COUPON "])[0] == "blocked_promotional_coupon_page"
    assert told(spark, "Weekly", "https://www.engadget.com/the-science-news-1", content=LONG)[0] == "blocked_engadget_roundup"
    assert told(spark, "Weekly", "https://notengadget.com/the-science-news-1", content=LONG)[0] is None
    assert told(spark, "A day", f"{e}/Photo%2Dgallery/7", content=LONG)[0] == "blocked_non_article_format"
    assert told(spark, "图集：海边", f"{e}/a-7", content=LONG)[0] == "blocked_gallery_title"
    assert told(spark, "The week in pictures", f"{e}/photos/7-a", content=LONG)[0] == "blocked_gallery_title" and told(spark, "The week in pictures", f"{e}/world/7-a", content=LONG)[0] is None
    assert told(spark, None, None, None, None) == (None, None) and told(spark, "", "") == (None, None)


def test_pages_that_are_navigation(spark):
    e = "https://example.org"
    assert told(spark, "<b>My Library</b>", f"{e}/a-story-of-7-things")[1] == told(spark, "Acme: Subscribe", f"{e}/x-9-y")[1] == "blocked_navigation_title"
    assert told(spark, "Subscribers leave Acme in large numbers", f"{e}/subscribers-leave-acme-2024", content=LONG)[1] is None
    assert told(spark, "What to buy this year for a home", "https://businessinsider.com/guides/a-7", "https://www.businessinsider.com")[1] == "blocked_domain_non_article_path"
    assert told(spark, "What to buy this year for a home", "https://businessinsider.com/guides/a-7", "https://www.businessinsider.com", LONG)[1] is None
    assert told(spark, "HBR Strategy", "https://hbr.org/topics/strategy", "https://hbr.org", LONG)[1] == "blocked_section_hub_title"
    assert told(spark, "Asia", f"{e}/asia", content=LONG)[1] == "blocked_cjk_nav_pattern" and told(spark, "Asia", "https://else.net/asia", content=LONG)[1] is None
    assert told(spark, "A longer name of four", f"{e}/ai-index")[1] == "low_content_single_phrase_link" and told(spark, "A longer name of four", f"{e}/ai-index", content=LONG)[1] is None
    assert told(spark, "Two words", f"{e}/2024/1/two-words-9.html")[1] == "low_content_single_phrase_link" and told(spark, "Two 2", f"{e}/2024/1/two-words-9.html")[1] is None
    title = "A title that the text only repeats, at full length"
    assert told(spark, title, f"{e}/a-7-b-c-d-e/index", content=title + "!", html="h" * 5000)[1] == "low_content_single_phrase_link"


def test_article_urls_and_sites(spark):
    rows = [
        ("https://www.bbc.co.uk/news", "https://feeds.bbc.co.uk/x-1", True), ("https://a.co.uk/", "https://b.co.uk/x-1", False), ("https://a.org", "https://sub.a.org/story/hello", True), ("https://a.org", "https://a.org/news/hello", False),
        ("https://a.org", "https://a.org/tags-7", False), ("https://a.org", "https://a.org/", False), ("https://a.org", "https://news.google.com/rss/articles/CB", True), (None, "https://a.org/x-1", False), ("https://a.org", None, False),
        ("https://a.org", "https://user:pw@A.ORG:80/x.html?q=1", True), ("https://a.org", "https://a.org/blog/", False),
    ]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, want boolean").select("i", ad.article_url(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert [r.i for r in got if r.got != r.want] == []


def plain_discovery(links, now, most, days):
    """The rule link by link, for links that pass all that looks at one link alone."""
    out, seen, kept = [], set(), 0
    for position, url, at in links:
        if url in seen:
            out.append((position, "dropped_duplicate"))
        elif at is not None and at < now - datetime.timedelta(days=days):
            out.append((position, "dropped_stale"))
        elif kept >= most:
            out.append((position, "truncated"))
        else:
            kept += 1
            seen.add(url)
            out.append((position, "kept"))
    return out


def test_discovery_equals_a_walk_over_the_links(spark):
    rng, now = random.Random(5), datetime.datetime(2024, 2, 1)
    rows, want = [], {}
    for page in range(30):
        links = [(i, f"https://a.org/x-{rng.randrange(8)}", rng.choice([None, now, now - datetime.timedelta(days=9)])) for i in range(rng.randrange(25))]
        want.update({(page, p): o for p, o in plain_discovery(links, now, 4, 7)})
        rows += [(page, p, "https://a.org", u, "a long title", t) for p, u, t in links]
    rows += [(None, 0, "https://a.org", None, None, None), (None, 1, "https://a.org", "/x-1", "a long title", None), (None, 2, "https://a.org", "//b.org/x-1", "a long title", None), (None, 3, "https://a.org", "/x-2", "short", None),
             (None, 4, "https://a.org", "/x-1", "a long title", None), (None, 5, "https://a.org", "/x-1/login", "a long title", None), (None, 6, None, "/x-1", "a long title", None)]
    want.update({(None, i): o for i, o in enumerate(("dropped_no_url", "kept", "dropped_off_domain", "dropped_short_title", "dropped_duplicate", "dropped_deny", "dropped_off_domain"))})
    df = spark.createDataFrame(rows, "page int, position int, base_url string, href string, title string, publish_time timestamp")
    got = ad.discovered(df, F.lit(now), most=4, days=7)
    assert {(r.page, r.position): r.outcome for r in got.collect()} == want and got.count() == len(rows)
    total = ad.counters(got).agg(F.sum("total"), F.sum("kept")).first()
    assert tuple(total) == (len(rows), sum(o == "kept" for o in want.values()))
    assert ad.discovered(df.limit(0), F.lit(now)).count() == 0
    strict = ad.discovered(df.where("page is null"), F.lit(now), allowed=("x-2", "login"), denied=(), own_site=False, articles=True, title_least=0)
    assert [r.outcome for r in strict.orderBy("position").collect()] == ["dropped_no_url", "dropped_allow_miss", "dropped_allow_miss", "kept", "dropped_allow_miss", "dropped_non_article_url", "dropped_allow_miss"]


def test_captions(spark):
    track = "WEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000\n<c>Tom &amp; Ann</c>\nTom & Ann\n\n2\r\n  go  on  \n12\n&nbsp;\n<i></i>\nTom & Ann\nnotes kept? no"
    rows = [(track,), ("",), (None,), ("WEBVTT",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(captions.vtt(F.col("t"))).collect()] == ["Tom & Ann go  on Tom & Ann", "", "", ""]
    rows = [('{"events": [{"segs": [{"utf8": " a "}, {"utf8": "\\n"}, {}]}, {}, {"segs": [{"utf8": "b"}]}]}',), ('[{"segs": [{"utf8": "c"}]}]',), ("{broken",), (None,), ('{"events": 3}',), ("[]",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(captions.json3(F.col("t"))).collect()] == ["a b", "c", "", "", "", ""]


def test_lifecycle(spark):
    now = datetime.datetime(2024, 3, 1)
    at = lambda h: now - datetime.timedelta(hours=h)
    rows = [("active", "breaking", None, at(72), None), ("active", "breaking", None, at(71), None), ("active", None, "sue", at(700), None), ("cooling", "x", "", None, at(336)), ("cooling", "x", "", None, at(335)),
            ("reopened", None, None, at(9999), None), ("closed", None, None, at(9999), None), ("active", None, None, None, None), (None, None, None, at(9999), None), ("active", "PRODUCT", "sue", at(336), at(1))]
    e = spark.createDataFrame(rows, "status string, named string, action string, updated timestamp, seen timestamp")
    got = [(r.type, r.next_status, r.checkpoint) for r in lifecycle.ticked(e, F.lit(now)).collect()]
    assert got == [
        ("breaking", "cooling", "active->cooling"), ("breaking", "active", None), ("legal", "active", None), ("default", "closed", "cooling->closed"), ("default", "cooling", None), ("default", "active", "reopened->active"),
        ("default", "closed", None), ("default", "active", None), ("default", None, None), ("product", "cooling", "active->cooling"),
    ]
