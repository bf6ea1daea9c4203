"""Search, full-text ladder, page trees, atoms, budgets, Unicode and intervals against plain versions."""

import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strandline.functions import categories, dom, fulltext, unicode
from strandline.operators import atoms, bootstrap, budget, pages, search


def test_match_expressions(spark):
    want = {
        "": None, "   ": None, "*^[]": None, "hello world": '"hello" AND "world"', 'x"y z': '"x""y" AND "z"', "foo*bar OR (baz)": '"foobar" AND "OR" AND "baz"', "a-b {c} \\d:e": '"ab" AND "c" AND "de"',
        "w " * 30: " AND ".join(['"w"'] * 20), "y" * 100: '"' + "y" * 64 + '"', "q " * 150 + "late": " AND ".join(['"q"'] * 20),
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string").select("t", search.expression(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == {**want, None: None}


def plain_search(rows, queries):
    def toks(t):
        t = "".join(unicodedata.normalize("NFD", c)[0] for c in (t or "").lower())
        return re.findall(r"[^\W_]+", t)

    def has(words, phrase):
        return bool(phrase) and any(words[i : i + len(phrase)] == phrase for i in range(len(words)))

    out = set()
    for n, given in enumerate(queries):
        terms = [re.sub(r"[*^:()\[\]{}\\-]", "", t)[:64] for t in (given or "").strip()[:200].split()[:20]]
        terms = [t for t in terms if t]
        for i, *fields in rows:
            by_index = bool(terms) and all(any(has(toks(f), toks(t)) for f in fields) for t in terms)
            as_text = bool((given or "").strip()) and any(given.strip().lower() in (f or "").lower() for f in fields)
            if by_index or as_text:
                out.add((n, i))
    return out


def test_search_equals_a_plain_scan(spark):
    rng = random.Random(5)
    words = ["Über", "cafe", "café", "foo.bar", "foo", "bar", "x-y", "北京", "don't", "a", "B", "50%", "été"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) if i % 7 else None, " ".join(rng.choice(words) for _ in range(3))) for i in range(120)]
    queries = ["foo.bar", "cafe", "CAFÉ uber", "bar foo", '"foo" a', "北京", "...", "don't", "x-y", "50% a", "é", "a a", "", None, "B café 北京"]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = {(r.query, r.id) for r in search.search(df, ["title", "body"], queries).collect()}
    assert got == plain_search(rows, queries) and len(got) > 200
    assert search.search(df.limit(0), ["title"], queries).count() == 0 and search.search(df, ["title"], [""]).count() == 0


def test_fulltext_ladder(spark):
    long = "A sentence that is clearly longer than forty characters. " * 30
    cases = [
        ("captcha", "t", "Please verify you are human", "", None), ("bot_wall", "Attention required", "x", "", None), ("login_required", "t", "请登录", "", None), ("empty", "", "", "", None), ("boilerplate_only", "t", "Menu Search Home " + "x " * 300, "", None),
        ("non_article", "quantum widgets", "y " * 60, "", False), ("full", "A sentence", long, "", None), ("partial", "t", "z" * 450, "", None), ("partial", "t", ("w" * 45 + ". ") * 5, "", None), ("summary_only", "t", "short", "s" * 60, None),
        ("title_only", "t", "", "", None), ("full", "captcha", long + " captcha", "", False),
    ]
    df = spark.createDataFrame([(n, *c[1:]) for n, c in enumerate(cases)], "n int, t string, b string, s string, u boolean")
    m = df.select("n", "u", *(c.alias(k) for k, c in fulltext.measures(F.col("t"), F.col("b"), F.col("s")).items()))
    got = {r.n: r for r in m.select("n", *(c.alias(k) for k, c in fulltext.verdict(F.col("u")).items())).collect()}
    assert [got[n].status for n in range(len(cases))] == [c[0] for c in cases]
    assert got[6].score == 1.0 and got[0].coarse == got[4].coarse == "blocked" and got[3].template_ratio is None and got[9].coarse == "summary_only"


PAGE = """<!doctype html><html><head><title>Big news | Site</title><base href="https://site.example/base/"><LINK rel=alternate type="application/atom+xml" href="../atom.xml">
<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type": "X"}, {"datePublished": "2024-05-06T07:08:09Z", "articleBody": " Told whole. "}]</script></head>
<body class="menu-open"><nav><a href="/x">menu</a></nav><div hidden>secret</div><p style="display: none">gone</p><div class="story"><h2>First <b>title</b></h2><a href="/news/1">go</a><p>Lead one.</p><time datetime="2024-01-02T03:04:05Z">then</time></div>
<div class="story"><h2>No link</h2></div><div class="card big"><a href="https://other.example/2">Second title</a><span class="datetime">2024/3/4</span></div>
<article><h1>Big news</h1><p onclick="x()">The first paragraph of the article is long enough to count as one.<p>The second one<br>goes on, with <a href="more">a link</a> and an <img data-src="pic.png"> in it, and is long too.</article>
<div class="share-bar">share me</div><aside>related</aside><a href="javascript:bad()">bad</a></body></html>"""


def test_tree_and_selectors():
    root = dom.parse(PAGE)
    texts = lambda s: [e.text() for e in dom.select(root, s)]
    assert texts("article h1, .story > h2") == ["First title", "No link", "Big news"] and texts("div.card a[href^='https']") == ["Second title"] and texts("[class*='tor'] a") == ["go"]
    assert len(texts("article p")) == 2 and texts("body > p") == ["gone"] and texts("[class~=big]") == ["Second title 2024/3/4"] and texts("nope, *[hidden]") == ["secret"]
    for bad in ("a:hover", "a + b", "", "a,,b", "a["):
        with pytest.raises(ValueError):
            list(dom.select(root, bad))
    assert dom.parse(None).text() == "" and dom.parse("<p>a<p>b</i><ul><li>c<li>d").text("|") == "a|b|c|d"
    deep = dom.parse("<div>" * 5000 + "x" + "</b>" * 5000)
    assert deep.text() == "x" and sum(1 for _ in deep.walk()) == 5000


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://site.example/a/b.html", PAGE), (2, "https://b.example/", None), (3, None, ""), (4, "https://c.example/x", '<meta name="date" content="no"><p>Published: Mar 5, 2024 6:07 PM EST</p>')], "page_id long, url string, html string")
    assert {r.page_id: r.feed for r in pages.feeds(df).collect()} == {1: "https://site.example/atom.xml", 2: None, 3: None, 4: None}
    listed = [tuple(r)[1:] for r in pages.listings(df, articles=".story, .card").orderBy("at").collect()]
    assert listed == [(0, "Firsttitle", "https://site.example/news/1", "Lead one.", datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, "Second title", "https://other.example/2", "", datetime.datetime(2024, 3, 3, 16, 0))]
    assert {r.page_id: r.publish_time for r in pages.publish_times(df).collect()} == {1: datetime.datetime(2024, 5, 6, 7, 8, 9), 2: None, 3: None, 4: datetime.datetime(2024, 3, 5, 23, 7)}
    found = pages.extracted(df).collect()
    best = [r for r in found if r.page_id == 1 and r.chosen]
    assert [r.method for r in found if r.page_id == 1][:2] == ["structured", "article"] and len(best) == 1 and best[0].method == "article"
    assert best[0].text == "Big news\n\nThe first paragraph of the article is long enough to count as one.\n\nThe second one\n\ngoes on, with a link and an in it, and is long too."
    assert all(r.rejected == "too_short" for r in found if r.method == "structured") and not any(r.chosen for r in found if r.page_id in (2, 3))
    assert pages.extracted(df.limit(0)).count() == 0


def test_cleaned_tree():
    root, trace = pages.standardized("https://site.example/a/b.html", PAGE)
    text = root.text()
    assert not any(x in text for x in ("secret", "gone", "menu", "share me", "related", "broken")) and "Big news" in text
    links = [e.get("href") for e in root.walk() if e.tag == "a"]
    assert links == ["https://site.example/news/1", "https://other.example/2", "https://site.example/base/more", ""] and trace["promoted_media"] == 1
    assert not any("onclick" in e.attributes or "style" in e.attributes for e in root.walk())
    assert pages.link_density(dom.parse("<p>ab <a>cd</a></p>")) == 0.4 and pages.title_match("ab", "ba") == 1.0 and pages.title_match("", "x") is None


def test_atom_upsert(spark):
    old = spark.createDataFrame([("c1", "s1", "fact", "p", False, "active", True, ["odd"]), ("c1", "s2", "fact", "p", True, "active", True, []), ("c1", "s3", "fact", "p", False, "shadow", False, [atoms.MISSING]), ("c1", "s4", "fact", "p", False, "superseded", False, None), ("c2", "s1", "fact", "p", False, "active", True, [])], "content string, sentence string, type string, payload string, verified boolean, status string, latest boolean, flags array<string>")
    new = spark.createDataFrame([("c1", "s3", "fact", "q", None), ("c1", "s5", "fact", "a", True), ("c1", "s5", "fact", "b", False)], "content string, sentence string, type string, payload string, verified boolean")
    got = {(r.content, r.sentence): (r.outcome, r.status, r.latest, r.verified, r.payload, r.flags) for r in atoms.upserted(old, new).collect()}
    assert got == {
        ("c1", "s1"): ("shadowed", "shadow", False, False, "p", ["odd", atoms.MISSING]), ("c1", "s2"): ("kept", "active", True, True, "p", []), ("c1", "s3"): ("reactivated", "active", True, False, "q", []),
        ("c1", "s4"): ("kept", "superseded", False, False, "p", []), ("c1", "s5"): ("inserted", "active", True, True, "b", []), ("c2", "s1"): ("kept", "active", True, False, "p", []),
    }
    again = atoms.upserted(atoms.upserted(old, new).drop("outcome"), new)
    assert {r.outcome for r in again.collect()} == {"updated", "kept"}


def test_reconcile_equals_one_ledger(spark):
    """Folded by component over tasks as by one ledger over all operations."""
    rng = random.Random(6)
    names = [f"a{i}" for i in range(60)]
    ops = [(n, rng.choice([*atoms.OPS, "ODD"]), rng.choice(names), rng.choice([*names, "gone", None])) for n in range(70)]
    df = spark.createDataFrame(ops, "seq long, op string, atom string, target string")
    rows = atoms.reconciled(spark.createDataFrame([(a,) for a in names], "atom string").withColumn("evidence", F.lit(1)), df).collect()
    ledger = atoms.Ledger(dict.fromkeys(names, 1))
    told = {n: ledger.apply(n, op, a, t) for n, op, a, t in ops}
    assert {r.seq: r.outcome for r in rows if r.what == "operation"} == told and set(told.values()) >= {"MERGE", "SUPERSEDE", "CONTRADICT"}
    assert {r.atom: (r.status, r.latest, r.supersedes, r.superseded_by, r.grp, r.evidence, r.flags) for r in rows if r.what == "atom"} == {a: (x["status"], x["latest"], x["supersedes"], x["superseded_by"], x["group"], x["evidence"], ",".join(sorted(x["flags"]))) for a, x in ledger.atoms.items()}
    assert {(r.atom, r.other): r.outcome for r in rows if r.what == "relation"} == ledger.relations


def test_budget_equals_a_sequential_model(spark):
    rng = random.Random(8)
    rows = [(i, datetime.datetime(2024, rng.randint(1, 3), rng.randint(1, 4), rng.randint(0, 23)) if i % 50 else None, rng.choice([None, -3, 5, 40, 90])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, tokens long").repartition(7)
    got = {r.id: (r.allowed, r.reason, r.day_used, r.month_used) for r in budget.granted(df, 300, 900).collect()}
    used, want = {}, {}
    for i, t, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.datetime.min, r[0])):
        n, d, m = max(1, n or 0), ("d", t.date() if t else None), ("m", (t.year, t.month) if t else None)
        reason = budget.DAILY if used.get(d, 0) + n > 300 else budget.MONTHLY if used.get(m, 0) + n > 900 else None
        if reason is None:
            used[d], used[m] = used.get(d, 0) + n, used.get(m, 0) + n
        want[i] = (reason is None, reason, used.get(d, 0), used.get(m, 0))
    assert got == want and {w[1] for w in want.values()} == {None, budget.DAILY, budget.MONTHLY}
    assert all(r.allowed for r in budget.granted(df, 0, 0).collect())


def test_budget_folds_no_more_calls_than_a_cap_has_room_for(spark):
    rng, start = random.Random(9), datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=rng.randrange(5 * 1440)), rng.choice([1, 30, 70, 500])) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, tokens long").repartition(5)
    for daily, monthly in ((200, 700), (200, 0), (0, 700)):
        assert budget.candidates(df, daily, monthly).count() <= 5 * sum(max(daily, monthly) // n for n in (1, 30, 70, 500))
        used, want, months = {}, {}, 0
        for _, t, n in sorted(rows, key=lambda r: (r[1], r[0])):
            d = t.date()
            fits = not (daily and used.get(d, 0) + n > daily or monthly and months + n > monthly)
            used[d], months = used.get(d, 0) + n * fits, months + n * fits
            calls, denied = want.get(d, (0, 0))
            want[d] = (calls + 1, denied + (not fits))
        assert {r.day: (r.calls, r.denied, r.used) for r in budget.by_day(df, daily, monthly).collect()} == {str(d): (*v, used[d]) for d, v in want.items()}


def test_keyword_identity(spark):
    words = [(1, 0, "ＡＢＣ"), (1, 1, "abc"), (1, 2, " Straße "), (1, 3, "STRASSE"), (1, 4, ""), (1, 5, None), (1, 6, "été"), (1, 7, "ÉTÉ"), (2, 0, "abc"), (None, 0, "①"), (None, 1, "1"), (3, 0, "x"), (3, 0, "x")]
    rows = unicode.distinct_keywords(spark.createDataFrame(words, "g long, i int, w string"), "g", "w", "i").collect()
    shown = sorted(((r.g or 0), r.i, r.keyword, r.skipped) for r in rows)
    assert shown == [(0, 0, "1", False), (0, 1, "1", True), (1, 0, "ABC", False), (1, 1, "abc", True), (1, 2, "Straße", False), (1, 3, "STRASSE", True), (1, 6, "été", False), (1, 7, "ÉTÉ", True), (2, 0, "abc", False), (3, 0, "x", False), (3, 0, "x", True)]


def test_broken_titles(spark):
    whole = ["中国经济增长", "日本", "“Smart quotes” – naïve", "plain", "café", ""]
    broken = [t.encode().decode("latin-1") for t in whole[:2]] + [whole[2].encode().decode("cp1252", errors="ignore"), "plain", "café", None, "Ã� odd"]
    got = [r.r for r in spark.createDataFrame([(i, t) for i, t in enumerate(broken)], "i int, t string").orderBy("i").select(unicode.repaired("t").alias("r")).collect()]
    assert [g.repaired for g in got[:2]] == whole[:2] and got[0].page == "latin-1"
    assert [g.repaired for g in got[3:]] == [None] * 4
    assert unicode.repair("Ã©tÃ© Ã©") == ("été é", "latin-1") and unicode.repair("Chinaâ€™s economy") == (None, None)


@pytest.mark.parametrize(("n", "rounds"), [(1, 3), (37, 50), (300, 20)])
def test_interval_equals_one_generator(spark, n, rounds):
    rng = random.Random(n)
    values = [rng.random() for _ in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(n, None)], "i long, v double").repartition(3)
    generator, means = random.Random(bootstrap.SEED), []
    for _ in range(rounds):
        means.append([generator.randrange(n) for _ in range(n)])
    drawn = {}
    for r in bootstrap.draws(spark, n, rounds, tasks=3).collect():
        drawn.setdefault(r["round"], {})[r.at] = r.times
    assert all(drawn[k] == {i: at.count(i) for i in set(at)} for k, at in enumerate(means))
    means = sorted(sum(values[i] for i in at) / n for at in means)
    low, high = means[int(0.025 * rounds // 1)], means[max(0, -int(-(0.975 * rounds) // 1) - 1)]
    got = bootstrap.interval(df, "v", "i", rounds=rounds).first()
    assert (got.value, got.low, got.high) == (round(sum(values) / n, 6), round(low, 6), round(high, 6))
    assert tuple(bootstrap.interval(df.limit(0), "v", "i").first()) == (None, None, None)


def test_categories(spark):
    texts = {"Airbnb is available": "重点", "New AI chip": "AI", "cars and car": "汽车", "大模型 发布": "AI", "war in iran": "国际", "bank ev": "汽车", None: "重点", "小鹏": "汽车"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", categories.category(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == texts
