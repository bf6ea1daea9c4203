"""Registered queries of search, full-text quality, pages, atoms, keyword identity and intervals, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import categories as st
from strandline.functions import fulltext, rules, unicode
from strandline.operators import atoms, bootstrap, pages, search
from strandline.plans.catalog import query
from strandline.plans.rules import _clean, q
from strandline.sources.views import CONTENTS, HEADLINES, contents, headlines, table

#: What users typed.
QUERIES = ("NATO summit", "flood kills", "v1.2  launched", "múltiple, años", "th*e (and)", 'rate "decision', "会 全球", "地震多地死亡", "**", "50% off", "ciónoado", "")

_TOKENS = r"regexp_extract_all(lower(strip_accents(coalesce({0}, ''))), '[\p{{L}}\p{{N}}]+')"
_PHRASES = rf"list_filter(list_transform(list_filter(regexp_split_to_array(left(regexp_replace(coalesce(@, ''), '^\s+|\s+$', '', 'g'), {search.INPUT_CHARS}), '\s+'), lambda t: t <> '')[1:{search.TERMS}], lambda t: left(translate(t, '{search.OPERATORS}', ''), {search.TERM_CHARS})), lambda t: t <> '')"


@query(f"WITH {CONTENTS} SELECT id, CASE WHEN len({_PHRASES.replace('@', 'title')}) > 0 THEN array_to_string(list_transform({_PHRASES.replace('@', 'title')}, lambda t: '\"' || replace(t, '\"', '\"\"') || '\"'), ' AND ') END AS expression FROM c")
def search_expressions(spark, sf):
    """every title as a user's input: its match expression of quoted phrases, without operators, bounded."""
    return contents(spark, sf).select("id", search.expression(F.col("title")).alias("expression"))


@query(
    f"""WITH {HEADLINES}, given AS (SELECT unnest(range(0, {len(QUERIES)}))::INTEGER AS query, unnest([{", ".join(map(q, QUERIES))}]) AS given), ph AS (SELECT query, given, {_PHRASES.replace("@", "given")} AS phrases FROM given),
 pt AS (SELECT query, given, list_transform(phrases, lambda p: ' ' || array_to_string({_TOKENS.format("p")}, ' ') || ' ') AS parts FROM ph),
 tx AS (SELECT id, list_transform([title, summary, body], lambda t: ' ' || array_to_string({_TOKENS.format("t")}, ' ') || ' ') AS texts, list_transform([title, summary, body], lambda t: lower(coalesce(t, ''))) AS low FROM h)
 SELECT query, id FROM pt, tx WHERE len(parts) > 0 AND len(list_filter(parts, lambda p: trim(p) = '' OR len(list_filter(texts, lambda t: contains(t, p))) = 0)) = 0 OR trim(given) <> '' AND len(list_filter(low, lambda t: contains(t, lower(trim(given))))) > 0"""
)
def search_results(spark, sf):
    """Rows that match a list of inputs, by phrases over an inverted index with positions or as substrings."""
    return search.search(headlines(spark, sf), ["title", "summary", "body"], QUERIES)


_FULL = f"""{HEADLINES}, t AS (SELECT id, {_clean("title")} AS t, {_clean("b")} AS b, {_clean("summary")} AS s, url FROM (SELECT id, title, CASE id % 5 WHEN 0 THEN substr(body, 1, 90) WHEN 1 THEN substr(body, 1, 300) || ' Please sign in or subscribe. Menu. Search.' ELSE body END AS b, CASE WHEN id % 3 = 0 THEN summary END AS summary, id % 4 = 0 AS url FROM h)),
 m AS (SELECT *, lower(b) AS low, lower(concat_ws(chr(10), t, b, s)) AS blob, list_filter(regexp_split_to_array(lower(trim(t)), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3) AS ws FROM t),
 n AS (SELECT *, {" + ".join(f"CASE WHEN contains(low, {q(x)}) THEN 1 ELSE 0 END" for x in fulltext.TEMPLATE)} AS tm, CASE WHEN trim(t) = '' THEN NULL WHEN len(ws) = 0 THEN CASE WHEN contains(low, lower(trim(t))) THEN 1.0 ELSE 0.0 END ELSE round(len(list_filter(ws, lambda w: contains(low, w))) / len(ws)::DOUBLE, 3) END AS tmatch,
  len(list_filter(regexp_split_to_array(regexp_replace(b, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda p: length(trim(p)) >= 40)) AS pp FROM m),
 o AS (SELECT *, CASE WHEN pp > 0 THEN pp WHEN length(b) >= 80 THEN 1 ELSE 0 END AS parts, length(b) < {fulltext.SHORT} AS short FROM n)"""


def _has(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(x)})" for x in terms) + ")"


@query(
    f"""WITH {_FULL}, v AS (SELECT *, CASE WHEN short AND {_has("blob", fulltext.CAPTCHA)} THEN 'captcha' WHEN short AND {_has("blob", fulltext.BOT_WALL)} THEN 'bot_wall' WHEN short AND {_has("blob", fulltext.LOGIN + fulltext.PAYWALL)} THEN 'login_required'
  WHEN length(b) = 0 AND length(s) = 0 AND length(t) = 0 THEN 'empty' WHEN length(b) < {fulltext.TEMPLATE_BELOW} AND tm >= {fulltext.TEMPLATE_TERMS} THEN 'boilerplate_only' WHEN short AND length(b) >= 50 AND NOT url AND coalesce(tmatch < 0.34, false) THEN 'non_article'
  WHEN length(b) >= {fulltext.FULL} AND parts >= 3 THEN 'full' WHEN length(b) >= {fulltext.PARTIAL} OR length(b) >= {fulltext.PARTIAL_PARTS} AND parts >= 2 THEN 'partial' WHEN length(s) >= {fulltext.SUMMARY} THEN 'summary_only' WHEN length(t) > 0 THEN 'title_only' ELSE 'empty' END AS status FROM o)
 SELECT id, status, CASE status WHEN 'full' THEN round(greatest(0.78::DOUBLE, least(1.0::DOUBLE, length(b) / 2400.0::DOUBLE + 0.1::DOUBLE * parts)), 3) WHEN 'partial' THEN 0.55 WHEN 'summary_only' THEN 0.3 WHEN 'title_only' THEN 0.12 WHEN 'non_article' THEN 0.08 WHEN 'boilerplate_only' THEN 0.05 ELSE 0.0 END::DOUBLE AS score,
  CASE WHEN length(b) = 0 AND length(s) = 0 AND length(t) = 0 THEN NULL ELSE round(least(1.0::DOUBLE, tm / 6.0::DOUBLE), 3) END AS template_ratio, tmatch AS title_match, CASE WHEN status IN ('full', 'partial', 'summary_only', 'title_only') THEN status ELSE 'blocked' END AS coarse FROM v"""
)
def fulltext_quality(spark, sf):
    """Why a fetched text can be used or not, on a ladder of eleven statuses, with score, template ratio, title match and the coarse status; bodies cut, or behind a notice, by id."""
    i = F.col("id")
    body = F.when(i % 5 == 0, F.substring("body", 1, 90)).when(i % 5 == 1, F.concat(F.substring("body", 1, 300), F.lit(" Please sign in or subscribe. Menu. Search."))).otherwise(F.col("body"))
    h = headlines(spark, sf).select("id", rules.clean(F.col("title")).alias("t"), rules.clean(body).alias("b"), rules.clean(F.when(i % 3 == 0, F.col("summary"))).alias("s"), (i % 4 == 0).alias("url"))
    m = h.select("id", "url", *(c.alias(k) for k, c in fulltext.measures(F.col("t"), F.col("b"), F.col("s")).items()))
    v = m.select("id", F.col("f_match").alias("title_match"), *(c.alias(k) for k, c in fulltext.verdict(F.col("url")).items()))
    return v.select("id", "status", "score", "template_ratio", "title_match", "coarse")


@query(
    f"""WITH {HEADLINES}, l AS (SELECT id, lower(title) AS low, list_distinct(regexp_extract_all(lower(title), '[a-z0-9.+-]+')) AS words FROM h) SELECT id, CASE """
    + " ".join("WHEN " + " OR ".join(f"list_contains(words, {q(k.strip().lower())})" if st.ascii_word(k) else f"contains(low, {q(k.strip().lower())})" for k in terms) + f" THEN {q(name)}" for name, terms in st.CATEGORIES)
    + f" ELSE {q(st.OTHER)} END AS category FROM l"
)
def title_categories(spark, sf):
    """The digest category of every title: words of letters and digits as whole tokens, others anywhere; the first category wins."""
    return headlines(spark, sf).select("id", st.category(F.col("title")).alias("category"))


_WORDS = r"list_slice(regexp_extract_all(text, '[^\s]+'), 1, 40)"


@query(
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents WHERE lang = 'de'), n AS (SELECT *, replace(lower(nfc_normalize(word)), 'ß', 'ss') AS identity FROM w)
 SELECT doc_id, count(*) AS words, count(DISTINCT identity) AS kept, count(*) - count(DISTINCT identity) AS skipped, array_to_string(list_sort(list(DISTINCT identity)), ' ') AS identities FROM n GROUP BY doc_id"""
)
def keyword_identities(spark, sf):
    """The first forty words of every German document as a list of keywords: identities by compatibility form and folded case, the first of each kept, the others skipped."""
    d = table(spark, sf, "documents").where("lang = 'de'").select("doc_id", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)), 1, 40)).alias("i", "word"))
    k = unicode.distinct_keywords(d, "doc_id", "word", "i")
    return k.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count_if(~F.col("skipped")).alias("kept"), F.count_if("skipped").alias("skipped"), F.array_join(F.array_sort(F.collect_set("identity")), " ").alias("identities")
    )


@query(None)
def repaired_titles(spark, sf):
    """Titles read with the wrong code page (every other one made so), and what a lossless round trip makes of them."""
    broken = F.when(F.col("id") % 2 == 0, F.decode(F.encode("title", "UTF-8"), "ISO-8859-1")).otherwise(F.col("title"))
    return contents(spark, sf).withColumn("broken", broken).select("id", "title", "broken", unicode.repaired(F.col("broken")).alias("r")).select("id", "title", "broken", "r.repaired", "r.page")


@query(None)
def quality_interval(spark, sf):
    """The mean quality label with its percentile bootstrap interval from one seeded generator."""
    return bootstrap.interval(table(spark, sf, "labels"), "quality", "doc_id")


def _said(spark, sf):
    """Pages with what the test pages lack in front: a feed, or the time of publication in one of four places."""
    i = F.col("page_id")
    text = (
        F.when(i % 5 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feeds/'), i, F.lit('.xml">')))
        .when(i % 5 == 1, F.concat(F.lit('<meta property="article:published_time" content="2024-03-0'), 1 + i % 9, F.lit('T10:00:00Z">')))
        .when(i % 5 == 2, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "2024/2/'), 1 + i % 28, F.lit('"}</script>')))
        .when(i % 5 == 3, '<time>no date</time><time datetime="2024-01-02T03:04">x</time>').otherwise("<p>Published: Mar 5, 2024 6:07 PM EST</p>")
    )
    return table(spark, sf, "pages").withColumn("html", F.concat(text, F.coalesce("html", F.lit(""))))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/feeds/' || page_id || '.xml' END AS feed FROM pages")
def page_feeds(spark, sf):
    """The feed that every page names, as an absolute URL (every fifth page names one)."""
    return pages.feeds(_said(spark, sf))


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 1 THEN make_timestamp(2024, 3, 1 + page_id % 9, 10, 0, 0) WHEN 2 THEN make_timestamp(2024, 2, 1 + page_id % 28, 0, 0, 0) - INTERVAL 8 HOUR WHEN 3 THEN TIMESTAMP '2024-01-02 03:04:00' WHEN 4 THEN TIMESTAMP '2024-03-05 23:07:00' END AS publish_time FROM pages"""
)
def page_times(spark, sf):
    """When every page was published, by meta elements, JSON-LD, time elements or labels, in this order."""
    return pages.publish_times(_said(spark, sf))


@query(None)
def page_listings(spark, sf):
    """Articles that listing pages name by selectors: title, link, summary and time. The test pages' menus are their listings here."""
    return pages.listings(table(spark, sf, "pages"), articles="nav li, ul > li", title="a", summary="p")


@query(None)
def page_articles(spark, sf):
    """Up to five candidates for the article of every cleaned page, with score, link density and title match; the best that is not rejected is chosen."""
    return pages.extracted(table(spark, sf, "pages"))


_STORED = """o AS (SELECT doc_id AS content, 'w' || i AS sentence, CASE WHEN i % 2 = 0 THEN 'fact' ELSE 'event' END AS type, md5(text) AS payload, (doc_id + i) % 7 = 0 AS verified, CASE WHEN (doc_id + i) % 5 = 0 THEN 'shadow' ELSE 'active' END AS status, (doc_id + i) % 5 <> 0 AS latest,
  CASE WHEN (doc_id + i) % 5 = 0 THEN 'missing_in_latest_extraction' ELSE '' END AS flags FROM documents, (SELECT unnest(range(0, 4)) AS i) WHERE doc_id % 4 <> 1),
 e AS (SELECT doc_id AS content, 'w' || i AS sentence, CASE WHEN i % 2 = 0 THEN 'fact' ELSE 'event' END AS type, md5(reverse(coalesce(text, ''))) AS payload FROM documents, (SELECT unnest(range(2, 6)) AS i) WHERE doc_id % 3 <> 0)"""


@query(
    f"""WITH {_STORED}, j AS (SELECT coalesce(o.content, e.content) AS content, coalesce(o.sentence, e.sentence) AS sentence, coalesce(o.type, e.type) AS type, CASE WHEN e.content IS NOT NULL THEN e.payload ELSE o.payload END AS payload, coalesce(verified, false) AS verified, status, latest, flags, o.content IS NOT NULL AS known, e.content IS NOT NULL AS here
  FROM o FULL JOIN e ON o.content = e.content AND o.sentence = e.sentence AND o.type = e.type), k AS (SELECT *, known AND NOT here AND content % 3 <> 0 AND NOT verified AND status = 'active' AS gone FROM j)
 SELECT content, sentence, type, payload, verified, CASE WHEN here THEN 'active' WHEN gone THEN 'shadow' ELSE status END AS status, CASE WHEN here THEN true WHEN gone THEN false ELSE latest END AS latest,
 CASE WHEN here THEN '' WHEN gone THEN 'missing_in_latest_extraction' ELSE flags END AS flags, CASE WHEN here AND NOT known THEN 'inserted' WHEN here AND status <> 'active' THEN 'reactivated' WHEN here THEN 'updated' WHEN gone THEN 'shadowed' ELSE 'kept' END AS outcome FROM k"""
)
def atom_upserts(spark, sf):
    """Stored atoms of documents behind a new extraction: inserted, updated, reactivated, put into the shadow or kept; verified ones stay."""
    d = table(spark, sf, "documents").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    kind, n = F.when(F.col("i") % 2 == 0, "fact").otherwise("event"), F.col("doc_id") + F.col("i")
    key = [F.col("doc_id").alias("content"), F.concat(F.lit("w"), F.col("i")).alias("sentence"), kind.alias("type")]
    hidden = n % 5 == 0
    old = d.where("doc_id % 4 <> 1 and i < 4").select(*key, F.md5("text").alias("payload"), (n % 7 == 0).alias("verified"), F.when(hidden, "shadow").otherwise("active").alias("status"), (~hidden).alias("latest"), F.when(hidden, F.array(F.lit(atoms.MISSING))).otherwise(F.array().cast("array<string>")).alias("flags"))
    new = d.where("doc_id % 3 <> 0 and i > 1").select(*key, F.md5(F.reverse(F.coalesce("text", F.lit("")))).alias("payload"), F.lit(False).alias("verified"))
    return atoms.upserted(old, new).withColumn("flags", F.array_join("flags", ","))


@query(None)
def reconciled_atoms(spark, sf):
    """Atoms of conversations (a turn each) behind a log that adds, merges, supersedes, contradicts or ignores each in the light of the turn before it."""
    c = table(spark, sf, "conversations").where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, atoms.OPS)), (F.coalesce("n", F.lit(0)) % 5 + 1).cast("int"))
    ops = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("seq"), kind.alias("op"), name(F.col("turn")).alias("atom"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("target"))
    return atoms.reconciled(c.select(name(F.col("turn")).alias("atom"), F.lit(1).alias("evidence")), ops)
