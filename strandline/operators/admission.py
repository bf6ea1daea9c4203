"""Admission of fetched items and of links found on listing pages: why an item or a link is turned away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles of navigation, titles of sections and path segments of single sites.
NAVIGATION = ("all topics", "case selections", "data and visuals", "hbr executive", "my library", "reading lists", "subscribe")
SITE_TITLES = {
    "hbr.org": ("gender", "innovation", "leadership", "latest", "managing teams", "managing yourself", "newsletters", "podcasts", "store", "strategy", "the magazine", "webinars", "work life balance"),
    "businessinsider.com": ("advertising", "careers", "law", "latest", "media", "personal finance", "real estate", "retail", "small business", "the better work project", "travel"),
    "techmeme.com": ("events", "about", "contact", "sponsor", "search"),
}
SITE_SEGMENTS = {"businessinsider.com": ("show", "shows", "guide", "guides", "video", "videos")}
# Path segments that hold no articles, ends of slugs that name a section, and segments and titles of galleries.
SEGMENTS = (
    "account", "author", "authors", "browse", "categories", "category", "channel", "channels", "collections", "index", "latest", "library", "list", "lists", "login", "menu", "newsletters", "section", "sections",
    "search", "signin", "subscribe", "subject", "subjects", "tag", "tags", "topic", "topics", "zhuanti", "fenlei", "pindao", "huati",
)
SECTION_ENDS = ("hub", "index", "overview", "topics", "topic", "sections", "section")
GALLERIES = ("slideshow", "slideshows", "gallery", "galleries", "photo-gallery", "photogallery", "interactive")
GALLERY_PREFIXES = ("图集：", "图集:", "相册：", "相册:", "图集 ", "相册 ")
GALLERY_TITLES = ("in pictures", "photo gallery", "picture gallery", "year in pictures", "photos of the week", "week in pictures")
# Roundups of one site, and signs of coupon pages.
ROUNDUP_SITE, ROUNDUP_SLUGS, ROUNDUP_TITLES, ROUNDUP_START = "engadget.com", ("-science-news", "review-recap", "-gift-guide"), ("engadget review recap", "review recap:", "and more science stories"), "review recap"
COUPON_PATHS, COUPON_TAGS = ("promo-code", "promo-codes", "coupon-code", "coupon-codes", "discount-code", "discount-codes"), ("coupon", "coupons")
COUPON_TITLE = r"(?i)\b(promo(tion)?|coupon|discount)\s+codes?\b"
COUPON_LANDING = r"(?i)\b\d{1,3}\s*%\s*off\b|\bsave\s+(up\s+to\s+)?(\$\s*)?\d|\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+20\d{2}\b"
# Suffixes of two labels, segments that articles follow, starts of paths that hold none, and patterns of links that are left out.
SUFFIXES = ("co.uk", "com.au", "com.cn", "com.hk", "com.sg", "com.tw", "co.jp", "co.kr")
HUBS = ("articles", "article", "blog", "story", "stories")
STARTS = (
    "/video", "/videos", "/podcasts", "/newsletters", "/livecoverage", "/live", "/search", "/topics", "/topic", "/tag", "/tags", "/authors", "/author", "/account", "/subscribe", "/login", "/signin", "/category", "/list",
    "/channel", "/channels", "/special", "/zhuanti", "/fenlei", "/pindao",
)
DENIED = ("/login", "/signin", "/sign-in", "/register", "/subscribe", "/account", "/privacy", "/terms", "/tag/", "/tags/", "/author/", "/authors/", "/search", "/category/")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "..."))

HOST, PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
WORDS = r"[0-9A-Za-z\x{4e00}-\x{9fff}]+"


def text_of(c: Column) -> Column:
    """Text without tags, with common entities decoded; null: empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""), r"\s+", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(out)


def key_of(c: Column) -> Column:
    """Words of a title as letters, digits and Han in small letters, a space between."""
    out = F.translate(F.replace(text_of(c), F.lit("&"), F.lit(" and ")), "/-", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(out), r"[^0-9a-z\x{4e00}-\x{9fff} ]+", " "), r"\s+", " "))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 2)), r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path in small letters, as written."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1))


def decoded(path: Column) -> Column:
    """Path with its percent escapes decoded; as written if they are broken."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def segments_of(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), lambda s: F.trim(decoded(s))), lambda s: s != "")


def within(host: Column, domain: Column | str) -> Column:
    """Whether a host is a domain or below it."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return (host != "") & (domain != "") & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)))


def registrable(host: Column) -> Column:
    """Last two labels of a host, or three behind a suffix of two labels."""
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    return F.when(F.size(parts) < 2, host).when((F.size(parts) >= 3) & last(2).isin(*SUFFIXES), last(3)).otherwise(last(2))


def same_hosts(a: Column, b: Column, domain_a: Column, domain_b: Column) -> Column:
    """Whether host b belongs to the site of host a, given their registrable domains."""
    return (a != "") & (b != "") & (within(b, a) | (domain_a == domain_b))


def same_site(source: Column, url: Column) -> Column:
    """Whether a URL belongs to the site of a source, sister hosts of its domain included."""
    a, b = host_of(source), host_of(url)
    return same_hosts(a, b, registrable(a), registrable(b))


def article_path(path: Column) -> Column:
    """Whether a path in small letters is shaped like an article's."""
    tail = F.regexp_extract(path, "([^/]*)/*$", 1)
    return ~path.isin("", "/") & ~path.rlike("^(" + "|".join(STARTS) + ")") & (path.rlike("/(" + "|".join(HUBS) + ")/+[^/]") | tail.rlike("[-.0-9]"))


def wrapped(url: Column) -> Column:
    """Whether a URL is an aggregator's wrapper of an article."""
    url = F.coalesce(url, F.lit(""))
    return (F.lower(F.regexp_extract(url, HOST, 2)) == "news.google.com") & F.contains(F.regexp_extract(url, PATH, 1), F.lit("/rss/articles/"))


def article_url(source: Column, url: Column) -> Column:
    """Whether a URL is shaped like an article's of a source's site, or wraps one."""
    return wrapped(url) | (same_site(source, url) & article_path(F.trim(path_of(url))))


def known(phrases: Sequence[str]) -> str:
    """Pattern of keys that are one of the phrases, or one with words before or behind."""
    one = "(" + "|".join(phrases) + ")"
    return f"^{one}( |$)|(^| ){one}$"


def any_part(c: Column, parts: Sequence[str]) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def _shaped(items: DataFrame) -> DataFrame:
    """Titles, hosts and paths of items, each made once for all rules."""
    title, url = text_of(F.col("title")), F.trim(F.coalesce("url", F.lit("")))
    x = items.select("id", title.alias("title"), key_of(F.col("title")).alias("key"), url.alias("url"), host_of(F.col("source_url")).alias("site"), text_of(F.col("content")).alias("text"),
                     key_of(F.col("content")).alias("text_key"), F.coalesce(F.length("html"), F.lit(0)).alias("html"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    x = x.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return x.withColumn("parts", segments_of(F.col("path")))


def _format_reason() -> Column:
    """First reason for which an item of any channel is no article."""
    path = decoded(F.col("path"))
    by_path, by_title = any_part(path, COUPON_PATHS), F.col("title").rlike(COUPON_TITLE)
    tagged = F.exists("tags", lambda t: F.lower(F.trim(t)).isin(*COUPON_TAGS))
    coupon = ((by_path | by_title) & F.coalesce(tagged, F.lit(False))) | (by_path & by_title & F.col("title").rlike(COUPON_LANDING))
    roundup = within(F.col("host"), ROUNDUP_SITE) & (any_part(F.col("path"), ROUNDUP_SLUGS) | any_part(F.col("key"), ROUNDUP_TITLES) | F.startswith("key", F.lit(ROUNDUP_START)))
    gallery = F.arrays_overlap("parts", F.array(*map(F.lit, GALLERIES)))
    prefix = F.col("title").rlike("^(" + "|".join(GALLERY_PREFIXES) + ")")
    pictures = any_part(F.col("key"), GALLERY_TITLES) & ((F.size("parts") == 0) | F.get("parts", F.lit(0)).isin("photos", "photo"))
    return (
        F.when(coupon, "blocked_promotional_coupon_page").when(roundup, "blocked_engadget_roundup").when(gallery, "blocked_non_article_format").when(prefix | pictures, "blocked_gallery_title")
    )


def section_like() -> Column:
    """Whether a URL of the source's own site names a section: columns site, host and parts."""
    tail = F.element_at("parts", F.when(F.size("parts") > 0, -1))
    words = F.filter(F.split(tail, "[-_]+"), lambda p: p != "")
    size, digits = F.size("parts"), tail.rlike(r"\p{Nd}")
    ends = F.element_at(words, F.when(F.size(words) > 0, -1)).isin(*SECTION_ENDS)
    plain = ~F.contains(tail, F.lit("."))
    short = (size == 1) & ~digits & (F.size(words) <= 4)
    bare = (size <= 2) & ~digits & tail.rlike(r"^\p{L}+$")
    like = F.when(size == 0, True).when(F.arrays_overlap("parts", F.array(*map(F.lit, SEGMENTS))), True).otherwise(plain & (F.coalesce(ends, F.lit(False)) | short | bare))
    return (F.col("url") != "") & (F.col("site") != "") & within(F.col("host"), F.col("site")) & like


def _website_reason() -> Column:
    """First reason for which a site's page is navigation, a section or a teaser: columns of _shaped, section."""
    title, key, section = F.col("title"), F.col("key"), F.col("section")
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(WORDS), F.lit(0)))
    short = (F.length("text") < 250) & (words(F.col("text")) < 40) & (F.col("html") < 2000)
    thin = short | ((F.col("text") != "") & (F.col("text_key") == key))
    away, hub = F.lit(False), F.lit(False)
    for domain, parts in SITE_SEGMENTS.items():
        away = away | (within(F.col("site"), domain) & thin & F.arrays_overlap("parts", F.array(*map(F.lit, parts))))
    for domain, titles in SITE_TITLES.items():
        hub = hub | (within(F.col("site"), domain) & section & key.rlike(known(titles)))
    single = (section | (words(key) <= 2)) & thin & (~title.rlike(r"\p{Nd}") | section)
    return F.when(key == "", F.lit(None)).when(key.rlike(known(NAVIGATION)), "blocked_navigation_title").when(away, "blocked_domain_non_article_path").when(hub, "blocked_section_hub_title").when(
        section & ((words(key) <= 3) | title.rlike("[【】|]")), "blocked_cjk_nav_pattern"
    ).when(single, "low_content_single_phrase_link")


def reasons(items: DataFrame) -> DataFrame:
    """id, format_reason, website_reason of items with id, title, url, source_url, content, html, tags (array of strings).

    A reason is the first rule that holds, null where none does. Nulls count as empty; rows keep their number, equal ids
    included; columns beyond those named are not looked at.
    """
    x = _shaped(items).withColumn("section", section_like())
    return x.select("id", _format_reason().alias("format_reason"), _website_reason().alias("website_reason"))


#: What becomes of a link, in the order in which it is told.
OUTCOMES = ("dropped_no_url", "dropped_off_domain", "dropped_deny", "dropped_allow_miss", "dropped_non_article_url", "dropped_short_title", "dropped_duplicate", "dropped_stale", "truncated", "kept")


def discovered(links: DataFrame, now: Column, *, most: int = 50, denied: Sequence[str] = DENIED, allowed: Sequence[str] = (), own_site: bool = True, articles: bool = False, title_least: int = 8, days: int | None = None) -> DataFrame:
    """page, position, url, outcome of the links of listing pages: page, position (one link each), base_url, href, title, publish_time.

    A page keeps its first `most` fresh links, each URL once. A link repeats only what was kept before it, so of a page's
    URL the first fresh one decides: only those are ranked, `most` a page, and met again by page and URL. Nulls count as
    empty; a link without a time is fresh.
    """
    href = F.trim(F.coalesce("href", F.lit("")))
    root = F.regexp_extract(F.coalesce("base_url", F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//([^/?#]*)", 0)
    scheme = F.regexp_extract(F.coalesce("base_url", F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1)
    url = F.when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(href)
    x = links.select("page", "position", "base_url", url.alias("url"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), "publish_time")
    x = x.withColumns({"low": F.lower("url"), "a": host_of(F.col("base_url")), "b": host_of(F.col("url"))})
    x = x.withColumns({"domain_a": registrable(F.col("a")), "domain_b": registrable(F.col("b")), "path": F.trim(path_of(F.col("url")))})
    x = x.withColumn("same", same_hosts(F.col("a"), F.col("b"), F.col("domain_a"), F.col("domain_b")))
    out = F.when(F.col("url") == "", "dropped_no_url")
    if own_site:
        out = out.when(~F.col("same"), "dropped_off_domain")
    if denied:
        out = out.when(any_part(F.col("low"), denied), "dropped_deny")
    if allowed:
        out = out.when(~any_part(F.col("low"), allowed), "dropped_allow_miss")
    if articles:
        out = out.when(~(wrapped(F.col("url")) | (F.col("same") & article_path(F.col("path")))), "dropped_non_article_url")
    out = out.when(F.length("title") < title_least, "dropped_short_title")
    stale = F.coalesce(F.col("publish_time") < now - F.make_dt_interval(F.lit(days)), F.lit(False)) if days else F.lit(False)
    x = x.select("page", "position", "url", out.alias("early"), stale.alias("stale"))
    # a condition inside the minimum, as a filter would be pushed below the projections with every rule written out in it
    first = x.groupBy("page", "url").agg(F.min(F.when(F.col("early").isNull() & ~F.col("stale"), F.col("position"))).alias("first")).where("first is not null")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("first"))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("page").alias("kept_page"), F.col("url").alias("kept_url"), "first")
    met = x.join(kept, x["page"].eqNullSafe(kept["kept_page"]) & (x["url"] == kept["kept_url"]), "left")
    late = F.when(F.col("first") < F.col("position"), "dropped_duplicate").when(F.col("stale"), "dropped_stale").when(F.col("first") == F.col("position"), "kept").otherwise("truncated")
    return met.select("page", "position", "url", F.coalesce("early", late).alias("outcome"))


def counters(outcomes: DataFrame, by: str = "page") -> DataFrame:
    """A page's number of links by outcome, zeros included, and their total."""
    return outcomes.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
