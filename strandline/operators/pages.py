"""Links, feeds, times and articles of landed pages: a page is parsed once by a task and gives a row or several."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import dom, times

# Types of feeds, selectors of listings, where a page says when it was published.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")
ARTICLES, LISTED = "article, .post, .entry, [class*='news'], [class*='article'], [class*='story'], [class*='item'], [class*='card']", 20
TITLE, LINK, SUMMARY = "h1, h2, h3, .title, .post-title, a", "a", "p, .summary, .excerpt, .desc, .description"
DATE = "time, .date, .published, .time, span[class*='time'], span[class*='date']"
META_TIMES = (("property", "article:published_time"), ("property", "og:published_time"), ("name", "publishdate"), ("name", "pubdate"), ("name", "date"), ("itemprop", "datePublished"))
JSON_TIMES = ("datePublished", "dateCreated", "uploadDate")
LABELS = (r"(?:发布时间|发表时间|发布于|更新时间|更新于)\s*[:：]?\s*([0-9]{4}[-/年][^<\n]{6,40})", r"(?:Published|Updated)\s*[:：]?\s*([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4}[^<\n]{0,30})")
LABELLED_CHARS = 120000
# What is no article, weights and thresholds of candidates.
DROPPED = frozenset("script style noscript template iframe object embed form input button select textarea svg canvas base".split())
NOISE_TAGS = frozenset("nav footer aside header".split())
NOISE = re.compile(r"(?:^|[-_\s])(?:ad|ads|advert|advertisement|banner|breadcrumb|comment|comments|cookie|footer|menu|nav|newsletter|promo|recommend|related|share|sidebar|social)(?:$|[-_\s])", re.I)
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)(?:\s*!important)?\s*(?:;|$)", re.I)
MOST_LINKED, LINKED_BELOW, LEAST_CHARS = 0.45, 1000, 100
PRIORITY = {"structured": 0.05, "article": 0.04, "densest": 0.03, "body": 0.01}
SCHEMES = frozenset(("http", "https", "mailto", "tel"))


def _each(pages: DataFrame, schema: str, rows: Callable[[str, str], list[tuple]], id_: str, url: str, html: str) -> DataFrame:
    """A task's pages, each parsed by `rows(url, html)` into tuples behind its id."""
    fields = [(part.rsplit(" ", 1)[0].strip(), part.rsplit(" ", 1)[1]) for part in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for key, u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = rows(u or "", page.as_py() or "")
                ids += [key] * len(found)
                out += found
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True))], [batch.schema.field(0).name, *(n for n, _ in fields)])

    kind = pages.schema[id_].dataType.simpleString()
    return pages.select(id_, url, html).mapInArrow(run, f"`{id_}` {kind}, {schema}")


def feed_url(url: str, page: str) -> str | None:
    """The first feed that a page names, as an absolute URL."""
    for link in dom.parse(page).walk():
        if link.tag == "link" and link.get("type") in FEED_TYPES:
            return urljoin(url, link.get("href")) if link.get("href") else None
    return None


def feeds(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id and feed: what every page names as its feed, null if nothing."""
    return _each(pages, "feed string", lambda u, page: [(feed_url(u, page),)], id_, url, html)


def listed(url: str, page: str, articles: str = ARTICLES, title: str = TITLE, link: str = LINK, summary: str = SUMMARY, date: str = DATE, most: int = LISTED) -> list[tuple]:
    """(at, title, link, summary, date texts) of the first articles of a listing that have a title and a link."""
    out = []
    first = lambda e, s: next(dom.select(e, s), None)
    for at, e in enumerate(dom.select(dom.parse(page), articles)):
        if at == most:
            break
        heading, anchor, lead, when = (first(e, s) for s in (title, link, summary, date))
        name = heading.text("") if heading else ""
        href = anchor.get("href") if anchor else ""
        if name and href:
            dates = [when.get("datetime"), when.text()] if when else []
            out.append((at, name, urljoin(url, href) if href.startswith("/") else href, lead.text("") if lead else "", [d for d in dates if d]))
    return out


def listings(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", now=None, **selectors: str) -> DataFrame:
    """A row for each article of each listing: at, title, link, summary and publish_time; selectors can be given by name."""
    found = _each(pages, "at int, title string, link string, summary string, dates array<string>", lambda u, page: listed(u, page, **selectors), id_, url, html)
    return found.withColumn("publish_time", _first_time(now)).drop("dates")


def _first_time(now):
    now = F.lit(None).cast("timestamp_ntz") if now is None else now
    return F.get(F.filter(F.transform("dates", lambda d: times.publish_time(d, now)), lambda t: t.isNotNull()), 0)


def time_texts(_: str, page: str) -> list[str]:
    """Texts that may say when a page was published, the surest first: meta elements, JSON-LD, time elements, labels."""
    root, out = dom.parse(page), []
    elements = list(root.walk())
    for name, value in META_TIMES:
        out += [e.get("content") for e in elements if e.tag == "meta" and e.get(name) == value][:1]
    for e in elements:
        if e.tag == "script" and e.get("type") == "application/ld+json":
            try:
                said = json.loads(e.text("") or "null")
            except ValueError:
                continue
            out += [item[f] for item in (said if isinstance(said, list) else [said]) if isinstance(item, dict) for f in JSON_TIMES if isinstance(item.get(f), str)]
    for e in elements:
        if e.tag == "time":
            out += [e.get("datetime").strip(), e.text()]
    for pattern in LABELS:
        out += [m.strip() for m in re.findall(pattern, page[:LABELLED_CHARS], re.I)]
    return [t for t in out if t]


def publish_times(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", now=None) -> DataFrame:
    """id and publish_time: the first text of a page's ladder that is a time, null if none is."""
    found = _each(pages, "dates array<string>", lambda u, page: [(time_texts(u, page),)], id_, url, html)
    return found.withColumn("publish_time", _first_time(now)).drop("dates")


def standardized(url: str, page: str) -> tuple[dom.Element, Counter]:
    """A page's tree without scripts, hidden and marked parts, styles and handlers, with absolute safe links; and what was changed."""
    root, trace = dom.parse(page), Counter()
    base = next((urljoin(url, e.get("href")) for e in root.walk() if e.tag == "base" and e.get("href")), url)
    base = base if urlparse(base).scheme in ("http", "https") else url
    for e in list(root.walk()):
        marks = " ".join((e.get("id"), e.get("class"), e.get("role")))
        gone = e.tag in DROPPED or e.tag in NOISE_TAGS or "hidden" in e.attributes or e.get("aria-hidden") in ("true", "1") or HIDDEN.search(e.get("style")) or (marks.strip() and NOISE.search(marks) and e.tag not in ("html", "body"))
        if gone:
            e.remove()
            trace["removed_elements"] += 1
    for e in root.walk():
        for lazy in ("data-src", "data-lazy-src", "data-original", "data-url"):
            if e.tag == "img" and not e.get("src") and e.get(lazy):
                e.attributes["src"] = e.get(lazy)
                trace["promoted_media"] += 1
        for name in [n for n in e.attributes if n == "style" or n.startswith("on")]:
            del e.attributes[name]
            trace["removed_attributes"] += 1
        for name in ("href", "src"):
            if e.get(name) and not (name == "href" and e.get(name).startswith("#")):
                whole = urljoin(base, e.get(name).strip())
                if urlparse(whole).scheme in SCHEMES:
                    trace["absolute_urls"] += whole != e.get(name)
                    e.attributes[name] = whole
                else:
                    del e.attributes[name]
                    trace["removed_attributes"] += 1
    return root, trace


def link_density(e: dom.Element) -> float:
    """Part of an element's text that stands in links."""
    linked = " ".join(x.text() for x in e.walk() if x.tag == "a")
    return round(len(linked) / max(1, len(e.text())), 4)


def blocks(e: dom.Element) -> str:
    """An element's text, a line for each block."""
    out, line = [], []

    def flush() -> None:
        if (t := " ".join(" ".join(line).split())):
            out.append(t)
        line.clear()

    todo: list = list(reversed(e.children))
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            line.append(c)
        elif c.tag in dom.BLOCKS or c.tag in ("li", "br", "tr", "td", "body", "html"):
            flush()
            todo += [None, *reversed(c.children)]
        else:
            todo += reversed(c.children)
    flush()
    return "\n\n".join(out)


def title_match(title: str, text: str) -> float | None:
    """How much of a title's letters the head of a text has, counted with repeats: twice the shared ones over all."""
    if not title:
        return None
    head = text[: max(500, len(title) * 5)].lower()
    shared = sum((Counter(title.lower()) & Counter(head)).values())
    return round(2 * shared / (len(title) + len(head)), 4)


def paragraph_count(text: str) -> int:
    return sum(len(p.strip()) >= 40 for p in re.split(r"\n{2,}|(?<=[.!?。！？])\s+", text))


def candidates(url: str, page: str) -> list[tuple]:
    """(method, text, score, link_density, paragraphs, title_match, rejected) of a page's candidates for its article, five at most."""
    structured = [t for t in (_article_body(e) for e in dom.parse(page).walk() if e.tag == "script" and e.get("type") == "application/ld+json") if t]
    root, _ = standardized(url, page)
    elements = list(root.walk())
    title = next((e.text() for e in elements if e.tag == "h1"), "") or next((e.text() for e in elements if e.tag == "title"), "")
    found: list[tuple[str, str, dom.Element | None]] = [("structured", structured[0], None)] if structured else []
    found += [("article", blocks(e), e) for e in elements if e.tag in ("article", "main")][:2]
    boxes = [e for e in elements if e.tag in ("div", "section", "td")]
    if boxes:
        dense = max(boxes, key=lambda e: sum(len(p.text()) for p in e.children if isinstance(p, dom.Element) and p.tag == "p") * (1 - link_density(e)))
        found.append(("densest", blocks(dense), dense))
    body = next((e for e in elements if e.tag == "body"), root)
    found.append(("body", blocks(body), body))
    out = []
    for method, text, e in found[:5]:
        if not text:
            continue
        density, parts = link_density(e) if e is not None else 0.0, paragraph_count(text)
        grade = max(0.78, min(1.0, len(text) / 2400 + 0.1 * parts)) if len(text) >= 1200 and parts >= 3 else 0.55 if len(text) >= 400 or len(text) >= 220 and parts >= 2 else 0.12
        score = 0.68 * grade + min(0.12, len(text) / 20000) + min(0.08, parts / 100) + PRIORITY[method] + 0.08 * (method == "structured") - 0.6 * max(0.0, density - 0.30)
        rejected = "high_link_density" if density > MOST_LINKED and len(text) < LINKED_BELOW else "too_short" if len(text) < LEAST_CHARS else None
        out.append((method, text, round(max(0.0, min(1.0, score)), 4), density, parts, title_match(title, text), rejected))
    return out


def _article_body(e: dom.Element) -> str:
    try:
        said = json.loads(e.text("") or "null")
    except ValueError:
        return ""
    return next((x["articleBody"].strip() for x in (said if isinstance(said, list) else [said]) if isinstance(x, dict) and isinstance(x.get("articleBody"), str)), "")


def extracted(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each candidate of each page: method, text, score, signals, why it is rejected, and whether it is the best of those that are not."""
    schema = "method string, text string, score double, link_density double, paragraphs int, title_match double, rejected string, chosen int"

    def rows(u: str, page: str) -> list[tuple]:
        found = candidates(u, page)
        best = max((k for k, c in enumerate(found) if c[6] is None), key=lambda k: (found[k][2], len(found[k][1]), -k), default=-1)
        return [(*c, int(k == best)) for k, c in enumerate(found)]

    return _each(pages, schema, rows, id_, url, html).withColumn("chosen", F.col("chosen") == 1)
