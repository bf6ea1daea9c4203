"""Main text of web pages by site template removal.

Every element's subtree is hashed (tag, text, hashes of its children). Spark counts, per host, on how many different
pages a subtree stands; those on many pages of the host are its template and are deleted. Elements that are no article
by their tag, role or class go as well; what is left of the article is returned in blocks.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import free, staged

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)?+)?+""")
_SEEN = frozenset("class id role hidden aria-hidden".split())
# Elements by what they mean in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr "
    "math mfrac mi mn mo mover mrow ms mspace msqrt mroot mstyle msub msubsup msup mtext munder munderover semantics annotation".split()
)
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg button select textarea input option dialog menu title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tr body html article main div section td th blockquote".split())
#: Words in class, id or role that mark what is no article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended sidebar breadcrumb breadcrumbs menu nav navbar navigation footer header masthead topbar comment comments disqus respond replies pagination pager widget toolbar "
    "search complementary contentinfo dialog skip".split()
)
#: Of these, those that mark what is no article inside an article too, as a whole class, id or role.
MARKED_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe share sharing social related recommended sidebar breadcrumb breadcrumbs "
    "menu nav navbar navigation footer comment comments disqus respond replies pagination".split()
)
_KEPT = frozenset("html body article main".split())


class Node:
    """An element: its tag, whether it goes by its tag or marks, its children and the hash of its subtree."""

    __slots__ = ("children", "dropped", "has_text", "mark", "tag")

    def __init__(self, tag: str, dropped: bool):
        self.tag, self.dropped, self.children, self.mark, self.has_text = tag, dropped, [], 0, False


def _goes(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no article by its tag or marks; inside an article its header stays, and fewer marks count."""
    if tag in DROPPED:
        return not (inside and tag == "header")
    if not attributes or tag in _KEPT:
        return False
    seen = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _SEEN or name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        value = value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" and not inside:  # inside an article that is for readers by eye
            return True
        if name in ("class", "id", "role") and not (MARKED_INSIDE.isdisjoint(value.split()) if inside else MARKED.isdisjoint(re.split(r"[^a-z0-9]+", value))):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are repaired as browsers do in the common cases."""
    root = Node("#root", False)
    stack = [root]
    open_ = Counter()  # tags on the stack, so that a stray end tag costs nothing

    def close() -> None:
        node = stack.pop()
        open_[node.tag] -= 1
        state = xxhash.xxh3_64(node.tag)
        for c in node.children:
            if isinstance(c, Node):
                state.update(c.mark.to_bytes(8, "little"))
                node.has_text |= c.has_text
            elif words := c.split():
                state.update(" ".join(words))
                node.has_text = True
        node.mark = state.intdigest()

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last:  # no tag ends behind this point
            stack[-1].children.append(_html.unescape(re.split("<[!?]", page[at:], maxsplit=1)[0]))
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(_html.unescape(m[0]))
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P and open_["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSED_BY_SAME and any(open_[x] > 0 for x in CLOSED_BY_SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY_SAME[tag]:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in SCOPES and stack[k].tag != "tr":
                    break
        node = Node(tag, _goes(tag, attributes, open_["article"] + open_["main"] > 0))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            stack.append(node)
            open_[tag] += 1
            close()
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_[tag] += 1
    while stack:
        close()
    return root


def _walk(root: Node):
    """Nodes that do not go by their tag or marks, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]


def subtree_hashes(page: str) -> tuple[int, list[int]]:
    """Hash of the whole page's text tree, and the different hashes of its elements that hold text."""
    root = parse(page)
    return root.mark, sorted({x.mark for x in _walk(root) if x is not root and x.has_text and x.tag not in ("html", "body")})


def main_text(page: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the page's article without template subtrees, in blocks joined by two line ends."""
    root = parse(page)
    tops = [x for x in _walk(root) if x.tag in ("article", "main") and x.has_text and x.mark not in template]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if words := "".join(line).split():
            blocks.append(" ".join(words))
        line.clear()

    inside: set[int] = set()
    for top in tops or [root]:
        if id(top) in inside:
            continue
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif not x.dropped and (x.mark not in template or x.tag in ("html", "body", "#root")):
                inside.add(id(x))
                if x.tag == "br":
                    line.append(" ")
                elif x.tag in INLINE:
                    todo += reversed(x.children)
                else:
                    flush()
                    todo += [None, *reversed(x.children)]
        flush()
    return "\n\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_TREES = "struct<page:long,parts:array<long>>"
_TREES_TYPE = pa.struct([("page", pa.int64()), ("parts", pa.list_(pa.int64()))])


def _trees(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages.to_pylist():
        mark, parts = subtree_hashes(page or "")
        out.append({"page": _signed(mark), "parts": [_signed(x) for x in parts]})
    return pa.array(out, _TREES_TYPE)


def _texts(pages: pa.Array, templates: pa.Array) -> pa.Array:
    return pa.array([main_text(p or "", {x & (1 << 64) - 1 for x in t or ()}) for p, t in zip(pages.to_pylist(), templates.to_pylist(), strict=True)], pa.string())


def host(url: str):
    """Lower-cased host of a URL column; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _parts(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Per page row its _host, its _key (of host and html), the hash of its text tree and those of its subtrees."""
    tree = F.arrow_udf(_trees, _TREES).asNondeterministic()
    rows = pages.select(host(url).alias("_host"), F.xxhash64(host(url), F.col(html)).alias("_key"), tree(F.col(html)).alias("t"))
    return rows.select("_host", "_key", "t.page", "t.parts")


def templates(parts: DataFrame, share: float = 0.5, min_pages: int = 5, many: int = 20, least_share: float = 0.1) -> DataFrame:
    """The template subtrees of each host, a row for each: _host, part. parts is what _parts gives.

    A subtree is template if it stands on `many` different pages of its host or more, where least_share of the host's
    pages spares what articles really repeat. On fewer pages than that it takes `share` of them, and min_pages. Pages
    of the same content count once, so copies of a page do not make its article a template.
    """
    different = parts.groupBy("_host", "page").agg(F.first("parts").alias("parts"))
    counts = different.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "parts")).alias("part")).groupBy("_host", "part").agg(F.count("*").alias("n"))
    totals = counts.where("part is null").select(F.col("_host").alias("_h"), F.col("n").alias("total"))
    n, total = F.col("n"), F.col("total")
    recurs = (n >= min_pages) & (n >= share * total) | (n >= many) & (n >= least_share * total)
    return counts.where((n >= min(min_pages, many)) & F.col("part").isNotNull()).join(totals, F.col("_host") == F.col("_h")).where(recurs).select("_host", "part")


def extract(pages: DataFrame, out: str = "main_text", url: str = "url", html: str = "html", **options) -> DataFrame:
    """pages with a column `out`: the main text, empty where there is none (null and empty html).

    Repeated rows each get their text; a null url is a host of its own. A column named like `out` is replaced. Pages
    meet their host's templates subtree by subtree, so that no row holds all templates of a host; what is joined is
    staged, so that a skewed join can be split.
    """
    pages = pages.drop(out)
    key, other, template = free(pages, "_key", "_other", "_template")
    parts = staged(_parts(pages, url, html))
    once = parts.groupBy("_key").agg(F.first("_host").alias("_host"), F.first("parts").alias("parts"))
    met = once.select("_host", "_key", F.explode("parts").alias("part")).join(staged(templates(parts, **options)), ["_host", "part"])
    lists = staged(met.groupBy(F.col("_key").alias(other)).agg(F.sort_array(F.collect_list("part")).alias(template)))
    found = pages.withColumn(key, F.xxhash64(host(url), F.col(html))).join(lists, F.col(key) == F.col(other), "left")
    return found.withColumn(out, F.arrow_udf(_texts, "string").asNondeterministic()(F.col(html), F.col(template))).drop(key, other, template)
