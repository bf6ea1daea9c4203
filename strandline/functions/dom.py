"""A small tree of a page for functions on rows: parsing, selectors and texts.

Selectors are comma lists of compounds (tag, .class, #id, [name], [name=value], [name*=value], [name^=value], [name$=value],
[name~=value]) joined by white space (inside) or > (child). Anything else is refused.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the named kinds.
ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    """A tag with attributes, children (elements and texts) and its parent."""

    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in page order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def strings(self) -> Iterator[str]:
        todo: list = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            else:
                todo += reversed(c.children)

    def text(self, between: str = " ") -> str:
        """Its strings, each trimmed, empty ones left out."""
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def get(self, name: str) -> str:
        return self.attributes.get(name) or ""

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if self.open[-1].tag in ends:
            self.open.pop()
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, max(0, len(self.open) - 64), -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(page: str | None) -> Element:
    """The tree of a page; null is an empty page."""
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


_PART = re.compile(r"""\s*(>)?\s*([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+|\[\s*[\w-]+\s*(?:[*^$~]?=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\])*)""")
_TEST = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+))\s*)?\]""")


@functools.lru_cache(512)
def compiled(selector: str) -> tuple:
    """Alternatives of a selector: steps of (child only, tag, tests), the last first."""
    out = []
    for alternative in selector.split(","):
        at, steps, alternative = 0, [], alternative.strip()
        while at < len(alternative):
            m = _PART.match(alternative, at)
            if not m or m.end() == at or not (m[2] or m[3]):
                raise ValueError(f"selector not understood: {selector}")
            tests = tuple((t[1], t[2], "", "") if t[1] else ("[", t[3].lower(), t[4] or "", t[5] or t[6] or t[7] or "") for t in _TEST.finditer(m[3]))
            steps.append((bool(m[1]), (m[2] or "*").lower(), tests))
            at = m.end()
        if not steps:
            raise ValueError(f"selector not understood: {selector}")
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _is(e: Element, tag: str, tests: tuple) -> bool:
    if tag not in ("*", e.tag):
        return False
    for kind, name, op, value in tests:
        if kind == ".":
            ok = name in e.get("class").split()
        elif kind == "#":
            ok = e.get("id") == name
        else:
            have = e.attributes.get(name)
            ok = have is not None and {"": True, "=": have == value, "*=": bool(value) and value in have, "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "~=": value in have.split()}[op]
        if not ok:
            return False
    return True


def _fits(e: Element, steps: tuple, top: Element) -> bool:
    child, tag, tests = steps[0]
    if not _is(e, tag, tests):
        return False
    if len(steps) == 1:
        return True
    up = e.parent
    while up is not None and up.tag != "#root":
        if _fits(up, steps[1:], top):
            return True
        if child:
            return False
        up = up.parent
    return False


def select(root: Element, selector: str) -> Iterator[Element]:
    """Elements below root that fit a selector, in page order."""
    alternatives = compiled(selector)
    return (e for e in root.walk() if any(_fits(e, steps, root) for steps in alternatives))
