"""Keyword rules: a small table of rules compiled into one expression, so that every row is read once."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.rules import escaped, whole

# The longest pattern, and what makes a pattern unsafe.
LONGEST = 256
UNSAFE = (
    (r"\\[1-9]", "backreferences are disallowed"), (r"\(\?<([=!])", "lookbehind assertions are disallowed"),
    (r"\((?:[^()\\]|\\.)+\)(?:\+|\*|\{\d+(?:,\d*)?\})(?:\+|\*|\{\d+(?:,\d*)?\})", "nested quantified groups are disallowed"), (r"(?:\+|\*|\{\d+(?:,\d*)?\})(?:\+|\*|\{\d+(?:,\d*)?\})", "consecutive quantifiers are disallowed"),
)
#: A group that holds a quantifier and is itself repeated, as in (a+)+, can take exponential time in a backtracking matcher.
REPEATED = r"\([^()]*[+*][^()]*\)[+*{]"


@dataclass(frozen=True)
class Rule:
    """A keyword: match is exact, contains or regex; scope is title, content or title_content."""

    id: int
    keyword: str
    match: str = "contains"
    scope: str = "title_content"
    cased: bool = False
    others: Sequence[str] = ()


def refusal(pattern: str) -> str | None:
    """Why a pattern is not used, or None."""
    if not pattern:
        return "pattern is empty"
    if len(pattern) > LONGEST:
        return f"pattern exceeds {LONGEST} characters"
    for unsafe, reason in (*UNSAFE, (REPEATED, "repeated quantified groups are disallowed")):
        if re.search(unsafe, pattern):
            return reason
    try:
        re.compile(pattern)
    except re.error as e:
        return f"invalid regex: {e}"
    return None


def pattern(rule: Rule, term: str) -> str | None:
    """The term's pattern on a text in its own case or lower case; None if it must not be used."""
    if rule.match == "regex":
        return None if refusal(term) else term if rule.cased else f"(?i){term}"
    term = term if rule.cased else term.lower()
    return whole(term) if rule.match == "exact" and re.search("[A-Za-z0-9_]", term) else escaped(term)


def _trials(rule: Rule) -> list[tuple[str, str, str]]:
    """(scope, term, pattern) in the order in which they are tried: all terms on a scope before the next scope."""
    scopes = ["title", "content"] if rule.scope == "title_content" else [rule.scope]
    return [(s, t, p) for s in scopes for t in (rule.keyword, *rule.others) if (p := pattern(rule, t))]


def _column(scope: str) -> str:
    return "title" if scope == "title" else "body"


def hits(rows: DataFrame, rules: Sequence[Rule], id_: str = "id") -> DataFrame:
    """id, keyword_id, scope, term for each rule that a row matches, by its first trial; texts are lower-cased once."""
    texts = rows.select(id_, "title", "body", F.lower("title").alias("_title"), F.lower("body").alias("_body"))
    found = []
    for rule in rules:
        hit = None
        for scope, term, p in _trials(rule):
            held = F.coalesce(F.col(_column(scope) if rule.cased or rule.match == "regex" else f"_{_column(scope)}").rlike(p), F.lit(False))
            value = F.struct(F.lit(rule.id).alias("keyword_id"), F.lit(scope).alias("scope"), F.lit(term).alias("term"))
            hit = F.when(held, value) if hit is None else hit.when(held, value)
        if hit is not None:
            found.append(hit)
    return texts.select(id_, F.explode(F.array_compact(F.array(*found))).alias("h")).select(id_, "h.*")


def sql(rule: Rule, view: str) -> str:
    """The same hits in SQL."""

    def quoted(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    scope, term = "", ""
    for s, t, p in _trials(rule):
        text = _column(s) if rule.cased or rule.match == "regex" else f"lower({_column(s)})"
        held = f"WHEN regexp_matches({text}, {quoted(p)}) THEN"
        scope += f" {held} '{s}'"
        term += f" {held} {quoted(t)}"
    if not scope:
        return f"SELECT id, {rule.id} AS keyword_id, '' AS scope, '' AS term FROM {view} WHERE false"
    return f"SELECT * FROM (SELECT id, {rule.id} AS keyword_id, CASE{scope} END AS scope, CASE{term} END AS term FROM {view}) WHERE scope IS NOT NULL"


def snippets(text: Column, term: str, around: int) -> Column:
    """The text around every hit of the term (any case, hits do not overlap), with dots where it is cut."""
    n = len(term)
    pieces = F.split(F.lower(text), escaped(term.lower()))
    # the start of hit k is behind the first k pieces and the k - 1 hits between them
    ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(-n)) + n + F.length(p))))
    starts = F.when(F.size(pieces) > 1, F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def cut(s: Column) -> Column:
        low, high = F.greatest(F.lit(0), s - around), F.least(F.length(text), s + n + around)
        return F.concat(F.when(low > 0, "...").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "...").otherwise(""))

    return F.transform(starts, cut)
