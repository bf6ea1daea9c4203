"""Column functions of the rule score: vocabulary hits, dimensions, caps, text quality, event score.

Terms are looked for as plain strings, which is several times faster than an alternation of them; patterns are for word
boundaries only, and run on texts that hold a term. Their classes are those that other engines' regular expressions share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .text import once

WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"


def escaped(term: str) -> str:
    return re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", term)


def any_of(terms: Sequence[str]) -> str:
    """Pattern of any of the terms anywhere in a lower-cased text."""
    return "|".join(escaped(t.lower()) for t in terms)


def whole(term: str) -> str:
    """Pattern of a term that begins and ends at word boundaries."""
    before = f"(?:^|{OTHER})" if re.match(r"\w", term[0]) else WORD
    behind = f"(?:$|{OTHER})" if re.match(r"\w", term[-1]) else WORD
    return before + escaped(term) + behind


def any_entity(terms: Sequence[str]) -> str:
    """Pattern of any of the terms: ASCII terms as whole words, others anywhere. Words that begin and end alike share their boundaries."""
    plain = [t.lower() for t in terms if t.isascii() and re.match(r"\w", t[0]) and re.match(r"\w", t[-1])]
    rest = [whole(t.lower()) if t.isascii() else escaped(t.lower()) for t in terms if t.lower() not in plain]
    words = [f"(?:^|{OTHER})(?:{'|'.join(map(escaped, plain))})(?:$|{OTHER})"] if plain else []
    return "|".join([*words, *rest])


def has(c: Column, terms: Sequence[str]) -> Column:
    """Whether a lower-cased text holds any of the terms: the same as any_of(), by plain search."""
    return reduce(or_, [F.contains(c, F.lit(t.lower())) for t in terms], F.lit(False))


def names(c: Column, terms: Sequence[str]) -> Column:
    """Whether a lower-cased text names any of the terms, as any_entity() says; only texts that hold one are matched."""
    return has(c, terms) & c.rlike(any_entity(terms))


def headline(title: Column, summary: Column, limit: int = 600) -> Column:
    """Lower-cased title and summary, the part that salience and reach look at."""
    return F.lower(F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))), 1, limit))


#: Columns of hits(): which lists a title (t_) or a headline (h_) has a term of.
HITS = (
    "h_s", "h_a", "h_b", "h_bonus", "h_disaster", "t_disaster", "h_dead", "t_dead", "t_places", "h_systemic", "h_sector", "h_local", "h_major", "h_exempt", "h_commerce", "t_commerce", "h_narrow", "t_narrow",
)


def hits(title: Column, head: Column, tiers: Mapping[str, Sequence[str]] = v.TIERS) -> dict[str, Column]:
    """Every vocabulary matched once against the lower-cased title or headline; salience, reach and cap_scope read these columns."""
    bonus = F.greatest(*[F.when(has(head, terms), add).otherwise(0.0) for add, terms in v.EVENTS.values()])
    tested = {
        "h_s": names(head, tiers["S"]), "h_a": names(head, tiers["A"]), "h_b": names(head, tiers["B"]), "h_bonus": bonus, "h_disaster": has(head, v.DISASTERS), "t_disaster": has(title, v.DISASTERS),
        "h_dead": has(head, v.CASUALTIES), "t_dead": has(title, v.CASUALTIES), "t_places": has(title, v.SEVERAL_PLACES), **{f"h_{k}": has(head, v.REACH[k]) for k in ("systemic", "sector", "local")},
        "h_major": has(head, tiers["S"]), "h_exempt": has(head, v.EXEMPT), "h_commerce": has(head, v.COMMERCE), "t_commerce": has(title, v.COMMERCE), "h_narrow": has(head, v.NARROW), "t_narrow": has(title, v.NARROW),
    }
    return {k: tested[k] for k in HITS}


def salience(head: Column, user_terms: Sequence[str] = ()) -> Column:
    """Tier of the best entity, best event bonus, user terms (up to 2), at least the floor for disasters; up to 10."""
    base = F.when(F.col("h_s"), v.TIER_SCORES["S"]).when(F.col("h_a"), v.TIER_SCORES["A"]).when(F.col("h_b"), v.TIER_SCORES["B"]).otherwise(v.TIER_SCORES["C"])
    user = F.least(F.lit(2.0), sum((head.rlike(any_entity([t])).cast("double") for t in user_terms), F.lit(0.0)))
    floor = F.when(F.col("t_disaster") & F.col("t_dead"), 9.0).when(F.col("h_disaster") & F.col("h_dead"), 8.5).when(F.col("h_disaster"), 7.5).otherwise(0.0)
    return F.round(F.least(F.lit(10.0), F.greatest(base + F.col("h_bonus") + user, floor)), 1)


def reach() -> Column:
    wide = F.col("h_disaster") & F.col("t_places")
    out = F.when(wide & F.col("t_dead"), v.REACH_SCORES["systemic"]).when(wide, v.REACH_SCORES["sector"])
    for level in ("systemic", "sector", "local"):
        out = out.when(F.col(f"h_{level}"), v.REACH_SCORES[level])
    return out.when(F.col("h_major"), v.REACH_SCORES["major_entity"]).otherwise(v.REACH_SCORES["entity"])


def cap_scope() -> Column:
    """commerce, narrow or null: which caps bound the dimensions."""
    return F.when(F.col("h_exempt"), None).when(F.col("t_commerce") | F.col("h_commerce"), "commerce").when(F.col("t_narrow") | F.col("h_narrow"), "narrow")


def capped(score: Column, dimension: str, scope: Column) -> Column:
    out = score
    for name, caps in v.CAPS.items():
        out = F.when(scope == name, F.round(F.least(score, F.lit(caps[dimension])), 1)).otherwise(out)
    return out


def authority(stars: Column, kind: Column) -> Column:
    """Stars (1 to 3, 1 if unknown) and the bonus of the authority type, by any of its names."""
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(stars, F.lit(1))))
    base = F.when(level == 1, v.STARS[1]).when(level == 2, v.STARS[2]).otherwise(v.STARS[3])
    names = {**{k: k for k in v.AUTHORITY_BONUS}, **v.AUTHORITY_NAMES}
    bonus = F.lit(0.0)
    for name, known in names.items():
        bonus = F.when(F.lower(F.trim(kind)) == name, v.AUTHORITY_BONUS[known]).otherwise(bonus)
    return F.round(F.least(F.lit(10.0), base + bonus), 1)


#: Signs that end a sentence, and the white space of patterns that isn't a blank or a line's end.
ENDS, RARE = ".!?。！？", "\t\x0b\f\r"


def paragraph_count(text: Column, folded: bool = False) -> Column:
    """Parts of 40 characters or more between blank lines or behind ends of sentences; a text of 80 or more has one at least.

    `folded` says that the text has no white space but blanks. Cuts are written as tabs by plain replacement, of which none
    is left in the text by then, and parts are counted from their first to their last character that isn't a blank; that is
    cheaper than a split by a pattern that looks behind itself.
    """
    out = text
    if not folded:
        for c in RARE:
            out = F.replace(out, F.lit(c), F.lit(" "))
        out = F.replace(F.replace(out, F.lit("\n\n"), F.lit("\t")), F.lit("\n"), F.lit(" "))
    for c in ENDS:
        out = F.replace(out, F.lit(c + " "), F.lit(c + "\t"))
    if not folded:
        out = F.regexp_replace(out, " {2,}", " ")
    return F.greatest(F.regexp_count(out, F.lit(r"[^\t ][^\t]{38,}[^\t ]")), F.when(F.length(text) >= 80, 1).otherwise(0))


def facts(text: Column) -> Column:
    """Points for digits and quotation marks, up to 4."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.least(F.lit(4.0), 0.15 * F.regexp_count(text, F.lit("[0-9]")) + 0.4 * (2 * count('"') + count("'") + count("「")))


def depth(paragraphs: Column, points: Column, status: Column, content_type: Column) -> Column:
    """Paragraphs (up to 4), points of facts(), and the adjustment for posts and full texts; up to 10.

    All parts are multiples of 0.05, so the sum is brought back to two places before halves are rounded up.
    """
    adjust = F.when(content_type == "x", 2.0).when(status == "full", 1.0).otherwise(0.0)
    return F.round(F.round(F.least(F.lit(10.0), F.least(F.lit(4.0), 0.8 * paragraphs) + points + adjust), 2), 1)


def clean(text: Column) -> Column:
    """Text without tags, white space folded, then seven entities decoded, trimmed; texts without < or & are spared a pass."""
    text = F.coalesce(text, F.lit(""))
    out = folded = F.regexp_replace(F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text), r"\s+", " ")
    for name, value in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "...")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.when(F.contains(text, F.lit("&")), out).otherwise(folded))


def text_status(title: Column, body: Column, summary: Column, blocked: Column | None = None, paragraphs: Column | None = None) -> tuple[Column, Callable[[Column], Column]]:
    """Availability of the text (full, partial, summary_only, title_only, blocked), and its quality from 0 to 1 as a function of that; of cleaned texts."""
    n, s, paragraphs = F.length(body), F.length(summary), paragraph_count(body) if paragraphs is None else paragraphs
    status = F.when(F.lit(False) if blocked is None else blocked, "blocked").when((n >= 1200) & (paragraphs >= 3), "full")
    status = status.when((n >= 400) | (n >= 220) & (paragraphs >= 2), "partial").when(s >= 50, "summary_only").when(F.length(title) > 0, "title_only").otherwise("blocked")
    size, parts, brief = F.least(F.lit(1.0), n / 1600.0), F.least(F.lit(1.0), paragraphs / 5.0), F.least(F.lit(1.0), s / 300.0) * 0.45

    def quality(status: Column) -> Column:
        out = F.when(status == "full", F.greatest(F.lit(0.78), 0.65 * size + 0.35 * parts)).when(status == "partial", F.greatest(F.lit(0.45), F.least(F.lit(0.74), 0.55 * size + 0.35 * parts + 0.10 * brief)))
        return F.round(out.when(status == "summary_only", F.greatest(F.lit(0.24), F.least(F.lit(0.48), brief))).when(status == "title_only", 0.12).otherwise(0.0), 3)

    return status, quality


def confidence(status: Column, quality: Column) -> Column:
    """Confidence in a score by how much of the text was there."""
    evidence = F.lit(v.STATUS_CONFIDENCE["partial"])
    for name, value in v.STATUS_CONFIDENCE.items():
        evidence = F.when(status == name, value).otherwise(evidence)
    return F.round(0.65 * evidence + 0.35 * quality, 3)


def selection(score: Column, sure: Column) -> Column:
    return F.when((score >= 70) & (sure >= 0.65), "selected").when(score >= 55, "candidate").otherwise("rejected")


def tokens(text: Column) -> Column:
    """Distinct tokens of a mixed text: words of two ASCII letters or digits and more, pairs and triples of the Han characters in a row, and anchors."""

    def grams(han: Column, n: int) -> Column:
        return F.when(F.length(han) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(han) - (n - 1), F.lit(1))), lambda i: F.substring(han, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def of(low: Column) -> Column:
        anchors = F.array_compact(F.array(*[F.when(low.contains(needle), F.lit("sem:" + name)) for needle, name in v.ANCHORS]))
        both = once(F.regexp_replace(low, r"[^\x{4e00}-\x{9fff}]+", ""), lambda han: F.concat(grams(han, 2), grams(han, 3)))
        return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0)), both, anchors))

    return once(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), of)


def title_features(title: Column) -> Column:
    """Words of a title and the triples of its letters in a row; empty for titles that are too short to tell apart."""

    def of(words: Column) -> Column:
        enough = (F.length(F.array_join(words, " ")) >= 12) & (F.size(words) >= 2)
        return F.when(enough, F.concat(words, once(F.array_join(words, ""), triples))).otherwise(F.array().cast("array<string>"))

    def triples(compact: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(compact) - 2, F.lit(1)))
        return F.when(F.length(compact) >= 3, F.transform(places, lambda i: F.substring(compact, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))

    return once(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), of)


def simhash(features: Column) -> Column:
    """64-bit SimHash of features as 16 hex digits: SHA-1 bits, weighted by the features' lengths up to 8; empty without features."""
    half = lambda sha, start: F.conv(F.substring(sha, start, 8), 16, 10).cast("long")
    hashed = lambda f: once(F.sha1(f.cast("binary")), lambda sha: F.struct(half(sha, 1).alias("high"), half(sha, 9).alias("low"), F.least(F.length(f), F.lit(8)).alias("w")))

    def bits(rows: Column, part: str) -> Column:
        def vote(b: Column) -> Column:
            total = F.aggregate(rows, F.lit(0), lambda s, x: s + F.when(F.getbit(x[part], b) == 1, x.w).otherwise(-x.w))
            return F.when(total >= 0, "1").otherwise("0")

        digits = F.array_join(F.transform(F.sequence(F.lit(31), F.lit(0)), lambda b: vote(b.cast("int"))), "")
        return F.lpad(F.lower(F.conv(digits, 2, 16)), 8, "0")

    voted = lambda f: once(F.transform(f, hashed), lambda rows: F.concat(bits(rows, "high"), bits(rows, "low")))
    return once(features, lambda f: F.when(F.size(f) > 0, voted(f)).otherwise(""))


def momentum(size: Column, recent: Column) -> Column:
    return F.round(F.least(F.lit(10.0), 2.5 * F.log2(1.0 + size) + F.least(F.lit(2.0), 0.5 * recent)), 2)


def corroboration(independent: Column, stars: Column, official: Column) -> tuple[Column, Column]:
    """Points and tier by the number of independent sources."""
    high = (independent == 1) & ((stars >= 3) | official)
    points = F.when(independent >= 3, 9.0).when(independent == 2, 6.5).when(high, 5.5).otherwise(2.5)
    return points, F.when(independent >= 3, "strong").when(independent == 2, "moderate").when(high, "single_high").otherwise("single_low")
