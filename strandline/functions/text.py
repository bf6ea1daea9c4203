"""Column functions on text and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities in the order in which they are decoded, and query parameters that only track.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
TRACKING = r"^(utm_.*|fbclid|from|gclid|igshid|mc_cid|mc_eid|mkt_tok|ref|source|spm|vero_id|yclid)$"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once for a row; an expression named inside a lambda runs again for every element."""
    return F.transform(F.array(value), then)[0]


def strip_tags(c: Column) -> Column:
    """Text without tags, with common entities decoded and white space folded."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_key(c: Column) -> Column:
    """Lower-cased title without anything but ASCII letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def paragraphs(c: Column, least: int = 40) -> Column:
    """Number of lines of `least` characters or more."""
    return F.size(F.filter(F.split(c, "\n"), lambda p: F.length(F.trim(p)) >= least))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def bare_host(url: Column) -> Column:
    """Host without www., m., mobile. or amp. in front."""
    return F.regexp_replace(host(url), r"^(www|m|mobile|amp)\.", "")


def registrable(url: Column) -> Column:
    """Last two labels of the host, for suffixes of one label."""
    return F.substring_index(host(url), ".", -2)


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", "")


def canonical_url(url: Column) -> Column:
    """https, bare host, path without a closing slash, other than tracking parameters sorted, no fragment."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING)))
    return F.concat(F.lit("https://"), bare_host(url), path(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def char_share(c: Column, pattern: str) -> Column:
    """Share of characters that match a class."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)).otherwise(0.0)
