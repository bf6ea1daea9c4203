"""Column functions of fetch acceptance, source upkeep and event presentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import clean, escaped

# Least lengths, phrases of paywalls, roles of sources with weights and priorities, thresholds of sections and suggestions.
LEAST_SUMMARY, LEAST_BODY = 50, 100
PAYWALL = ("subscribe to read", "become a member", "exclusive for subscribers", "paywall", "create an account to continue reading", "订阅解锁全文", "付费阅读")
ROLE_WEIGHTS = {"official": 1.0, "original": 1.0, "wire": 1.0, "commentary": 0.6, "reprint": 0.0, "aggregator": 0.2, "unknown": 0.4}
ROLE_PRIORITY = {"official": 7, "original": 6, "wire": 5, "commentary": 3, "unknown": 2, "reprint": 1, "aggregator": 0}
NEED_IMPORTANCE, NEED_INCREMENTAL, NEED_CONFIDENCE = 70.0, 45.0, 55.0
LEAST_SIGNALS, LEAST_MAJORITY = 3, 0.72


def listing_summary(summary: Column, body: Column) -> Column:
    """The summary, or the first 500 characters of the text where its cleaned form is short and the text is not."""
    text = F.trim(F.coalesce(body, F.lit("")))
    filled = F.concat(F.substring(text, 1, 500), F.when(F.length(text) > 500, "...").otherwise(""))
    return F.when((F.length(clean(summary)) >= LEAST_SUMMARY) | (F.length(text) < LEAST_SUMMARY), summary).otherwise(filled)


def acceptance(kind: Column, title: Column, summary: Column, body: Column, status: Column, authority: Column, size: Column, paragraphs: Column) -> Column:
    """Reason of acceptance (ok...) or refusal of a fetched row, by content type; summary is cleaned, size and paragraphs are the cleaned text's."""
    no_title, no_body = F.trim(title) == "", F.trim(body) == ""
    web = (
        F.when(no_title, "missing_title").when((status == "title_only") & authority.isin("official", "regulator"), F.concat(F.lit("ok_relaxed_title_only_"), authority))
        .when(F.length(summary) < LEAST_SUMMARY, "missing_summary").when(status == "blocked", "blocked").when(~status.isin("full", "partial", "summary_only"), F.concat(F.lit("insufficient_body_"), status))
        .when(status.isin("full", "partial") & (size > 1500) & (paragraphs <= 2), "suspicious_flat_text").otherwise("ok")
    )
    post = F.when(no_title & no_body, "x_tweet_empty").otherwise("ok")
    return F.when(kind.isin("website", "rss"), web).when(kind == "x", post).when(no_title & no_body, "empty_content").otherwise("ok")


def looks_binary(text: Column) -> Column:
    """Whether a text is likely binary data: signatures of images, null characters, or many replacement characters."""
    t = F.trim(text)
    head = F.substring(t, 1, 500)
    riff = t.startswith("RIFF") & F.substring(t, 1, 16).contains("WEBP")
    named = F.upper(head).contains("IHDR") & F.substring(F.upper(head), 1, 120).contains("PNG")
    lost = (F.length(t) >= 24) & (F.regexp_count(t, F.lit("�")) / F.length(t) > 0.12)
    found = F.substring(t, 1, 512).contains("\x89PNG\r\n\x1a\n") | t.startswith("ÿØÿ") | t.startswith("GIF87a") | t.startswith("GIF89a") | riff | head.contains("\x00") | named | lost
    return F.coalesce(found, F.lit(False))


def unreadable(body: Column) -> Column:
    """Why a paid text can't be read; null if it can."""
    low = F.lower(body)
    walled = low.rlike("|".join(escaped(p) for p in PAYWALL))
    return F.when(F.coalesce(F.length(F.trim(body)), F.lit(0)) < LEAST_BODY, "BODY_TOO_SHORT").when(walled, "PAYWALL_RESIDUAL_DETECTED")


def recovery(code: Column) -> Column:
    return F.when(code == "PAYWALL_RESIDUAL_DETECTED", "RE_AUTHENTICATE_COOKIE").when(code == "BODY_TOO_SHORT", "CHECK_SELECTOR_OR_PARSER").when(code.isNotNull(), "INSPECT_NETWORK_AND_PROXY")


def feed_status(parsed: Column, items: Column, newest: Column, now: Column, days: int = 30) -> Column:
    """parse_error, empty, stale (newest item more than `days` whole days old) or ok."""
    age = F.floor(F.timestamp_diff("HOUR", newest, now) / 24)
    return F.when(~parsed, "parse_error").when(items <= 0, "empty").when(age > days, "stale").otherwise("ok")


def _of(role: Column, values: dict) -> Column:
    out = F.lit(values["unknown"])
    for name, value in values.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def role_weight(role: Column) -> Column:
    return _of(role, ROLE_WEIGHTS)


def report_score(role: Column, body: Column, summary: Column, paywalled: Column | None = None) -> Column:
    """How well a report stands for its event."""
    access = F.lit(1) if paywalled is None else F.when(paywalled, 0).otherwise(1)
    size = lambda c, per, most: F.least(F.lit(float(most)), F.coalesce(F.length(c), F.lit(0)) / float(per))
    return _of(role, ROLE_PRIORITY) * 10 + size(body, 500, 20) + size(summary, 100, 5) + access


def incremental(seen: Column, sources: Column, fresh: Column, corroborated: Column, whole: Column) -> Column:
    """How much an event adds to what was seen of it: all if it is new, else by sources that are."""
    again = 25.0 + F.least(F.lit(35.0), fresh * 18.0) - F.when(fresh == 0, 12.0).otherwise(0.0)
    return F.when(seen, again).otherwise(72.0) + F.when(sources >= 2, 8.0).otherwise(0.0) + F.when(corroborated, 6.0).otherwise(0.0) + F.when(whole, 5.0).otherwise(0.0)


def section(importance: Column, added: Column, sure: Column, tier: Column) -> Column:
    must = (importance >= NEED_IMPORTANCE) & (added >= NEED_INCREMENTAL) & (sure >= NEED_CONFIDENCE)
    return F.when(must, "need_to_know").when((added >= 45) | F.coalesce(tier.isin("single_low", "single_high"), F.lit(False)), "brewing").otherwise("later")


def observation(pos: Column, neg: Column) -> list[Column]:
    """confidence (the majority's share) and suggested rule."""
    total = pos + neg
    share = F.when(total > 0, F.round(F.greatest(pos, neg) / total, 3)).otherwise(0.0)
    rule = F.when((total >= LEAST_SIGNALS) & (share >= LEAST_MAJORITY), F.when(neg > pos, "mute").otherwise("highlight"))
    return [share.alias("confidence"), rule.alias("suggested")]


def merged_warnings(*messages: Column) -> Column:
    """Messages trimmed, without empty and repeated ones, joined; null if none is left."""
    left = F.filter(F.array_distinct(F.transform(F.array_compact(F.array(*messages)), lambda m: F.trim(m))), lambda m: m != "")
    return F.when(F.size(left) > 0, F.array_join(left, "；"))


def cookies(header: Column) -> Column:
    """Names and values of a cookie header, one a semicolon or line."""
    parts = F.filter(F.transform(F.split(header, "[;\n]"), lambda p: F.trim(p)), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o.k == p.k)) == 0)
    return F.map_from_entries(last)


def highlight(text: Column, terms: Sequence[str], before: str = "<mark>", behind: str = "</mark>") -> Column:
    for term in sorted(terms, key=len, reverse=True):
        text = F.regexp_replace(text, f"(?i)({escaped(term)})", f"{before}$1{behind}")
    return text
