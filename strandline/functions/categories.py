"""Digest categories by words of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order in which they win, with their words; and the one of all other texts.
CATEGORIES = (
    ("AI", (" ai", "openai", "anthropic", "gemini", "llm", "model", "人工智能", "大模型", "智能体")),
    ("汽车", ("car", "auto", "ev", "tesla", "byd", "蔚来", "小鹏", "理想", "汽车")),
    ("金融", ("bank", "bond", "fund", "insurance", "credit", "融资租赁", "证券", "基金", "保险", "信贷")),
    ("财经", ("ipo", "earnings", "economy", "market", "acquisition", "merger", "export", "revenue", "profit", "股价", "财报", "经济", "出口")),
    ("科技", ("tech", "startup", "chip", "semiconductor", "software", "app", "cloud", "developer", "科技", "芯片", "半导体")),
    ("政策", ("ministry", "government", "policy", "regulator", "外交部", "国务院", "部委", "政策", "监管")),
    ("国际", ("war", "iran", "ukraine", "pakistan", "india", "china", "eu", "外交", "国际", "冲突")),
)
OTHER = "重点"
_WORD = r"[a-z0-9.+-]+"


def ascii_word(term: str) -> bool:
    return re.fullmatch(_WORD, term.strip().lower()) is not None


def category(text: Column) -> Column:
    """The first category of which the text has a word: plain ones as whole tokens, others anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)))
    out = None
    for name, terms in CATEGORIES:
        whole = [t.strip().lower() for t in terms if ascii_word(t)]
        hit = F.arrays_overlap(words, F.array(*map(F.lit, whole)))
        for t in terms:
            if not ascii_word(t):
                hit = hit | low.contains(t.strip().lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)
