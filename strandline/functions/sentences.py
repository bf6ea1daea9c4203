"""Sentences of a text, and why one is no candidate for a fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least lengths, share of symbols, words that hint at a verb, and phrases of notices.
LEAST, LEAST_HAN, LEAST_WORDS, MOST_SYMBOLS = 8, 20, 6, 0.20
VERBS = r"(?i)\b(is|are|was|were|be|has|have|had|will|would|can|could|should|may|might|announced|released|said|reported|launched|raised|reached|grew|fell|rose)\b"
NOTICES = (
    "广告声明：文内含有的对外跳转链接", "it之家所有文章均包含本声明", "聚焦全球优秀创业者，项目融资率", "一级市场金融信息和系统服务提供商", "推送和解读前沿、有料的科技创投资讯", "本文来自微信公众号", "原文标题", "封面来源", "未经允许不得转载",
    "本文为澎湃号作者", "声明：本文内容及配图由入驻作者撰写", "本文版权归作者所有", "本文系作者个人观点", "免责声明", "转载请注明出处", "点击下载", "扫码关注",
)


def sentences(text: Column) -> Column:
    """Sentences of LEAST characters and more in order, each once."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([。！？!?；;])\s*", "$1\n"), r"\n+")
    return F.array_distinct(F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) >= LEAST))


def refusal(sentence: Column) -> Column:
    """Why a sentence is left out: notice, code, shortness, label or title; null for candidates."""
    s = F.trim(sentence)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    han, verb = s.rlike(r"[\x{4e00}-\x{9fff}]"), s.rlike(VERBS)
    upper = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")))
    label = s.rlike("[:：]$") & (han | ~verb)
    title = ~han & (F.size(words) <= 6) & ~s.rlike("[0-9]") & ~verb & (upper >= F.greatest(F.lit(1), F.size(words) - 1))
    return (
        F.when(s == "", "empty").when(F.lower(s).rlike("|".join(NOTICES)), "boilerplate").when(F.regexp_count(s, F.lit(r"[{}\[\]();=<>|/\\`$#*]")) / F.length(s) > MOST_SYMBOLS, "code_like")
        .when(han & (F.length(s) < LEAST_HAN), "short_cjk").when(~han & (F.size(words) < LEAST_WORDS), "short_en").when(label, "label_like").when(title, "title_like")
    )
