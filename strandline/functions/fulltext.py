"""Why a fetched text can be used or not: walls, templates, listings, and the grade of real texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of walls and of page templates.
CAPTCHA = ("captcha", "i'm not a robot", "verify you are human", "are you a robot", "请完成验证", "人机验证", "安全验证", "滑动验证")
BOT_WALL = (
    "access denied", "you have been blocked", "request blocked", "attention required", "cloudflare", "ddos protection by", "enable javascript and cookies to continue", "checking your browser",
    "访问被拒绝", "您的访问被拒绝", "访问受限",
)
LOGIN = (
    "sign in to continue", "please log in", "please sign in", "log in to read", "subscribe to continue", "subscribers only", "create a free account",
    "登录后查看", "请登录", "登录后阅读", "登录以继续", "注册后阅读", "开通会员", "登录账号",
)
PAYWALL = ("this article is for subscribers", "to continue reading", "unlock this article", "become a member", "start your free trial", "this content is reserved", "付费阅读", "订阅后阅读", "会员专享", "开通订阅")
TEMPLATE = (
    "cookie", "privacy policy", "terms of service", "all rights reserved", "subscribe", "newsletter", "sign up", "follow us", "advertisement", "©", "menu", "search", "home", "contact us",
    "隐私政策", "服务条款", "版权所有", "订阅", "广告", "关注我们", "免责声明", "关于我们", "网站声明", "联系方式", "用户反馈", "网站地图", "友情链接", "关联话题", "举报电话", "举报邮箱", "沪ICP备", "沪公网安备", "互联网新闻信息服务许可证",
)
SHORT, TEMPLATE_BELOW, TEMPLATE_TERMS, FULL, PARTIAL, PARTIAL_PARTS, SUMMARY = 400, 1200, 3, 1200, 400, 220, 50


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    out = text.contains(terms[0])
    for t in terms[1:]:
        out = out | text.contains(t)
    return out


def template_terms(low: Column) -> Column:
    """How many of the template phrases a lower-cased text has."""
    return sum((F.when(low.contains(t), 1).otherwise(0) for t in TEMPLATE), F.lit(0))


def title_match(title: Column, body: Column) -> Column:
    """Share of a title's words of three letters and more that the body has; null without a title."""
    low, text = F.lower(F.trim(title)), F.lower(body)
    words = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 3)
    share = F.round(F.size(F.filter(words, lambda w: text.contains(w))) / F.size(words), 3)
    return F.when(low == "", None).when(F.size(words) == 0, F.when(text.contains(low), 1.0).otherwise(0.0)).otherwise(share)


def measures(title: Column, body: Column, summary: Column) -> dict[str, Column]:
    """What verdict() reads, of cleaned texts: project them once."""
    low = F.lower(body)
    blob = F.lower(F.concat_ws("\n", title, body, summary))
    parts = F.size(F.filter(F.split(body, r"[\n\r]+|(?<=[.!?。！？])\s+"), lambda p: F.length(F.trim(p)) >= 40))
    return {
        "f_title": F.length(title), "f_body": F.length(body), "f_summary": F.length(summary), "f_template": template_terms(low), "f_match": title_match(title, body),
        "f_captcha": _any(blob, CAPTCHA), "f_bot": _any(blob, BOT_WALL), "f_login": _any(blob, LOGIN + PAYWALL), "f_parts": F.when(parts > 0, parts).when(F.length(body) >= 80, 1).otherwise(0),
    }


def verdict(article_url: Column | None = None) -> dict[str, Column]:
    """status (11 of them), score, reason, template_ratio and the coarse status, from the columns of measures().

    article_url says whether the URL is shaped like an article's; null where there is none.
    """
    c = F.col
    short = c("f_body") < SHORT
    listing = F.lit(False) if article_url is None else F.coalesce(~article_url, F.lit(False)) & F.coalesce(c("f_match") < 0.34, F.lit(False)) & (c("f_body") >= 50)
    nothing = (c("f_body") == 0) & (c("f_summary") == 0) & (c("f_title") == 0)
    grown = F.greatest(F.lit(0.78), F.least(F.lit(1.0), c("f_body") / 2400.0 + 0.1 * c("f_parts")))
    ladder = (
        (short & c("f_captcha"), "captcha", 0.0, "captcha_detected"), (short & c("f_bot"), "bot_wall", 0.0, "bot_wall_detected"), (short & c("f_login"), "login_required", 0.0, "login_or_paywall"),
        (nothing, "empty", 0.0, "no_text"), ((c("f_body") < TEMPLATE_BELOW) & (c("f_template") >= TEMPLATE_TERMS), "boilerplate_only", 0.05, "boilerplate_dominated"), (short & listing, "non_article", 0.08, "non_article_url"),
        ((c("f_body") >= FULL) & (c("f_parts") >= 3), "full", grown, "full_body"), ((c("f_body") >= PARTIAL) | (c("f_body") >= PARTIAL_PARTS) & (c("f_parts") >= 2), "partial", 0.55, "partial_body"),
        (c("f_summary") >= SUMMARY, "summary_only", 0.3, "summary_only"), (c("f_title") > 0, "title_only", 0.12, "title_only"),
    )

    def of(at: int, other: Column) -> Column:
        out = None
        for row in ladder:
            value = row[at] if isinstance(row[at], Column) else F.lit(row[at])
            out = F.when(row[0], value) if out is None else out.when(row[0], value)
        return out.otherwise(other)

    status = of(1, F.lit("empty"))
    return {
        "status": status, "score": F.round(of(2, F.lit(0.0)), 3), "reason": of(3, F.lit("no_usable_text")), "template_ratio": F.when(nothing, None).otherwise(F.round(F.least(F.lit(1.0), c("f_template") / 6.0), 3)),
        "coarse": F.when(status.isin("full", "partial", "summary_only", "title_only"), status).otherwise("blocked"),
    }
