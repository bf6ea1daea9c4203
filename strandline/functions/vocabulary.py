"""Word lists of the rule score and of event signatures.

Fixed values: scores depend on these very terms, numbers and orders. Longer lists (people, companies, topic lanes) are
parameters of the functions that use them, given as tables of the deployment.
"""

from __future__ import annotations

# Points by entity tier, and the institutions of each tier. Deployments add people and companies.
TIER_SCORES = {"S": 9.0, "A": 7.5, "B": 6.0, "C": 4.0}
TIERS = {
    "S": (
        "白宫", "white house", "国务院", "state department", "外交部", "联合国", "united nations", "北约", "nato", "欧盟", "european union", "克里姆林宫", "kremlin", "国防部", "pentagon", "五角大楼",
        "美联储", "federal reserve", "fed chair", "鲍威尔", "powell", "欧央行", "ecb", "拉加德", "lagarde", "中国人民银行", "人民银行", "潘功胜", "易纲", "日本央行", "boj", "植田和男", "英国央行", "boe",
        "财政部", "treasury department", "耶伦", "yellen", "imf", "international monetary fund", "世界银行", "world bank",
    ),
    "A": (
        "高盛", "goldman sachs", "摩根大通", "jpmorgan", "jp morgan", "摩根士丹利", "morgan stanley", "花旗", "citigroup", "citi", "瑞银", "ubs", "瑞信", "credit suisse", "汇丰", "hsbc", "伯克希尔", "berkshire",
        "巴菲特", "buffett", "桥水", "bridgewater", "黑石", "blackstone", "贝莱德", "blackrock", "先锋", "vanguard", "证监会", "csrc", "sec", "cftc", "finra",
    ),
    "B": (
        "startup", "初创", "独角兽", "隐形冠军", "专精特新", "a16z", "sequoia", "红杉", "高瓴", "hillhouse", "idg", "经纬", "真格", "benchmark", "accel", "lightspeed", "softbank", "软银", "vision fund",
        "y combinator", "yc", "founders fund",
    ),
}

# Salience bonus of event types and their terms.
EVENTS = {
    "summit_visit": (1.0, ("访华", "访美", "峰会", "会晤", "国事访问", "summit", "state visit", "bilateral talks", "meet with", "会谈")),
    "model_release": (1.0, ("发布模型", "新模型", "大模型", "model release", "new model", "gpt-", "claude ", "gemini ", "llama ", "frontier model", "重磅发布", "正式上线")),
    "policy_shift": (1.0, ("法案", "全面", "禁令", "出口管制", "实体清单", "ban ", "policy shift", "regulation", "行政令", "executive order", "立法", "征求意见稿")),
    "earnings": (0.5, ("财报", "业绩", "earnings", "revenue", "营收", "净利润", "guidance", "业绩会", "电话会", "earnings call")),
    "funding": (0.5, ("融资", "亿美元", "亿元", "series a", "series b", "series c", "raised", "valuation", "估值", "领投", "跟投")),
    "m_and_a": (0.5, ("并购", "收购", "merger", "acquisition", "takeover", "buyout", "战略投资", "全资收购")),
    "rate_decision": (0.5, ("降息", "加息", "利率决定", "rate decision", "fomc", "维持利率", "基点", "basis point")),
    "ipo_offering": (1.0, ("首次公开募股", "公开募股", " ipo", "ipo ", "public offering", "going public", "上市申请", "股票出售申请", "files for public", "filed for public", "largest ipo", "最大规模", "有史以来最大")),
    "disaster_casualty": (1.5, ("死亡", "遇难", "失联", "伤亡", "fatalities", "killed", "casualties", "dead", "missing")),
}

# Disasters, casualties, and words for several places.
DISASTERS = ("洪灾", "洪水", "山洪", "暴雨", "强降雨", "内涝", "地震", "台风", "山体滑坡", "flood", "landslide", "earthquake", "typhoon", "evacuation")
CASUALTIES = ("死亡", "遇难", "失联", "伤亡", "fatalities", "killed", "casualties", "dead")
SEVERAL_PLACES = ("多地", "多个省份", "数个省份", "跨省")

# Reach by level, and the terms of the levels in the order in which they are tried.
REACH_SCORES = {"systemic": 9.0, "sector": 7.0, "major_entity": 6.5, "entity": 5.5, "local": 3.5}
REACH = {
    "systemic": ("全面", "全球", "行业格局", "系统性", "重塑", "颠覆", "范式", "global", "systemic", "worldwide", "across the industry", "landscape", "游戏规则", "基础设施", "底层"),
    "sector": (
        "行业", "赛道", "生态", "供应链", "产业链", "sector", "industry-wide", "ecosystem", "vertical", "whole market", "全行业", "多地", "多个省份", "数个省份", "跨省", "several provinces", "首次公开募股", "公开募股",
        " ipo", "public offering", "上市",
    ),
    "local": ("当地", "区域", "试点", "省级", "市级", "local", "regional", "pilot", "province", "county"),
}

# Signs of commerce and narrow scope, what is exempt, and the caps.
COMMERCE = (
    "优惠", "折扣", "打折", "促销", "特价", "最低价", "最优惠", "清仓", "周年促销", "折扣优惠", "优惠活动", "我们最喜欢", "favorite deal", "anniversary sale", " gift guide", "gift guide", "memorial day", "black friday",
    "cyber monday", "阵亡将士", "discount", "% off", " off at", "best price", "lowest price", "on sale", "magsafe", "power bank", "充电宝", "适配器", "电源适配器", "earbuds", "charger", "订阅用户", "观看记录", "推荐内容",
    "套餐的订阅", "bundle subscriber", "watch history", "subscribers can", "available now",
)
NARROW = (
    "聘请", " hired", "hires", " hiring", " appoints", "任命", "首席战略", "修复", " fix ", "firmware", "patch notes", "review", "评测", " tested", "测试了", "hands-on", "上手", "power bank", "earbuds", "adapter", "charger",
    "controller", "headphones", "keyboard", "mouse", "smartwatch", "webcam", "充电宝", "适配器", "耳机", "控制器", "键盘", "鼠标", "手环",
)
EXEMPT = ("ipo", "initial public offering", "public offering", "going public", "首次公开募股", "公开募股", "上市", "股票出售", "stock sale", "files for", "filed for", "sec filing", "s-1")
CAPS = {"commerce": {"salience": 3.5, "reach": 3.5, "depth": 4.0}, "narrow": {"salience": 6.5, "reach": 5.5, "depth": 7.5}}

# Points by stars, bonus and other names of authority types, confidence by text status.
STARS = {1: 4.0, 2: 6.5, 3: 8.5}
AUTHORITY_BONUS = {"official": 1.0, "regulator": 1.0, "wire": 0.5, "primary": 0.5}
AUTHORITY_NAMES = {"official_blog": "official", "official_social": "official", "paper": "primary", "media": "wire", "newsletter": "wire"}
STATUS_CONFIDENCE = {"full": 0.92, "partial": 0.72, "summary_only": 0.48, "title_only": 0.22, "blocked": 0.0}

# Terms that stand for the same event across languages.
ANCHORS = (
    ("模型", "model"), ("大模型", "model"), ("发布", "launch"), ("推出", "launch"), ("上线", "launch"), ("版本", "version"), ("政策", "policy"), ("监管", "policy"), ("利率", "rate"), ("银行", "bank"), ("公司", "company"),
    ("芯片", "chip"), ("安全", "safety"), ("报告", "report"), ("model", "model"), ("launch", "launch"), ("release", "launch"), ("version", "version"), ("policy", "policy"), ("regulation", "policy"), ("rate", "rate"),
    ("bank", "bank"), ("company", "company"), ("chip", "chip"), ("safety", "safety"), ("report", "report"),
)

# Actions with their surfaces and polarity, modalities with their markers (first hit counts), places.
ACTIONS = (
    ("deny", ("deny", "denies", "denied", "否认", "驳斥"), "negative"), ("retract", ("retract", "retracted", "撤回", "撤销"), "negative"), ("confirm", ("confirm", "confirmed", "证实", "确认"), "positive"),
    ("launch", ("launch", "launched", "release", "released", "发布", "推出", "上线"), "positive"), ("approve", ("approve", "approved", "批准", "通过"), "positive"), ("acquire", ("acquire", "acquired", "收购"), "positive"),
    ("sue", ("sue", "sued", "lawsuit", "起诉", "诉讼"), "neutral"), ("investigate", ("investigate", "investigation", "调查"), "neutral"), ("plan", ("plan", "plans", "planned", "计划", "拟"), "neutral"),
)
MODALITIES = (
    ("denied", ("deny", "denies", "denied", "否认", "驳斥")), ("question", ("?", "？", "是否", "will ", "could ")), ("alleged", ("alleged", "accused", "被指", "涉嫌")), ("planned", ("plan", "plans", "planned", "计划", "拟", "将于")),
    ("reported", ("reportedly", "sources say", "据报", "消息称", "据称", "传闻")), ("confirmed", ("official", "announced", "confirmed", "官方", "宣布", "证实", "确认")),
)
PLACES = (
    ("beijing", "Beijing"), ("北京", "Beijing"), ("shanghai", "Shanghai"), ("上海", "Shanghai"), ("singapore", "Singapore"), ("新加坡", "Singapore"), ("washington", "Washington"), ("华盛顿", "Washington"),
    ("london", "London"), ("伦敦", "London"), ("tokyo", "Tokyo"), ("东京", "Tokyo"), ("hong kong", "Hong Kong"), ("香港", "Hong Kong"),
)
STOP_ENTITIES = ("about", "after", "before", "could", "from", "have", "into", "more", "report", "said", "says", "that", "their", "this", "with", "will", "消息", "报道", "今日", "表示", "宣布", "发布", "计划", "确认", "公司", "相关", "已经")
