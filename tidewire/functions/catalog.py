"""The four domains that candidates are collected for, and the wording that decides what belongs to them."""

from __future__ import annotations

from dataclasses import dataclass

from tidewire.functions import lexicons


@dataclass(frozen=True)
class Domain:
    """What a domain looks for: terms, tags with their patterns, objects of its own, hosts that speak for it, days it looks back."""

    name: str
    topics: tuple[str, ...] = ()
    impacts: tuple[str, ...] = ()
    tags: tuple[tuple[str, str], ...] = ()
    objects: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    window_days: int = 10
    default_tag: str = ""


# The catalog of domains, in order.
AI_TECH = Domain(
    "ai-tech",
    topics=(
        "artificial intelligence", "generative ai", "machine learning", "large language model", "semiconductor", "chip", "gpu", "accelerator", "data center",
        "robot", "agent", "openai", "anthropic", "gemini", "claude", "nvidia", "amd", "intel", "tsmc", "cuda", "人工智能", "大模型", "模型", "智能体", "机器人",
        "芯片", "半导体", "算力", "英伟达", "台积电",
    ),
    impacts=(
        "launch", "release", "acquire", "funding", "regulation", "ban", "export", "security", "research", "发布", "推出", "收购", "融资", "监管", "出口", "安全", "研究",
    ),
    tags=(
        ("芯片", "chip|semiconductor|gpu|cuda|芯片|半导体|算力|晶圆"), ("模型", "model|openai|anthropic|gemini|claude|大模型|模型|智能体|agent"),
        ("政策", "regulat|policy|ban|export|监管|政策|禁令|出口"), ("产业", "funding|acqui|revenue|market|融资|收购|营收|市场"),
        ("研究", "research|benchmark|paper|研究|论文|基准"),
    ),
    objects=(
        "product-release", "funding-round", "factory-capacity", "memory-capacity", "data-center", "ai-center", "watermark", "coding-agent", "ai-governance",
        "ai-policy-proposal", "agent-data-workflow", "executive-appointment", "ai-training", "model-report",
    ),
    hosts=("openai.com", "anthropic.com", "nvidia.com", "amd.com", "intel.com", "tsmc.com", "microsoft.com", "google.com"),
    window_days=10,
    default_tag="AI",
)
MARKETS = Domain(
    "markets",
    topics=(
        "market", "stock", "bond", "yield", "inflation", "cpi", "rate", "earnings", "revenue", "profit", "ipo", "acquisition", "oil", "economy", "市场", "股票",
        "债券", "收益率", "通胀", "利率", "财报", "营收", "利润", "上市", "收购", "油价", "经济",
    ),
    impacts=(
        "rate", "inflation", "earnings", "guidance", "acquisition", "ipo", "regulation", "tariff", "oil", "利率", "通胀", "财报", "指引", "收购", "上市", "监管",
        "关税", "油价",
    ),
    tags=(
        ("宏观", "inflation|cpi|rate|yield|econom|通胀|利率|收益率|经济"), ("公司", "earnings|revenue|profit|guidance|company|财报|营收|利润|公司"),
        ("资本", "ipo|funding|acqui|merger|上市|融资|收购|并购"), ("监管", "sec|regulat|policy|tariff|监管|政策|关税"), ("能源", "oil|gas|energy|原油|油价|天然气|能源"),
    ),
    objects=(*lexicons.INDICATORS, "funding-round", "equity-stake", "fraud-case", "financial-regulation"),
    hosts=("federalreserve.gov", "bls.gov", "bea.gov", "sec.gov", "eia.gov", "treasury.gov", "imf.org", "worldbank.org"),
    window_days=7,
    default_tag="投资市场",
)
WORLD = Domain(
    "world",
    topics=(
        "war", "conflict", "diplomacy", "sanction", "election", "trade", "security", "military", "peace", "border", "战争", "冲突", "外交", "制裁", "选举", "贸易",
        "安全", "军事", "和平", "边境",
    ),
    impacts=(
        "attack", "ceasefire", "agreement", "sanction", "tariff", "election", "military", "nuclear", "袭击", "停火", "协议", "制裁", "关税", "选举", "军事", "核",
    ),
    tags=(
        ("冲突", "war|attack|military|conflict|战争|袭击|军事|冲突"), ("外交", "diploma|talk|agreement|ceasefire|外交|谈判|协议|停火"),
        ("贸易", "trade|tariff|export|sanction|贸易|关税|出口|制裁"), ("安全", "security|nuclear|terror|安全|核|恐怖"),
        ("政治", "election|government|president|选举|政府|总统"),
    ),
    objects=(
        "sanctions-controls", "military-strike", "ceasefire-talks", "shipping-route", "earthquake", "security-agreement", "criminal-sentence", "identity-exposure",
        "humanitarian-access",
    ),
    hosts=("un.org", "nato.int", "consilium.europa.eu", "ec.europa.eu", "whitehouse.gov"),
    window_days=7,
    default_tag="国际新闻",
)
LEARNING = Domain(
    "learning",
    topics=(
        "education", "school", "university", "student", "teacher", "learning", "curriculum", "assessment", "literacy", "教育", "学校", "大学", "学生", "教师", "学习",
        "课程", "评估", "素养",
    ),
    impacts=(
        "policy", "research", "curriculum", "assessment", "artificial intelligence", "funding", "admission", "政策", "研究", "课程", "评估", "人工智能", "资金", "招生",
    ),
    tags=(
        ("AI 教育", r"artificial intelligence|\bai\b|人工智能|ai 教育"), ("高等教育", "university|college|higher education|大学|高校|高等教育"),
        ("基础教育", "k-12|school|teacher|小学|中学|学校|教师"), ("教育政策", "policy|government|funding|政策|政府|资金"),
        ("学习科学", "research|assessment|learning|研究|评估|学习"),
    ),
    objects=(
        "course-curriculum", "assessment", "ai-literacy", "education-policy", "student-support", "student-data", "mba-program", "creative-program", "learning-science",
        "teacher-training", "education-report", "learning-method", "higher-education-trend", "university-ranking", "ai-teaching", "research-program",
    ),
    hosts=("ibo.org", "oecd.org", "unesco.org", "worldbank.org"),
    window_days=14,
    default_tag="学习",
)
DOMAINS = (AI_TECH, MARKETS, WORLD, LEARNING)

# Wording of low news value, and what makes a market event.
LOW_VALUE = (
    r"\b(?:how to|how (?:businesses|enterprises|companies|organizations) (?:use|put|adopt|deploy)|from assistance to execution|tips? for|life hacks?"
    r"|out[- ]of[- ]office|celebrity tribute|fashion|recipe|horoscope|viral video|odd news|job details?|job posting|vacanc(?:y|ies)|careers? opportunity)\b"
    r"|生活技巧|职场技巧|自动回复|招聘信息|职位详情|猎奇|明星八卦|奇闻"
)
MARKET_CORE = (
    r"\b(?:stock markets?|stocks?|equities|shares?|bonds?|treasur(?:y|ies)|yields?|inflation|\bCPI\b|\bPPI\b|\bPCE\b|interest rates?|rate cuts?|rate hikes?|earnings?"
    r"|revenue|profit|guidance|\bIPO\b|acquisition|merger|funding round|financing|investors?|oil prices?|\bBrent\b|\bWTI\b|federal reserve|\bFed\b"
    r"|securities and exchange commission|\bSEC\b|financial regulation|tariffs?|economic growth|\bGDP\b)\b"
    r"|股市|股票|债券|国债|收益率|通胀|消费者价格指数|生产者价格指数|利率|降息|加息|财报|营收|利润|业绩|指引|上市|并购|融资|投资者|油价|原油|美联储|证交会|金融监管|关税|经济增长|国内生产总值"
)
MARKET_OBJECTS = (*lexicons.INDICATORS, "acquisition-target", "funding-round", "equity-stake", "fraud-case", "executive-governance", "financial-regulation")

# What entities and objects are called in follow-up queries.
ENTITY_LABELS = {
    "federal-reserve": "Federal Reserve 美联储", "united-nations": "United Nations 联合国", "united-states": "United States 美国", "european-union": "European Union 欧盟",
    "international-baccalaureate": "International Baccalaureate IB 国际文凭", "world-bank": "World Bank 世界银行",
}
OBJECT_LABELS = {
    "cpi": "CPI consumer prices", "ppi": "PPI producer prices", "pce": "PCE inflation", "interest-rate": "interest rate", "bond-yield": "bond yield",
    "earnings-results": "earnings results", "product-release": "product launch", "acquisition-target": "acquisition", "funding-round": "funding",
    "factory-capacity": "factory capacity", "data-center": "data center", "ai-center": "AI center", "course-curriculum": "course curriculum",
    "assessment": "assessment", "ai-literacy": "AI literacy", "education-policy": "education policy", "sanctions-controls": "sanctions export controls",
    "military-strike": "military strike", "ceasefire-talks": "ceasefire talks", "shipping-route": "shipping route", "oil-price": "oil price", "earthquake": "earthquake",
}

# What is no name although it is written like one.
GENERIC_NAMES = (
    "a", "an", "the", "new", "ai", "us", "u", "s", "ceo", "government", "company", "market", "report", "unique", "story", "model", "press release details",
    "press release", "exclusive", "details", "results", "but", "once", "slow", "kids",
)
GENERIC_NAME_TERMS = (
    r"\b(?:establish|infrastructure|financing|platforms?|mobilize|over|billion|million|capital|launch|release|report|results?|details?|exclusive|new|latest)\b"
)
NAME_VERBS = r"\b(?:with|partners?|adds?|launch(?:es|ed)?|reports?|announces?|exclusive|details?)\b"
NAME = r"\b((?:[A-Z][A-Za-z0-9.-]{2,}|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-z0-9.-]{2,}|[A-Z]{2,})){0,2})\b"
DATES = (
    r"\b(20\d{2}[-/]\d{1,2}[-/]\d{1,2})\b",
    r"(?i)\b((?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}(?:,?\s+20\d{2})?)",
    r"((?:20\d{2}年)?\d{1,2}月\d{1,2}日)",
)
#: Actions that objects imply where a text names none.
INFERRED = {"cpi": "data-release", "ppi": "data-release", "pce": "data-release", "earnings-results": "data-release", "model-report": "data-release", "earthquake": "occur", "education-policy": "policy"}
