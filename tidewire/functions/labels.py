"""What entities, acts and things are called in stories, and who did what in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import _BOUNDARY, bound, strip_html

# Names of entities in stories.
ENTITIES = {
    "openai": "OpenAI", "nvidia": "NVIDIA", "google": "Google", "anthropic": "Anthropic", "microsoft": "微软", "meta": "Meta", "apple": "苹果", "amazon": "亚马逊",
    "amd": "AMD", "intel": "英特尔", "tsmc": "台积电", "federal-reserve": "美联储", "sec": "美国证交会", "bls": "美国劳工统计局", "united-nations": "联合国",
    "china": "中国", "united-states": "美国", "european-union": "欧盟", "oecd": "OECD", "unesco": "UNESCO", "international-baccalaureate": "IB",
    "world-bank": "世界银行", "imf": "IMF", "sk-hynix": "SK海力士", "berkshire-hathaway": "伯克希尔", "alphabet": "Alphabet", "grok": "Grok",
    "mit-sloan": "MIT斯隆管理学院", "israel": "以色列", "iran": "伊朗", "oman": "阿曼", "indonesia": "印度尼西亚", "japan": "日本", "south-korea": "韩国",
    "north-korea": "朝鲜", "uae": "阿联酋", "russia": "俄罗斯", "ukraine": "乌克兰", "groq": "Groq", "france": "法国", "armenia": "亚美尼亚",
    "hugging-face": "Hugging Face", "research-team": "研究团队", "education-department": "教育部门", "hackers": "黑客", "university": "大学", "taliban": "塔利班",
    "strait-of-hormuz": "霍尔木兹海峡船舶通行量", "school": "学校", "students": "学生", "us-universities": "美国大学",
}
# Names of acts in stories.
ACTIONS = {
    "launch": "发布", "acquire": "收购", "funding": "筹集资金", "earnings": "公布业绩", "appoint": "调整管理层", "investigate": "启动调查", "security": "披露安全事件",
    "rates": "调整利率", "agreement": "达成合作", "restriction": "实施限制", "attack": "发动袭击", "policy": "实施新规", "build": "扩建", "stake-change": "增持",
    "reduce": "下调", "support": "推出支持措施", "negotiate": "推进谈判", "death": "确认去世", "rank-change": "公布排名变化", "misuse": "卷入滥用争议",
    "explain": "说明", "rescue": "开展救援", "implement": "启动实施", "fraud-charge": "指控欺诈", "sentence": "被判刑", "maintain": "维持", "update": "更新",
    "data-release": "发布数据", "occur": "发生", "research-find": "发现", "adopt": "引入", "join": "加入", "decline": "竞争力下滑", "enforce": "采取执法行动",
    "strengthen": "强化", "threaten": "威胁", "warn": "警告", "reach": "接触",
}
# Names of things in stories.
OBJECTS = {
    "cpi": "消费者价格指数", "ppi": "生产者价格指数", "pce": "个人消费支出价格指数", "interest-rate": "利率政策", "bond-yield": "债券收益率",
    "earnings-results": "经营业绩", "product-release": "新产品", "acquisition-target": "并购交易", "funding-round": "融资安排", "factory-capacity": "产能建设",
    "data-center": "数据中心", "ai-center": "AI中心", "course-curriculum": "课程改革", "assessment": "教育评估", "ai-literacy": "AI素养教育",
    "education-policy": "教育政策", "sanctions-controls": "制裁与出口管制", "military-strike": "军事行动", "ceasefire-talks": "停火谈判", "shipping-route": "航运安排",
    "oil-price": "油价变化", "earthquake": "地震救援", "memory-capacity": "AI内存产能", "equity-stake": "持股", "ev-target": "电动车销售目标",
    "fraud-case": "投资欺诈案件", "university-ranking": "世界大学排名", "image-abuse": "图像滥用问题", "watermark": "模型水印机制",
    "student-support": "学生父母支持计划", "mba-program": "MBA课程", "coding-agent": "企业编程智能体", "creative-program": "数字创意项目",
    "executive-governance": "上市前治理", "vaccine-health": "疫苗与健康议题", "security-agreement": "安全协议", "criminal-sentence": "刑事判决",
    "learning-science": "学习科学实验", "teacher-training": "教师培训", "education-report": "教育趋势报告", "learning-method": "学习方法",
    "higher-education-trend": "全球领先地位", "ai-teaching": "AI教学方案", "research-program": "科研计划", "financial-regulation": "金融监管事项",
    "student-data": "学生数据", "ai-governance": "国家安全治理", "ai-training": "AI人才培养", "identity-exposure": "身份泄露", "model-report": "开源模型观察报告",
    "threatened-person": "一名前阿富汗警员", "humanitarian-access": "受困家庭", "ai-policy-proposal": "AI政策建议", "agent-data-workflow": "智能体训练部署流程",
    "executive-appointment": "高管任命",
}
# Which act and which thing a text is told by, first ones first.
ACTION_ORDER = (
    "fraud-charge", "sentence", "threaten", "warn", "reach", "research-find", "join", "adopt", "decline", "enforce", "strengthen", "security", "restriction", "policy",
    "maintain", "update", "attack", "rescue", "negotiate", "stake-change", "reduce", "misuse", "death", "rank-change", "support", "implement", "agreement", "funding",
    "build", "launch", "data-release", "explain",
)
OBJECT_ORDER = (
    "memory-capacity", "equity-stake", "cpi", "ppi", "pce", "ev-target", "fraud-case", "criminal-sentence", "security-agreement", "student-data", "identity-exposure",
    "threatened-person", "humanitarian-access", "learning-method", "learning-science", "ai-teaching", "research-program", "higher-education-trend", "teacher-training",
    "education-report", "university-ranking", "financial-regulation", "ai-governance", "ai-policy-proposal", "agent-data-workflow", "executive-appointment", "ai-center",
    "ai-training", "model-report", "sanctions-controls", "earthquake", "military-strike", "shipping-route", "ceasefire-talks", "image-abuse", "watermark", "coding-agent",
    "student-support", "mba-program", "creative-program", "executive-governance", "funding-round", "factory-capacity", "data-center", "product-release",
)
# How texts name who acts, and what shows a result.
UNIVERSITIES = r"\b(?:u\.?s\.?|american) universities\b|美国大学"
HORMUZ = r"\bstrait of hormuz\b|霍尔木兹海峡"
JAPAN = r"\bjapan(?:ese)?\b|日本"
ACTION_LEAD = (
    r"^([A-Z][A-Za-z0-9.&'-]*(?:\s+[A-Z][A-Za-z0-9.&'-]*){0,3})\s+"
    r"(?:launches?|announces?|appoints?|acquires?|builds?|opens?|funds?|partners?|helps?|warns?|threatens?|releases?|introduces?|expands?)\b"
)
ENGLISH_LEAD = r"^([A-Z][A-Za-z0-9.&'-]*(?:\s+[A-Z][A-Za-z0-9.&'-]*){0,3})\s+"
NO_LEAD = r"^(?:what|how|why|when|where|who|latest|new|test)(?:\s|$)|\b(?:news|press release|report)$|price index news"
HAN_LEAD = (
    r"^([\p{IsHan}A-Za-z0-9·.-]{2,20})(?:正|已|将)?"
    r"(?=发布|推出|宣布|公布|启动|设立|建立|联合|合作|投资|融资|扩产|增持|收购|指控|调查|下调|发生|袭击|警告|警示|威胁|提议|签署|实施|推进|去世)"
)
RESULT = r"造成|导致|引发|获得|获批|拒绝|去世|死亡|受损|增长|下降|上升|持平|扩大|收缩|判刑|获刑|监禁|survivors?|concern|growth|decline|dead|damage|sentenced?|jailed?|imprisoned?"
RANKING_RESULT = r"(?:持平|保持稳定|上升|下降|进步|下滑|进入|跻身|升至|降至|holds? steady|advances?|rises?|falls?|declines?)"
RANKING = r"(?:排名|榜单|rankings?)"
COUNTED = r"\d+\s*(?:个|项|名|所|家)"
BROAD_TAG = r"^(?:AI|科技|产业|市场|国际新闻|高等教育|学习)$"


def _any(p: str) -> str:
    return "(?iu)" + p.replace(r"\b", _BOUNDARY)


def _of(labels: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), value)


def display_entity(entity: Column) -> Column:
    """An entity's name in stories; others with each of their words in capitals at the start."""
    words = F.transform(F.split(entity, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)))
    return F.coalesce(_of(ENTITIES, entity), F.array_join(words, ""))


def _first_in(order: tuple[str, ...], found: Column) -> Column:
    """The first of these that the array holds, else the array's first."""
    return F.coalesce(*(F.when(F.array_contains(found, v), F.lit(v)) for v in order), F.try_element_at(found, F.lit(1)))


def actor(text: Column, objects: Column, named_actions: Column, first: Column, about: dict[str, Column] | None = None, official: Column | None = None) -> Column:
    """Who a text says acts, as stories name it; empty if it says nobody.

    objects, named_actions and first, the first aliased entity, are the text's. about holds what the titles of the event's
    reports say besides: actions, universities and japan (whether they are named) and entity (the first); without it the
    text speaks for itself. official is the first entity in the name of an official publisher.
    """
    none = F.lit(None).cast("string")
    also = about or {"actions": F.array().cast("array<string>"), "universities": F.lit(False), "japan": F.lit(False), "entity": none}
    acts, entity, speaker = F.concat(named_actions, also["actions"]), F.coalesce(first, also["entity"]), none if official is None else official

    def chosen(clean: Column) -> Column:
        plain = F.regexp_replace(clean, r"(?i)^Press Release Details?\s*", "")
        lead = lambda p: bound(F.nullif(F.regexp_extract(plain, p.replace(r"\b", _BOUNDARY), 1), F.lit("")), lambda v: F.when(~v.rlike(_any(NO_LEAD)), v))
        return F.coalesce(
            F.when(text.rlike(_any(UNIVERSITIES)) | also["universities"], "美国大学"),
            F.when(F.array_contains(objects, "shipping-route") & text.rlike(_any(HORMUZ)), "霍尔木兹海峡船舶通行量"),
            F.when(F.array_contains(acts, "join") & (text.rlike(_any(JAPAN)) | also["japan"]), "日本"),
            F.when(F.array_contains(acts, "research-find"), "研究团队"),
            lead("(?i)" + ACTION_LEAD),
            display_entity(entity),
            display_entity(speaker),
            lead(ENGLISH_LEAD),
            F.nullif(F.regexp_extract(clean, HAN_LEAD, 1), F.lit("")),
            F.lit(""),
        )

    return bound(strip_html(text), chosen)


def action(text: Column, objects: Column, actions: Column) -> Column:
    """What a text says is done, as stories put it; empty if nothing. actions may follow from objects."""
    has = lambda c, v: F.array_contains(c, v)
    special = [
        (has(objects, "ai-policy-proposal"), "提出"), (has(objects, "agent-data-workflow"), "整合"), (has(objects, "executive-appointment"), "任命"),
        (has(actions, "security") & text.rlike(_any(r"\bhackers?\b|\btheft\b|黑客|窃取")), "窃取"), (has(actions, "decline") & has(objects, "shipping-route"), "下降"),
        (has(objects, "model-report"), "发布"), (has(actions, "build") & has(objects, "ai-center") & text.rlike(_any(r"\bopen(?:s|ed|ing)?\b|开设|设立")), "开设"),
        (has(objects, "funding-round") & has(actions, "agreement"), "联合设立"),
        ((has(objects, "memory-capacity") | has(objects, "factory-capacity")) & has(actions, "build"), "扩建"),
    ]
    return F.coalesce(*(F.when(test, F.lit(value)) for test, value in special), _of(ACTIONS, _first_in(ACTION_ORDER, actions)), F.lit(""))


def thing(text: Column, objects: Column, named_actions: Column, entities: Column, tags: Column) -> Column:
    """What a text says it is about, as stories name it; else the first telling tag of its event; else empty."""
    has = lambda v: F.array_contains(objects, v)
    officer = F.regexp_extract(text, r"(?i)appoints?\s+([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){1,3})\s+as\s+Chief Revenue Officer", 1)
    first = _first_in(OBJECT_ORDER, objects)
    holder = F.try_element_at(entities, F.lit(2))
    policeman = text.rlike(_any("former Afghan police worker|Afghan former police|阿富汗前警员"))
    telling = F.filter(tags, lambda t: (F.length(t) >= 2) & ~t.rlike(BROAD_TAG))
    return F.coalesce(
        F.when((has("data-center") | has("factory-capacity")) & text.rlike(_any(r"\bai factory\b")) & text.rlike(_any(r"\barmenia\b|亚美尼亚")), "亚美尼亚AI工厂"),
        F.when(has("executive-appointment") & (officer != ""), F.concat(officer, F.lit("为首席营收官"))),
        F.when(has("fraud-case") & text.rlike(_any("pre[- ]?ipo")), "Pre-IPO投资骗局"),
        F.when(has("fraud-case") & text.rlike(_any("orthodox jewish communit(?:y|ies)")), "针对正统派犹太社区的投资骗局"),
        F.when(has("identity-exposure") & policeman, F.when(F.array_contains(named_actions, "threaten"), "一名前阿富汗警员").otherwise("身份因泄密曝光的阿富汗前警员")),
        F.when(has("funding-round") & (has("data-center") | text.rlike(_any("ai compute infrastructure"))), "AI算力基础设施融资平台"),
        F.when((first == "equity-stake") & holder.isNotNull(), F.concat(display_entity(holder), F.lit("股份"))),
        _of(OBJECTS, first),
        F.try_element_at(telling, F.lit(1)),
        F.lit(""),
    )


def is_concrete(text: Column, who: Column, what: Column, objects: Column, placeholder: Column, ranking_event: Column) -> Column:
    """Whether a headline says who did what to what: an actor, and an act with a thing or a result; or a result in a ranking."""
    result = text.rlike("(?iu)" + RANKING_RESULT) & text.rlike("(?iu)" + RANKING)
    told = (F.size(objects) > 0) | text.rlike(COUNTED) | text.rlike("(?iu)" + RESULT)
    return ~placeholder & (who != "") & ((ranking_event & result) | ((what != "") & told))


def location_name(location: Column) -> Column:
    return F.coalesce(_of(ENTITIES, location), location)


def known_entities(entities: Column) -> Column:
    """Those with a name in stories, under it, each once."""
    return F.array_distinct(F.filter(F.transform(entities, lambda e: _of(ENTITIES, e)), lambda v: v.isNotNull()))

