"""Details that texts give about their events: a table of rules, each with what must occur, a capture and a template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import _BOUNDARY, folded, needed


@dataclass(frozen=True)
class Rule:
    """A detail: its template takes the first group of the first pattern, if it has a place for it; all patterns must occur.

    exact: letter case counts in the first pattern. Of the rules of one group, the first that holds is used.
    """

    template: str
    patterns: tuple[str, ...]
    exact: bool = False
    group: str = ""


_FRENCH = r"universit(?:y|ies)|higher education institutions?"
_AI_POLICY = r"(?:AI|artificial intelligence).{0,40}(?:policy|policies)|(?:policy|policies).{0,40}(?:AI|artificial intelligence)"
_OFFICER = r"chief (?:revenue|commercial|operating|financial|technology) officer|首席(?:营收|商务|运营|财务|技术)官"
_BESIEGED = r"famil(?:y|ies).{0,48}(?:trapp|besieg|surround)|(?:trapp|besieg|surround).{0,48}famil(?:y|ies)"
_LEAK = r"(?:MoD|ministry of defence).{0,40}(?:leak|reveal)|(?:leak|breach).{0,40}identity"

# The rules, in order.
RULES = (
    Rule("此次资助{}个独立项目", (r"fund(?:ed|s|ing)?\s+(\d[\d,.]*)\s+(?:independent\s+)?projects?",)),
    Rule("合作方包括{}", (r"partner(?:ed|s|ing)?\s+with\s+([A-Z][\w.-]*(?:\s+[A-Z][\w.-]*){0,2})",), exact=True),
    Rule("项目面向学生和从业者", (r"students?\s+and\s+workers?|learners?\s+and\s+(?:workers?|employees?)",), group="audience"),
    Rule("产品面向企业客户", ("enterprise customers?",), group="audience"),
    Rule("项目面向AI基础设施客户", ("(?:artificial intelligence|AI) infrastructure customers?",), group="audience"),
    Rule("该机制用于识别生成内容", (r"identify\s+(?:AI[- ]?)?generated (?:material|content)",)),
    Rule("产品用于协作开发", ("collaborative (?:software )?development|code review and collaborative development",)),
    Rule("事件涉及{}一名前员工", ("former employee of ([A-Z][A-Za-z0-9&.' -]{1,40}?)(?:[.,;]|$)",)),
    Rule("受影响对象包括散户投资者", ("retail investors?",)),
    Rule("事件针对正统派犹太社区", ("orthodox jewish communit(?:y|ies)",)),
    Rule("英国国防部数据泄露暴露了该警员身份", ("former Afghan police worker|Afghan former police", _LEAK)),
    Rule("流程连接Strands Agents与LeRobot", ("strands agents?", "lerobot")),
    Rule("流程覆盖数据记录、训练与部署", (r"record,?\s*train,?\s*and deploy",)),
    Rule("数据可写入Hugging Face存储桶", ("storage buckets?",)),
    Rule("受影响家庭此前被定居者围困数日", (_BESIEGED, "settlers?")),
    Rule("法国共有{}所高校入榜", (rf"(\d[\d,.]*)\s+French\s+(?:{_FRENCH})",)),
    Rule("法国共有{}所高校入榜", (rf"(?:France|French).{{0,48}}?(\d[\d,.]*)\s+(?:{_FRENCH}|institutions?)",), group="in-france"),
    Rule("法国共有{}所高校入榜", (rf"(\d[\d,.]*)\s+(?:{_FRENCH}|institutions?).{{0,48}}?(?:in France|French)",), group="in-france"),
    Rule("其中{}所法国高校进入全球前100", (r"(\d[\d,.]*)\s+(?:French\s+)?(?:universit(?:y|ies)|institutions?).{0,32}(?:top|global)\s*100",)),
    Rule("法国共有27所高校入榜，其中4所进入全球前100", (r"\b27\b", r"\b(?:four|4)\b", "France|French", "universit|higher education institution", r"top\s*100")),
    Rule("学生参与提出并起草AI教育政策建议", ("draft(?:ed|ing)?|propos(?:al|e|ed|ing)|policy ideas?", "students?", _AI_POLICY)),
    Rule("建议面向全国K-12教育体系", (r"\bK-?12\b", "national|nationwide|federal", "students?", _AI_POLICY), group="k12"),
    Rule("建议聚焦K-12学校的AI使用规则", (r"\bK-?12\b", "students?", _AI_POLICY), group="k12"),
    Rule("新任高管此前任职于{}", (r"(?:joins?|joined)\s+(?:[A-Z][\w.-]+\s+)?from\s+([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,3})", _OFFICER), exact=True),
    Rule("新任高管将负责商业化与营收体系建设", ("go-to-market|commercial strategy|revenue organization|sales organization", _OFFICER)),
    Rule("课程面向在职专业人士", ("evening mba", "working professionals?|professionals? who work|在职专业人士")),
)
#: Fixed value: what a captured name does not end in.
TRAILING = r"\s+(?:[Oo][Nn]|[Tt][Oo]|[Ff][Oo][Rr])$"


def specific_details(text: Column) -> Column:
    """The details of a text, in the order of the rules, each once; none for null.

    Every pattern is tried only where a string that it needs occurs.
    """
    whole = F.coalesce(text, F.lit(""))

    def found(low: Column, row: Column, p: str, exact: bool) -> Column:
        full, some = row.rlike(("" if exact else "(?i)") + p.replace(r"\b", _BOUNDARY)), needed(p)
        if some is None:
            return full
        return F.exists(F.split(F.lit("\x1f".join(some)), "\x1f"), lambda s: F.contains(low, s)) & full

    def detail(low: Column, row: Column, rule: Rule) -> Column:
        holds = F.lit(True)
        for i, p in enumerate(rule.patterns):
            holds = holds & found(low, row, p, rule.exact and i == 0)
        head, _, tail = rule.template.partition("{}")
        if "{}" not in rule.template:
            return F.when(holds, F.lit(rule.template))
        part = F.trim(F.regexp_extract(row, ("" if rule.exact else "(?i)") + rule.patterns[0].replace(r"\b", _BOUNDARY), 1))
        if rule.template == "合作方包括{}":
            part = F.regexp_replace(part, TRAILING, "")
        return F.when(holds, F.concat(F.lit(head), part, F.lit(tail)))

    def listed(pair: Column) -> Column:
        low, row, out, at = pair["low"], pair["row"], [], {}
        for rule in RULES:
            value = detail(low, row, rule)
            if rule.group and rule.group in at:
                out[at[rule.group]] = F.coalesce(out[at[rule.group]], value)
            else:
                at[rule.group] = len(out)
                out.append(value)
        return F.array(*out)

    # The array of one pair binds the text and its folded form, so that each is worked out once for all rules.
    details = F.element_at(F.transform(F.array(F.struct(folded(whole).alias("low"), whole.alias("row"))), listed), 1)
    return F.array_distinct(F.filter(details, lambda x: x.isNotNull()))
