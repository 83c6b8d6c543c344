"""What is told of an event: its print, the report that says most, a title, a summary and a story made by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import catalog, labels, lexicons
from tidewire.functions.checks import enough_chinese, has_english_fragment, has_html_artifact, is_placeholder_summary, is_placeholder_title, sentences
from tidewire.functions.details import specific_details
from tidewire.functions.numerals import raw_number_labels
from tidewire.functions.quantities import comparable
from tidewire.functions.text import dates_in, first_entity, found_in, hits, key_numbers, named_entities, normal_title, shorten, strip_html
from tidewire.operators.claims import adds_detail, matches, supports
from tidewire.operators.material import GENERIC_TITLE, prints, with_material
from tidewire.operators.tables import durable

# Wording of stories made by rules, and who is affected in each domain.
AFFECTED = {
    "ai-tech": ["技术供应商", "开发者与企业客户", "上下游产业链"], "markets": ["上市公司与投资者", "行业上下游", "消费者与融资主体"],
    "world": ["冲突或谈判直接参与方", "周边国家与居民", "全球能源、贸易与金融市场"], "learning": ["学生与家庭", "教师与学校管理者", "大学、教育平台与政策制定者"],
}
CHAIN = ["事件或政策信号出现", "相关主体调整资源与行为", "影响逐步传导至行业、市场或个人决策"]
SIGNALS = ["官方文件或数据", "相关参与方行动", "行业与市场的持续反应"]
NEAR = "如果后续出现官方补充信息或其他可靠来源的交叉验证，短期判断可能随证据变化。"
SUMMARY_CUES = "时间|地点|位于|用于|旨在|面向|覆盖|涉及|导致|造成|结果|计划|目标|同比|环比|参与方|受影响|期间|目前|其中"
MATH_TUTOR = r"math|review mistakes?|mastery learning|数学|纠错|错题"
GENERIC_HEADLINE = r"(?i)^(?:press release details?|news|article|homepage|untitled)$"
_KINDS = ("entities", "actions", "objects", "locations")


def _print_of(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with all that claims are compared by, of the column `text`, each name after the prefix."""
    value = F.col(text)
    more = prints(df, text, prefix).withColumn(f"{prefix}dates", dates_in(value)).withColumn(f"{prefix}numbers", key_numbers(value))
    return more.withColumn(f"{prefix}quantities", F.transform(f"{prefix}numbers", comparable)).withColumnRenamed(f"{prefix}tokens", f"{prefix}all_tokens")


def report_prints(reports: DataFrame) -> DataFrame:
    """with_material() reports, made so if they are not, with p_*: what a report, its publisher's name included, can support claims with."""
    rows = (reports if "material" in reports.columns else with_material(reports)).withColumn("_all", F.concat_ws(" ", "material", "source_name"))
    return _print_of(rows, "_all", "p_").drop("_all")


def event_context(reports: DataFrame, event: str = "event_id") -> DataFrame:
    """One row for each event with what its reports' titles say: e_entities, e_actions, e_objects and e_locations, sorted;
    said_actions, universities, japan and first_entity; official, the first entity in the name of an official publisher of
    its first report; and tags, if the reports have them.

    reports are with_material() rows with place. A title that names no event counts with its text; official publishers
    count by their names. Values are made distinct before they are gathered, so that a row holds the features of an
    event, not its reports.
    """
    generic = strip_html(F.col("title")).rlike(GENERIC_TITLE)
    official = F.when(F.col("reliability") == "primary", F.col("source_name"))
    rows = reports.select("*", F.concat_ws(" ", F.when(generic, F.col("anchor")).otherwise(F.col("title")), official).alias("_identity"))
    rows = prints(rows, "_identity", "i_").withColumn("_said", hits(F.col("title"), lexicons.ACTIONS))
    parts = {"entities": "i_entities", "named": "i_named", "objects": "i_objects", "locations": "i_locations", "said": "_said"}
    if "tags" in reports.columns:
        parts["tags"] = "tags"
    tagged = F.flatten(F.array(*(F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))) for kind, c in parts.items())))  # noqa: B023
    values = rows.select(event, F.explode(tagged).alias("x")).select(event, "x.*").distinct()
    gathered = values.groupBy(event).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in parts))
    lead = first_entity(F.col("title"))
    per = rows.groupBy(event).agg(
        F.bool_or(F.col("title").rlike(labels._any(labels.UNIVERSITIES))).alias("universities"), F.bool_or(F.col("title").rlike(labels._any(labels.JAPAN))).alias("japan"),
        F.min_by(lead, F.when(lead.isNotNull(), F.col("place"))).alias("first_entity"), F.min_by(official, "place").alias("_official"), F.min_by("domain", "place").alias("domain"),
    )
    none = F.array().cast("array<string>")
    found = per.join(gathered, event, "left").select("*", F.try_element_at(named_entities(F.col("_official")), F.lit(1)).alias("official"))
    of = lambda c: F.coalesce(c, none)
    implied = F.array_distinct(F.filter(F.array(*(F.when(F.array_contains("objects", o), F.lit(a)) for o, a in catalog.INFERRED.items())), lambda v: v.isNotNull()))
    acts = F.when(F.size(of("named")) > 0, F.col("named")).otherwise(of(implied))
    return found.select(
        event, "domain", of("entities").alias("e_entities"), acts.alias("e_actions"), of("objects").alias("e_objects"), of("locations").alias("e_locations"),
        of("said").alias("said_actions"), "universities", "japan", "first_entity", "official", of("tags").alias("tags") if "tags" in parts else none.alias("tags"),
    )


def _about() -> dict[str, Column]:
    return {"actions": F.col("said_actions"), "universities": F.col("universities"), "japan": F.col("japan"), "entity": F.col("first_entity")}


def concrete(text: str, prefix: str) -> Column:
    """Whether a headline says who did what, for rows with its prints and event_context()."""
    value = F.col(text)
    # Only what the headline names itself decides who acts; what is done may follow from its objects.
    who = labels.actor(value, F.col(f"{prefix}objects"), F.col(f"{prefix}named"), F.col(f"{prefix}first"), None, F.col("official"))
    what = labels.action(value, F.col(f"{prefix}objects"), F.col(f"{prefix}actions"))
    return labels.is_concrete(value, who, what, F.col(f"{prefix}objects"), is_placeholder_title(value), F.array_contains("e_objects", "university-ranking"))


def says_more(title: str, summary: str, title_prefix: str, prefix: str, fits: Column, supported: Column) -> Column:
    """Whether a summary tells what its title does not: 32 characters at least, of its event, supported, ten characters and two words
    beyond the title, and a detail or a cue of one."""
    t, s = F.col(title), F.col(summary)
    whole = (F.length(s) >= 32) & ~is_placeholder_summary(s) & ~has_html_artifact(s) & ~has_english_fragment(s)
    head, told = normal_title(t), normal_title(s)
    rest = F.length(told) - F.when((head != "") & F.contains(told, head), F.length(head)).otherwise(0)
    new = F.size(F.array_except(f"{prefix}all_tokens", f"{title_prefix}all_tokens"))
    detail = adds_detail(lambda c: F.col(f"{title_prefix}{c}"), lambda c: F.col(f"{prefix}{c}"))
    return whole & fits & supported & (rest >= 10) & (new >= 2) & (detail | s.rlike(SUMMARY_CUES))


def with_specificity(reports: DataFrame) -> DataFrame:
    """reports with how much each says, from what numeric.with_said() found if they have it: names, acts, things, numbers and words of the title."""
    text, title = F.concat_ws(" ", "title", "description"), F.col("title")
    said = {"entities": "r_entities", "named": "r_actions", "objects": "r_objects"} if "r_entities" in reports.columns else {}
    of = lambda c: F.size(F.col(said.get(c, f"_found.{c}")))
    specificity = (
        F.when(F.trim(title).rlike(GENERIC_HEADLINE), -100).otherwise(0) + of("entities") * 12 + of("named") * 10
        + of("objects") * 8 + F.size(key_numbers(text)) * 4 + F.least(F.lit(20), F.size(F.split(title, r"\s+")))
    )
    rows = reports if said else reports.withColumn("_found", found_in(text))
    return rows.withColumn("specificity", specificity).drop("_found")


def best_reports(reports: DataFrame, event: str = "event_id") -> DataFrame:
    """Each event's report that says most; ties by score, then URL."""
    specificity = F.col("specificity")
    score = F.col("score") if "score" in reports.columns else F.lit(0.0)
    ranked = (reports if "specificity" in reports.columns else with_specificity(reports)).select(event, "id", F.struct(-specificity, -score, F.col("url"), F.col("id")).alias("order"))
    return ranked.groupBy(event).agg(F.min_by("id", "order").alias("id"))


def _structured(title: Column) -> Column:
    """A summary put together from what the report on a row gives away; empty if it gives nothing."""
    objects, raw = F.col("m_objects"), F.col("_raw")
    first = F.try_element_at(objects, F.lit(1))
    others = F.slice(F.filter(labels.known_entities(F.col("m_entities")), lambda v: v != F.col("_actor")), 1, 4)
    numbers = F.slice(F.filter(raw_number_labels(raw), lambda n: ~F.contains(title, n)), 1, 2)
    places = F.array_distinct(F.transform("m_locations", labels.location_name))
    dates = F.slice(F.filter("m_dates", lambda d: ~F.contains(F.lower(title), d)), 1, 2)
    scale = (
        F.when(first == "funding-round", "计划涉及的资金规模为").when(first.isin("factory-capacity", "memory-capacity"), "相关扩建规模为")
        .when(first == "equity-stake", "相关持仓变动为").otherwise("事件中的关键数值为")
    )
    line = lambda values, head: F.when(F.size(values) > 0, F.concat(head, F.array_join(values, "、")))
    more = F.array(line(others, F.lit("相关参与方或受影响对象包括")), line(numbers, scale), line(places, F.lit("事件涉及")))
    solid = F.concat(specific_details(raw), F.filter(more, lambda v: v.isNotNull()))
    parts = F.slice(F.concat(solid, F.filter(F.array(line(dates, F.lit("相关时间为"))), lambda v: v.isNotNull())), 1, 2)
    who, what, to = F.col("_actor"), F.col("_action"), F.col("_thing")
    clause = F.when((who != "") & (what != "") & (to != ""), F.when(what == "发现", F.concat(who, F.lit("针对"), to, F.lit("的研究发现了成效变化"))).otherwise(
        F.concat(who, F.lit("这项涉及"), to, F.lit("的举措是"), what))).otherwise(F.concat(F.when(who == "", "相关主体").otherwise(who), F.lit("推进该事项")))
    whole = F.concat(clause, F.lit("；"), F.array_join(parts, "；"), F.lit("。"))
    return F.when((F.size(solid) > 0) & (F.length(whole) >= 32), shorten(whole, 160)).otherwise("")


def specific_content(reports: DataFrame, context: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, title, summary, url): what the rules tell of each event, from its report that says most.

    The report's title stands if it is Chinese, short and says who did what; else it is put together from names. The
    summary is the first Chinese sentence of a report that is of the event, supported by that report, and says more than
    the title; without one it is put together from details; empty if there are none. reports are report_prints() rows
    with place; context is their event_context().
    """
    body = [F.coalesce("full_text", F.lit(""))] if "full_text" in reports.columns else []
    best = reports.join(best_reports(reports, event).select("id"), "id").join(context.drop("domain"), event)
    best = best.withColumn("_title", strip_html(F.col("title"))).withColumn("_raw", strip_html(F.concat_ws(" ", "title", "description", *body)))
    # Of each event one row is left: what the title is made of is settled step by step, or the plan would repeat it.
    best = durable(_print_of(_print_of(prints(best, "anchor", "a_"), "material", "m_"), "_title", "t_"))

    def choose(pick, *sources):  # noqa: ANN001, ANN202
        found = [F.nullif(pick(*s), F.lit("")) for s in sources]
        return F.coalesce(*found, F.lit(""))

    about, official = _about(), F.col("official")
    who = lambda text, p: labels.actor(F.col(text), F.col(f"{p}objects"), F.col(f"{p}named"), F.col(f"{p}first"), about, official)
    what = lambda text, p: labels.action(F.col(text), F.col(f"{p}objects"), F.col(f"{p}actions"))
    to = lambda text, p: labels.thing(F.col(text), F.col(f"{p}objects"), F.col(f"{p}named"), F.col(f"{p}entities"), F.col("tags"))
    vague = is_placeholder_title(F.col("_title"))
    best = best.withColumn("_actor", choose(who, ("_title", "t_"), ("anchor", "a_")))
    best = best.withColumn("_action", F.coalesce(F.when(~vague, F.nullif(what("_title", "t_"), F.lit(""))), F.nullif(choose(what, ("anchor", "a_"), ("material", "m_")), F.lit("")), F.lit("")))
    best = best.withColumn("_thing", choose(to, ("anchor", "a_"), ("_title", "t_"), ("material", "m_")))
    best = durable(best.withColumn("_concrete", concrete("_title", "t_")))
    stands = enough_chinese(F.col("_title")) & (F.length("_title") <= 58) & ~vague & F.col("_concrete")
    tutor = F.array_contains("a_named", "research-find") & F.array_contains("a_objects", "learning-method") & F.col("anchor").rlike("(?iu)" + MATH_TUTOR)
    headline = F.when(tutor, "研究显示AI导师引导学生纠错可提升数学掌握度").when(stands, F.col("_title")).otherwise(F.concat("_actor", "_action", "_thing"))
    made = durable(best.withColumn("_headline", shorten(F.trim(F.regexp_replace(headline, r"\s+", " ")), 58)))
    made = durable(made.select(event, "url", "_headline", _structured(F.col("_headline")).alias("_made")))

    # Chinese sentences that their own report supports; each meets the one title of its event.
    chinese = F.filter(sentences(F.concat_ws(" ", "description", *body)), lambda s: enough_chinese(s) & ~is_placeholder_summary(s))
    # Texts without a Han character, or a reference to one, have no such sentence: they are not cut up.
    signed = reports.where(F.concat_ws(" ", "description", *body).rlike(r"\p{IsHan}|&#"))
    told = signed.select(event, "place", "url", *(f"p_{c}" for c in ("entities", "actions", "objects", "quantities", "all_tokens")), F.posexplode(chinese).alias("at", "sentence"))
    told = _print_of(told, "sentence", "s_").join(context.drop("tags"), event).join(made.select(event, "_headline"), event)
    told = _print_of(told, "_headline", "h_")
    fits = matches(lambda c: F.col(f"e_{c}"), lambda c: F.col(f"s_{c}"))
    own = supports(lambda c: F.col(f"s_{c}"), lambda c: F.col(f"p_{c}"))
    told = told.withColumn("_short", shorten(F.col("sentence"), 160)).where(fits & own).where(says_more("_headline", "_short", "h_", "s_", F.lit(True), F.lit(True)))
    first = told.groupBy(event).agg(F.min_by(F.struct("_short", F.col("url").alias("u")), F.struct("place", "at")).alias("told"))
    done = made.join(first, event, "left")
    return done.select(event, F.col("_headline").alias("title"), F.left(F.coalesce("told._short", "_made"), F.lit(260)).alias("summary"), F.coalesce("told.u", "url").alias("url"))


def rule_stories(events: DataFrame, content: DataFrame, event: str = "event_id") -> DataFrame:
    """The story that rules tell of each event (event, domain, level, source_count), from its specific_content().

    One row an event, with the fields of stories: texts as arrays, fact_urls the URLs behind each fact.
    """
    rows = events.select(event, "domain", "level", "source_count", *(["tags"] if "tags" in events.columns else [])).join(content, event)
    party = F.coalesce(*(F.when(F.col("domain") == d, F.array(*map(F.lit, v))) for d, v in AFFECTED.items()), F.array().cast("array<string>"))
    sources = F.when(
        F.col("source_count") > 1, F.concat(F.lit("该事件由 "), F.col("source_count").cast("string"), F.lit(" 个来源报道，证据等级为 "), "level", F.lit("。"))
    ).otherwise("当前只有一个来源，仍需等待独立信息补充。")
    quoted = lambda *parts: F.concat(*(F.lit(p) if i % 2 == 0 else F.col("title") for i, p in enumerate(parts)))
    told = F.when(F.col("summary") != "", F.col("summary")).otherwise(F.concat("title", F.lit("。")))
    one, listed = (lambda c: F.array(c)), (lambda v: F.array(*map(F.lit, v)))
    return rows.select(
        event, "domain", one(F.col("title")).alias("title"), one(F.col("summary")).alias("summary"), one(told).alias("key_facts"), F.array(F.array("url")).alias("fact_urls"),
        one(F.concat(F.lit("这条信息可能影响"), F.array_join(F.slice(party, 1, 2), "与"), F.lit("，但仍需结合后续数据判断真实影响。"))).alias("why"),
        one(quoted("围绕“", "", "”的公开材料已经给出主体、动作与对象；后续判断应继续区分正式宣布、实际执行和最终结果，不能用同领域的其他事件补充事实。")).alias("background"),
        listed(CHAIN).alias("chain"), party.alias("parties"),
        one(F.concat(F.lit("当前只依据 RSS 标题与摘要整理；"), sources, F.lit(" 未获来源明确确认的细节不作推断。"))).alias("uncertainties"),
        F.array().cast("array<string>").alias("terms"), F.array().cast("array<string>").alias("definitions"), one(F.lit(NEAR)).alias("near"),
        one(quoted("若执行结果和后续数据持续印证，“", "", "”的影响才可能从一次事件发展为更稳定的中期变化。")).alias("medium"), listed(SIGNALS).alias("signals"),
        F.col("tags") if "tags" in events.columns else F.array().cast("array<string>").alias("tags"),
    )
