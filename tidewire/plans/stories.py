"""Queries on what is told of events: cleaned material, details, numbers, and stories with their repairs.

A document is a report, as in plans.news; its text is the whole document and two sentences of the list below, dealt out by
doc_id, so that reports say something of the event in their titles, of others, and of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import checks, details, lexicons
from tidewire.operators import events as E
from tidewire.operators import material as M
from tidewire.operators import narration as R
from tidewire.operators import numeric as N
from tidewire.operators import stories as S
from tidewire.operators.tables import durable
from tidewire.plans import news
from tidewire.plans.base import _listed

SENTENCES = [
    "The grant funded 12 independent projects for students and workers.", "OpenAI partnered with Acme Labs on an AI chip factory worth $3 billion.",
    "A total of 27 French universities are listed, and four are in the global top 100.", "The Federal Reserve cuts rates on stocks and bonds by 4.5 percent on August 14, 2026!",
    "A former employee of Nvidia Corp, retail investors say, wrote it.", "Students drafted a national K-12 AI policy for 1,200 students.",
    "Iran warns about the missile shipping route; settlers trapped 40 families.", "Strands Agents and LeRobot record, train, and deploy to storage buckets.",
    "All rights reserved by whoever wrote this.", "UNESCO publishes its curriculum assessment for 1,200 students.", "Menu and other things of no interest here.",
    "A chief revenue officer joined from Intel Labs and leads the go-to-market work.",
]


def _sentence(step: int, shift: int) -> Column:
    place = F.pmod(F.floor(F.col("doc") / step) + shift, F.lit(len(SENTENCES))) + 1
    return F.element_at(F.array(*map(F.lit, SENTENCES)), place.cast("int"))


def told_reports(spark: SparkSession, folder: str) -> DataFrame:
    """news' reports with the two sentences before and behind their texts, and a place in their events by id."""
    rows = news._reports(spark, folder).withColumn("doc", F.col("id").cast("long"))
    text = F.concat_ws(" ", _sentence(1, 0), "description", _sentence(5, 3))
    return rows.withColumn("description", text).withColumn("place", F.col("doc")).withColumn("source_name", F.col("source_id")).drop("doc")


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return M.cleaned_material(told_reports(spark, folder))


def specifics(spark: SparkSession, folder: str) -> DataFrame:
    return told_reports(spark, folder).select("id", F.array_join(details.specific_details(F.concat_ws(" ", "title", "description")), "|").alias("details"))


def number_facts(spark: SparkSession, folder: str) -> DataFrame:
    return N.number_facts(told_reports(spark, folder)).select("event_id", "fact", "place", "id")


def claims_of(reports: DataFrame) -> DataFrame:
    """What is said of each event in one field: its first report's title, and sentences with numbers of its own and of other events."""
    first = reports.groupBy("event_id").agg(F.min_by("title", "place").alias("title"), F.min("place").alias("doc"))
    text = F.concat(F.col("title"), F.lit(". "), _sentence(1, 0), F.lit(" "), _sentence(1, 1), F.lit("; in all 77 of 1,200 say so!"))
    return first.select("event_id", F.lit("summary").alias("field"), F.lit(0).alias("at"), text.alias("text"))


def sanitized(spark: SparkSession, folder: str) -> DataFrame:
    reports = told_reports(spark, folder)
    return N.sanitized(claims_of(reports), N.supporting_reports(reports)).select("event_id", "text", "cut")


def _layers(spark: SparkSession, folder: str, numbers: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Reports with their prints, the context of their events, what supports numbers if that is asked for, and events with their grades."""
    reports = M.with_material(told_reports(spark, folder))
    reports = durable(R.with_specificity(N.with_said(reports))) if numbers else reports  # cleaned and searched once for both
    support = durable(N.supporting_reports(reports)) if numbers else None
    prints = durable(R.report_prints(reports.drop(*(c for c in reports.columns if c.startswith("r_")))))
    context = durable(R.event_context(prints))
    grades = E.evidence(prints.withColumn("independence_key", F.concat(F.lit("publisher:"), "source_id")))
    events = grades.select("event_id", "level", "source_count").join(context.select("event_id", "domain"), "event_id")
    return prints, context, support, events


def rule_stories(spark: SparkSession, folder: str) -> DataFrame:
    """The title, summary and first source that rules give each event."""
    prints, context, _, events = _layers(spark, folder, numbers=False)
    content = R.specific_content(prints, context)
    return R.rule_stories(events, content).select("event_id", F.element_at("title", 1).alias("title"), F.element_at("summary", 1).alias("summary"), F.element_at(F.element_at("fact_urls", 1), 1).alias("url"))


def _proposals(baseline: DataFrame, reports: DataFrame) -> DataFrame:
    """Landed answers, one a story, made of the documents: whole texts as summaries of every third, sentences of the list as facts."""
    first = reports.groupBy("event_id").agg(F.min_by(F.struct("title", "description", "url", "place"), "place").alias("r"))
    rows = baseline.join(first, "event_id").withColumn("doc", F.col("r.place"))
    third = F.col("doc") % 3
    summary = F.when(third == 0, F.col("r.description")).when(third == 1, F.concat("r.title", F.lit("，涉及88项计划，影响1,200名学生。"), _sentence(1, 0))).otherwise(F.lit(" "))
    facts = F.array(_sentence(1, 0), F.concat("r.title", F.lit(" in 2026, for 77 people.")), _sentence(1, 4))
    sources = F.array(F.struct(F.lit(0).alias("factIndex"), F.array(F.col("r.url")).alias("urls")), F.struct(F.lit(1).alias("factIndex"), F.array(F.lit("https://nowhere.example/")).alias("urls")))
    trend = F.struct(F.lit("短期价格将上升5%").alias("nearTerm"), F.lit("如果需求持续，影响会扩大").alias("mediumTerm"), F.array(F.lit("订单"), F.lit("")).alias("signalsToWatch"))
    story = F.struct(
        F.when(third == 2, F.col("slot")).alias("slot"), F.col("r.title").alias("title"), summary.alias("summary"), facts.alias("keyFacts"), sources.alias("factSources"),
        F.lit("OpenAI宣布收购英伟达").alias("whyItMatters"), F.array(F.lit("一"), F.lit("二")).alias("impactChain"), trend.alias("trend"), F.array(F.lit("标签")).alias("tags"),
    )
    return rows.select("domain", (F.col("slot") - 1).alias("position"), F.to_json(story).alias("json"))


def _told(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    prints, context, support, events = _layers(spark, folder)
    content = durable(R.specific_content(prints, context))
    slot = F.row_number().over(Window.partitionBy("domain").orderBy("event_id"))
    publisher = prints.groupBy("event_id").agg(F.min_by("source_name", "place").alias("publisher"))
    baseline = durable(R.rule_stories(events, content).withColumn("slot", slot).join(publisher, "event_id"))
    told = durable(S.merged(baseline, S.proposals_of(_proposals(baseline, prints)), context, prints, support))
    return told, baseline, content, context, prints, support


def merged_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Stories of rules with what landed answers propose, and which fields come from them."""
    told = _told(spark, folder)[0]
    return told.select("event_id", "slot", *(F.array_join(c, "|").alias(c) for c in S.FIELDS), F.array_join(F.flatten("fact_urls"), ",").alias("fact_urls"), F.array_join("taken", ",").alias("taken"))


def repaired_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Merged stories after repair, with what was replaced and why."""
    found = S.repaired(*_told(spark, folder))
    why = F.array_join(F.transform("repairs", lambda x: F.concat_ws(":", x["field"], x["reason"])), ",")
    return found.select("event_id", "slot", *(F.array_join(c, "|").alias(c) for c in S.FIELDS), F.array_join(F.flatten("fact_urls"), ",").alias("fact_urls"), why.alias("repairs"))


def story_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with merged stories before their repair."""
    told, _, _, context, prints, support = _told(spark, folder)
    return S.story_errors(told, context, prints, support).select("event_id", F.array_join("errors", ",").alias("errors"))


def story_quality(spark: SparkSession, folder: str) -> DataFrame:
    told, _, _, context, prints, support = _told(spark, folder)
    return S.quality_counts(told, context, prints, support)


QUERIES = (cleaned, specifics, number_facts, sanitized, rule_stories, merged_stories, repaired_stories, story_errors, story_quality)

_q = news._q
_SENTENCE = lambda step, shift: f"{_listed(SENTENCES)}[(CAST(floor(doc_id / {step}) AS BIGINT) + {shift}) % {len(SENTENCES)} + 1]"
TOLD_SQL = f"""{news.REPORTS_SQL}, told AS (SELECT * EXCLUDE (description, x), {_SENTENCE(1, 0)} || ' ' || description || ' ' || {_SENTENCE(5, 3)} AS description FROM reports)"""


def _sentences_sql(html: str) -> str:
    """Sentences as a list; a mark stands where texts are cut, since the pattern language knows no look-behind."""
    plain = news._strip_sql(html)
    for p in checks.LEGAL:
        plain = f"regexp_replace({plain}, '(?i){_q(p)}', ' ', 'g')"
    cut = f"regexp_replace(regexp_replace({plain}, '([。！？!?])\\s+', '\\1\x01', 'g'), '\\.\\s+([A-Z\\p{{Han}}])', '.\x01\\1', 'g')"
    bare = "trim(regexp_replace(regexp_replace(v, '^[\\s|>\\-–—•·]+|[\\s|>\\-–—•·]+$', '', 'g'), '\\s+', ' ', 'g'))"
    return f"list_filter(list_transform(string_split({cut}, '\x01'), lambda v: {bare}), lambda v: length(v) >= 12 AND NOT regexp_matches(v, '(?i){checks.NAVIGATION}'))"


def _print_sql(source: str, text: str, columns: str) -> str:
    """A SELECT of these columns and objects, actions, entities, locations and words of a text column of the source."""
    hit = lambda lexicon: news._hit_list("x", lexicon)
    words = f"list_distinct(list_filter(regexp_extract_all(lower(x), '[a-z0-9][a-z0-9.-]*'), lambda v: length(v) > 1 AND NOT list_contains({news._STOPS}, v)))"
    return f"""SELECT *, CASE WHEN len(named) > 0 THEN named ELSE list_distinct(list_filter([{news._IMPLIED}], lambda v: v IS NOT NULL)) END AS actions
  FROM (SELECT {columns}, {hit(lexicons.OBJECTS)} AS objects, {hit(lexicons.ACTIONS)} AS named, list_distinct(list_concat({hit(lexicons.ENTITIES)}, {news._NAMES})) AS entities,
  {hit(lexicons.LOCATIONS)} AS locations, {words} AS words FROM (SELECT *, {text} AS x FROM {source}))"""


_INDICATORS = f"{_listed(lexicons.INDICATORS)}"
_APART = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"
_MARKED = lambda a: f"list_intersect({a}, {_INDICATORS})"
_FITS = f"""NOT ({_APART("t.objects", "s.objects")} OR {_APART(_MARKED("t.objects"), "s.objects")} AND len({_MARKED("s.objects")}) > 0)
  AND (regexp_matches(t.title, '{M.GENERIC_TITLE}') OR len(t.entities) + len(t.actions) + len(t.objects) = 0 OR list_has_any(t.actions, s.actions) OR len(list_intersect(t.words, s.words)) >= 2
  OR NOT ({_APART(_MARKED("t.objects"), _MARKED("s.objects"))} OR {_APART("t.objects", "s.objects")} AND {_APART("t.actions", "s.actions")})
    AND (list_has_any(t.entities, s.entities) OR list_has_any(t.objects, s.objects) OR list_has_any(t.actions, s.actions) AND list_has_any(t.locations, s.locations)))"""
#: Titles are few and repeat: each is looked at once, as is each sentence.
CLEANED_SQL = f"""{TOLD_SQL},
t AS ({_print_sql("(SELECT DISTINCT title FROM told)", "title", "title")}),
cut AS (SELECT id, title, {_sentences_sql("description")} AS a FROM told), each AS (SELECT id, title, unnest(a) AS sentence, unnest(range(len(a))) AS i FROM cut),
s AS ({_print_sql("(SELECT DISTINCT sentence FROM each)", "sentence", "sentence")}),
fit AS (SELECT id, sentence, min(i) AS i FROM each JOIN t USING (title) JOIN s USING (sentence) WHERE {_FITS} GROUP BY 1, 2),
cleaned AS (SELECT told.id, coalesce(string_agg(sentence, ' ' ORDER BY i), '') AS material FROM told LEFT JOIN fit USING (id) GROUP BY 1)"""


def _detail_sql(rule: details.Rule) -> str:
    flag = "" if rule.exact else "(?i)"
    holds = " AND ".join(f"regexp_matches(x, '{flag if i == 0 else '(?i)'}{_q(p)}')" for i, p in enumerate(rule.patterns))
    part = f"trim(regexp_extract(x, '{flag}{_q(rule.patterns[0])}', 1))"
    if rule.template.startswith("合作方"):
        part = f"regexp_replace({part}, '{details.TRAILING}', '')"
    head, _, tail = rule.template.partition("{}")
    return f"CASE WHEN {holds} THEN " + (f"'{head}' || {part} || '{tail}'" if "{}" in rule.template else f"'{rule.template}'") + " END"


def _details_sql() -> str:
    groups: dict[str, list[str]] = {}
    for i, rule in enumerate(details.RULES):
        groups.setdefault(rule.group or str(i), []).append(_detail_sql(rule))
    return f"list_filter([{', '.join(f'coalesce({chr(44).join(g)})' for g in groups.values())}], lambda v: v IS NOT NULL)"


_FACTS = "list_filter(list_transform(string_split(regexp_replace({0}, '([。！？.!?;；])\\s*', '\\1\x01', 'g'), '\x01'), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: length(v) BETWEEN 8 AND 320 AND regexp_matches(v, '[0-9]'))"
ORACLES: dict[str, str] = {
    "cleaned": f"WITH {CLEANED_SQL} SELECT id, material FROM cleaned",
    "specifics": f"""WITH {TOLD_SQL}, d AS (SELECT id, {_details_sql()} AS a FROM (SELECT id, title || ' ' || description AS x FROM told)), o AS (SELECT id, unnest(a) AS v, unnest(range(len(a))) AS i FROM d),
f AS (SELECT id, v, min(i) AS i FROM o GROUP BY 1, 2) SELECT d.id, coalesce(string_agg(v, '|' ORDER BY i), '') AS details FROM d LEFT JOIN f USING (id) GROUP BY 1""",
    "number_facts": f"""WITH {CLEANED_SQL}, parts AS (SELECT event_id, doc_id, id, 0 AS part, title AS v FROM told UNION ALL SELECT event_id, doc_id, id, 1, material FROM told JOIN cleaned USING (id)),
a AS (SELECT event_id, doc_id, id, part, {_FACTS.format("v")} AS a FROM parts), o AS (SELECT event_id, doc_id, id, part, unnest(a) AS f, unnest(range(len(a))) AS i FROM a),
n AS (SELECT event_id, doc_id, id, part, i, trim(regexp_replace(nfc_normalize(f), '\\s+', ' ', 'g')) AS fact FROM o),
g AS (SELECT event_id, fact, row_number() OVER (PARTITION BY event_id ORDER BY min((doc_id, part, i))) AS place FROM n GROUP BY 1, 2)
SELECT DISTINCT event_id, fact, CAST(place AS INTEGER) AS place, id FROM n JOIN g USING (event_id, fact) WHERE place <= 24""",
}
