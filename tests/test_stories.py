"""Numbers without support, details, and stories: what is taken, what is repaired and why, what is wrong."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import checks, details, labels, numerals
from tidewire.functions import text as T
from tidewire.operators import material, narration, numeric, stories

SCHEMA = "id string, event_id string, domain string, place long, title string, description string, url string, source_id string, source_name string, reliability string, day string"
REPORTS = [
    ("a", "e1", "ai-tech", 1, "OpenAI launches AI chip factory in Japan", "OpenAI launches an AI chip factory worth $3 billion in Japan. Schools were closed on Monday morning. It hires 1,200 people, OpenAI said.",
     "https://a/1", "openai.com", "OpenAI", "primary", "2026-08-14"),
    ("b", "e1", "ai-tech", 2, "OpenAI builds chip factory", "OpenAI builds a chip factory; the AI chip factory takes four years.", "https://b/2", "bbc.com", "BBC", "tier-1", "2026-08-15"),
    ("c", "e2", "markets", 1, "Federal Reserve holds rates steady", "The Federal Reserve holds its policy rate at 4.5 percent.", "https://c/3", "reuters.com", "Reuters", "tier-1", "2026-08-15"),
]


@pytest.fixture(scope="module")
def layers(spark):
    df = spark.createDataFrame(REPORTS, SCHEMA).withColumn("published_at", F.to_timestamp("day")).drop("day")
    prints = narration.report_prints(df).persist()
    return df, prints, narration.event_context(prints).persist(), numeric.supporting_reports(df).persist()


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_every_text_function_takes_long_texts(spark):
    words = "some plain words in our row " * 20_000
    texts = [words, "a" * 300_000, "<p>" * 30_000, "&#65;" * 20_000, "1,234.5 " * 30_000, "词语" * 100_000, '"' * 100_000, "Big Names Here " * 30_000]
    for f in (
        T.strip_html, T.folded, T.title_tokens, T.key_numbers, T.named_entities, T.dates_in, T.number_tokens, T.first_entity, T.normal_title, checks.sentences, checks.fact_sentences,
        checks.has_english_fragment, checks.has_html_artifact, checks.is_placeholder_summary, checks.number_words, checks.redact_secrets, numerals.mended, numerals.numeric_expressions,
        numerals.has_broken_quantifier, numerals.raw_number_labels, details.specific_details,
    ):
        assert len(column(spark, texts, f)) == len(texts)
    marks = ["a&#65;&#x42;&#x1F600;&#233;", "&#0;&#55296;&#9999999;b", "&#65 &# &amp;#65;"]
    assert column(spark, marks, T.strip_html) == ["aAB\U0001F600é", "b", "&#65 &# &#65;"]
    assert column(spark, [words, "only six plain lower case words", "a b"], checks.has_english_fragment) == [True, False, False]


def test_cutting_numbers_keeps_the_rest(spark):
    text = "约 12%，$3 billion and 1,200 people ( 77 ) in 2026年."
    assert column(spark, [text], numerals.numeric_expressions)[0] == ["12%", "$3 billion", "1,200 ", "77 ", "2026年"]
    keep = lambda *cut: column(spark, [text], lambda v: numerals.without_expressions(v, F.array(*map(F.lit, cut)).cast("array<int>")))[0]
    assert keep() == text
    assert keep(1) == "约 12%， and 1,200 people ( 77 ) in 2026年." and keep(0, 4) == "约 ，$3 billion and 1,200 people ( 77 ) in ."
    assert column(spark, ["约 ，增长 。（ ） 甲 。"], numerals.mended) == ["，出现增长。 甲。"]


def test_details(spark):
    assert column(spark, ["It funded 12 independent projects, and partnered with Acme Labs on chips. Enterprise customers and students and workers gain.", None, "27 French universities"], details.specific_details) == [
        ["此次资助12个独立项目", "合作方包括Acme Labs", "项目面向学生和从业者"], [], ["法国共有27所高校入榜"]
    ]


def test_material_and_number_support(spark, layers):
    df, _, _, support = layers
    kept = {r.id: r.material for r in material.cleaned_material(df).collect()}
    assert kept["a"] == "OpenAI launches an AI chip factory worth $3 billion in Japan. It hires 1,200 people, OpenAI said."
    fields = spark.createDataFrame(
        [("e1", "s", 0, "OpenAI launches a factory for $3 billion. It hires 1,200 people; then 99 more!"), ("e1", "s", 1, "no numbers "), ("e1", "s", 2, "7!"), ("e2", "s", 0, "Federal Reserve: 4.5 percent, or 9 percent."), ("e9", "s", 0, "It was 5 of them.")],
        "event_id string, field string, at int, text string",
    )
    got = {(r.event_id, r["at"]): (r.text, r.cut) for r in numeric.sanitized(fields, support).collect()}
    assert got == {
        ("e1", 0): ("OpenAI launches a factory for $3 billion. It hires 1,200 people;then more!", 1), ("e1", 1): ("no numbers", 0), ("e1", 2): (None, 1),
        ("e2", 0): ("Federal Reserve: 4.5 percent, or .", 1), ("e9", 0): ("It was of them.", 1),
    }


def test_who_did_what(spark):
    df = spark.createDataFrame([("OpenAI launches new model for schools",), ("The study finds students learn",), ("quiet day",)], "x string")
    df = material.prints(df, "x", "t_")
    rows = df.select("x", labels.actor(F.col("x"), F.col("t_objects"), F.col("t_named"), F.col("t_first")).alias("who"), labels.action(F.col("x"), F.col("t_objects"), F.col("t_actions")).alias("what")).collect()
    assert (rows[0].who, rows[0].what) == ("OpenAI", "发布") and (rows[2].who, rows[2].what) == ("", "")


def test_stories_are_merged_judged_and_repaired(spark, layers):
    df, prints, context, support = layers
    events = spark.createDataFrame([("e1", "ai-tech", "confirmed", 2), ("e2", "markets", "single-source", 1)], "event_id string, domain string, level string, source_count int")
    content = narration.specific_content(prints, context).persist()
    told = {r.event_id: r for r in content.collect()}
    assert told["e1"].title.startswith("OpenAI") and told["e1"].url == "https://a/1"
    baseline = narration.rule_stories(events, content).withColumn("slot", F.lit(1)).withColumn("publisher", F.lit("OpenAI")).persist()
    good = {
        "slot": 1, "title": "OpenAI在日本发布AI芯片工厂", "summary": "OpenAI发布AI芯片工厂，投资 $3 billion，位于日本，另有99项计划。", "keyFacts": ["OpenAI发布AI芯片工厂 $3 billion", "Nvidia收购了微软"],
        "factSources": [{"factIndex": 0, "sourceIds": ["a"], "urls": []}], "whyItMatters": "Nvidia宣布收购微软", "impactChain": ["一", "二", " "], "affectedParties": ["芯片厂商", "日本学校"],
        "trend": {"nearTerm": {"condition": "如果投产", "outlook": "产能会扩大"}, "mediumTerm": "将持续", "signalsToWatch": ["投产", ""]},
    }
    landed = [("ai-tech", 1, json.dumps({"slot": 1, "title": "second for the slot"})), ("ai-tech", 0, json.dumps(good)), ("ai-tech", 2, json.dumps({"slot": 9, "title": "no such slot"})), ("markets", 0, "no json")]
    proposals = stories.proposals_of(spark.createDataFrame(landed, "domain string, position int, json string"))
    merged = stories.merged(baseline, proposals, context, prints, support).persist()
    rows = {r.event_id: r for r in merged.collect()}
    assert set(rows) == {"e1", "e2"} and rows["e2"].taken == [] and rows["e2"].title == [told["e2"].title]
    one = rows["e1"]
    assert one.title == ["OpenAI在日本发布AI芯片工厂"] and one.taken == ["title", "summary", "key_facts", "why", "parties", "near", "medium", "signals"]
    assert "$3 billion" in one.summary[0] and "99" not in one.summary[0]
    assert one.near == ["如果投产，产能会扩大"] and one.medium == ["如果后续公开证据继续支持这一判断，将持续"] and one.signals == ["投产", "OpenAI的后续正式信息", "独立可靠来源的交叉验证"]
    assert one.key_facts[0].startswith("OpenAI发布AI芯片工厂") and one.fact_urls[0] == ["https://a/1"] and one.chain == narration.CHAIN
    errors = {r.event_id: r.errors for r in stories.story_errors(merged, context, prints, support).collect()}
    assert "analysis-conflicts" in errors["e1"] and "fact-of-other-event" in errors["e1"] and "placeholder-title" not in errors["e1"]
    fixed = {r.event_id: r for r in stories.repaired(merged, baseline, content, context, prints, support).collect()}
    why = {x.field: x.reason for x in fixed["e1"].repairs}
    assert why["why"] == "conflict" and fixed["e1"].why == baseline.where("event_id = 'e1'").first().why
    assert why["key_facts"] == "without-source" and fixed["e1"].key_facts == one.key_facts[:1] and "title" not in why and fixed["e1"].title == one.title
    counts = {r.domain: r for r in stories.quality_counts(merged, context, prints, support).collect()}
    assert counts["ai-tech"].facts_of_other_events == 1 and counts["ai-tech"].html_artifacts == 0
