"""Steps that large queries do once, or not at all."""

from pyspark.sql import functions as F

from tidewire.operators import discovery as D
from tidewire.operators import material as M
from tidewire.operators import numeric as N
from tidewire.plans import stories

DATA = "/root/testdata/sf0.001"


def test_texts_join_the_answers_that_runs_read(spark):
    trace = spark.createDataFrame([("r", "world", "base", 1, "Q", "q", "completed"), ("r", "world", "base", 2, "P", "p", "quota-exhausted")], "run string, domain string, phase string, place int, query string, request string, outcome string")
    trace = trace.withColumn("at", F.lit("2026-08-16").cast("timestamp"))
    answers = spark.createDataFrame([("r", "q", "fetched", "1", 1), ("r", "p", "fetched", "2", 1), ("r", "q", "fetched", "3", 9)], "run string, request string, kind string, id string, position int")
    texts = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], "id string, title string")
    found = D.answered(trace, answers, texts)
    assert [(r.id, r.title, r.place) for r in found.collect()] == [("1", "one", 1)]
    assert sorted(found.collect()) == sorted(D.answered(trace, answers.join(texts, "id")).select(*found.columns).collect())


def test_stories_of_rules_need_no_numbers_and_clean_once(spark, monkeypatch):
    reports = M.with_material(stories.told_reports(spark, DATA))
    monkeypatch.setattr(N, "with_material", lambda _: 1 / 0)
    assert "plain" in N.supporting_reports(reports).columns  # what is cleaned is not cleaned again
    monkeypatch.setattr(N, "supporting_reports", lambda _: 1 / 0)
    assert stories._layers(spark, DATA, numbers=False)[2] is None


def test_texts_are_searched_once_and_claims_go_to_them(spark):
    """What with_said() found gives the same reports and supports as before, and few claims are copied to reports, not reports dealt out."""
    from pyspark.sql import functions as F

    from tidewire.operators import narration as R
    from tidewire.operators import numeric as N
    from tidewire.operators import tables

    han = "该工厂位于日本，用于生产人工智能芯片，计划投资30亿美元，预计2026年开工。"
    coded = "".join(f"&#{ord(c)};" for c in han)
    rows = [
        ("a", "e1", "ai-tech", 1, "OpenAI launches AI chip factory in Japan", "Worth $3 billion, it hires 1,200 people in Japan.", "https://a/1", "OpenAI", "primary", "2026-08-14"),
        ("b", "e1", "ai-tech", 2, "OpenAI builds chip factory", f"OpenAI builds a chip factory in Japan worth $3 billion. OpenAI在日本启动芯片工厂。{han}", "https://b/2", "BBC", "tier-1", "2026-08-15"),
    ]
    schema = "id string, event_id string, domain string, place long, title string, description string, url string, source_name string, reliability string, day string"
    df = spark.createDataFrame(rows, schema).withColumn("published_at", F.to_timestamp("day")).drop("day")
    once = R.with_specificity(N.with_said(df))
    assert R.best_reports(once).collect() == R.best_reports(df).collect()
    plain = lambda found: sorted(str(r.asDict()) for r in found.collect())
    assert plain(N.supporting_reports(once).select(N.supporting_reports(df).columns)) == plain(N.supporting_reports(df))
    # Sentences are found in texts with Han characters, or with references to them.
    coded_df = df.withColumn("description", F.replace("description", F.lit(han), F.lit(coded)))
    told = []
    for d in (df, coded_df):
        prints = R.report_prints(d)
        told.append([(r.title, r.summary, r.url) for r in R.specific_content(prints, R.event_context(prints)).collect()])
    assert told[0] == told[1] and len(told[0]) == 1
    asked = spark.createDataFrame([("e1", "OpenAI hires 1,200 people"), ("e1", "77 people")], "event_id string, text string")
    found = N.number_support(asked, tables.durable(N.supporting_reports(df)))
    assert [(r.text, r.id) for r in found.collect()] == [("OpenAI hires 1,200 people", "a")]
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical and "hashpartitioning(event_id" not in physical
    many, few = spark.range(50).selectExpr("id % 5 as k", "id"), spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, tables.spread_join(many, few, "k", F.col("id"), how, copied=10).collect())) == sorted(map(str, many.join(few, "k", how).collect()))
