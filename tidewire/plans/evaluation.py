"""Queries for pools, relevance, gates, follow-up targets, feeds and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import catalog, lexicons
from tidewire.functions.checks import independence_key
from tidewire.functions.text import title_tokens
from tidewire.operators import candidates as C
from tidewire.operators import diagnostics, relevance, selection, targets
from tidewire.operators import events as E
from tidewire.plans.base import CANDIDATES_SQL, HEADLINES, NOW, _candidates, _hits_sql, _listed, _pages, _scored, _wires_sql
from tidewire.plans import news as plans_news
from tidewire.sources import feeds, news

STAGES = ["primary", "tier-1", "tier-2", "other"]
AI = catalog.AI_TECH


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates as reports: an event for each domain and headline, scores to six places."""
    rows = _scored(spark, folder).withColumn("score", F.round("score", 6)).withColumn("lead", F.regexp_extract("title", "^(.*) ", 1))
    return rows.withColumn("event_id", F.concat_ws(":", "domain", "lead")).withColumn("independence_key", independence_key(F.col("title"), F.col("description"), F.col("source_id")))


def pool(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).withColumn("score", F.round("score", 6)).withColumn("title_tokens", title_tokens(F.col("title")))
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    old = spark.range(1).select(each(HEADLINES[:3]).alias("id")).select("id", each(news.DOMAINS).alias("domain"))  # no Python workers, as lists need them
    chosen = selection.candidate_pool(rows, old.withColumn("tokens", title_tokens(F.col("id"))))
    return chosen.select("domain", "id", F.round("pool_score", 6).alias("pool_score"), F.col("place").cast("long"))


def relevant(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.with_signals(C.with_features(_candidates(spark, folder)), AI)
    return rows.select("id", F.round("match", 6).alias("match"), "relevant")


def gates(spark: SparkSession, folder: str) -> DataFrame:
    level = F.when(F.col("published_at").isNull(), "unverified").otherwise("single-source")
    stories = C.diverse(_reports(spark, folder), "domain", "source_id").withColumn("position", F.col("place")).withColumn("level", level)
    return selection.gate(stories)


def verification(spark: SparkSession, folder: str) -> DataFrame:
    reports = _reports(spark, folder)
    scores = reports.groupBy("event_id", "domain").agg(F.max("score").alias("score"))
    events = scores.join(E.evidence(reports).select("event_id", "level"), "event_id").withColumnRenamed("event_id", "id")
    return targets.verification_targets(events)


def materials(spark: SparkSession, folder: str) -> DataFrame:
    return targets.material_targets(_reports(spark, folder).withColumn("event_place", F.col("domain")))


def _recovered(reports: DataFrame) -> DataFrame:
    n = F.regexp_extract("url", r"/item/(\d+)$", 1).cast("long")
    meta = F.concat(F.lit('<meta property="article:published_time" content="2026-08-'), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit('T01:02:03Z">'))
    landed = reports.select("url").distinct().select("url", F.when(n % 5 != 0, meta).otherwise("").alias("html"))
    return targets.date_records(reports, landed, NOW)


def recovered_dates(spark: SparkSession, folder: str) -> DataFrame:
    found = _recovered(_reports(spark, folder))
    return found.select("id", "domain", "url", "status", F.date_format("found_at", "yyyy-MM-dd HH:mm:ss").alias("found_at"))


def redated(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates that the recovered dates leave, with the scores that these give."""
    reports = _reports(spark, folder)
    found = targets.with_recovered_dates(reports, _recovered(reports), NOW)
    return found.select("id", "domain", F.round("score", 6).alias("score"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def alignment(spark: SparkSession, folder: str) -> DataFrame:
    gold = spark.createDataFrame([(f"g{i}", f"https://www.openai.com/item/{i}/", h) for i, h in enumerate(HEADLINES)], "gold_id string, url string, title string")
    found = _candidates(spark, folder).select("id", F.col("id").cast("long").alias("place"), "url", title_tokens(F.col("title")).alias("tokens"))
    return diagnostics.aligned(gold.select("gold_id", "url"), gold.select("gold_id", title_tokens(F.col("title")).alias("tokens")), found)


def gold_recall(spark: SparkSession, folder: str) -> DataFrame:
    gold = spark.createDataFrame([(f"g{i}",) for i in range(len(HEADLINES) + 2)], "gold_id string")
    return diagnostics.recall(gold, alignment(spark, folder))


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.first_stage(_reports(spark, folder), "event_id", F.col("reliability"), STAGES)


def evidence_changes(spark: SparkSession, folder: str) -> DataFrame:
    reports = _reports(spark, folder)
    return diagnostics.upgrades(E.evidence(reports.where("reliability <> 'primary'")), E.evidence(reports))


def feed_reports(spark: SparkSession, folder: str) -> DataFrame:
    xml = F.concat(
        F.lit("<rss><channel><item><title>News "), F.col("page_id").cast("string"), F.lit("</title><link>https://www.x.org/"), F.col("page_id").cast("string"),
        F.lit("?utm_source=f</link><description>d &amp;amp; e</description><pubDate>Sun, 16 Aug 2026 07:30:00 GMT</pubDate></item></channel></rss>"),
    )
    items = feeds.feed_items(_pages(spark, folder).select(F.col("page_id").alias("feed_id"), xml.alias("xml")))
    return items.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


QUERIES = (pool, relevant, gates, verification, materials, recovered_dates, redated, alignment, gold_recall, contributions, evidence_changes, feed_reports)

_TEXT = "title || ' ' || description"
_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_REPORTS_SQL = f"""{CANDIDATES_SQL}, reports AS (SELECT * EXCLUDE (score), score6 AS score, regexp_extract(title, '^(.*) ', 1) AS lead,
  domain || ':' || regexp_extract(title, '^(.*) ', 1) AS event_id FROM ranked)"""


def _grades_sql(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT event_id, CASE WHEN p AND i >= 1 THEN 'confirmed' WHEN i >= 2 THEN 'corroborated' WHEN s = 1 AND r THEN 'unverified'
  WHEN s = 1 THEN 'single-source' ELSE 'unverified' END AS level FROM (SELECT event_id, count(DISTINCT source_id) AS s, bool_or(reliability = 'primary') AS p,
  count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN coalesce({_wires_sql(_TEXT)}, source_id) END) AS i, bool_or(regexp_matches({_TEXT}, '(?i){lexicons.RUMOR}')) AS r
  FROM {rows} GROUP BY 1))"""


def _agree(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"{common} / (len({a}) + len({b}) - {common})"


def _by_sql(column: str, values: dict[str, int], rest: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {rest} END"


_ROWS = lambda values: ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in values)
_COUNT = lambda terms: " + ".join(f"CAST(contains(low, '{t}') AS INTEGER)" for t in terms)
_ORDINAL = lambda c: _by_sql(c, selection.ORDINAL, 0)
_STANDING = _by_sql("reliability", targets.RELIABILITY, 1)
_ALIGNED_SQL = f"""{CANDIDATES_SQL}, gold AS (SELECT *, {_TOKENS.format("title")} AS tokens FROM (VALUES {_ROWS((f"g{i}", f"https://www.openai.com/item/{i}", h) for i, h in enumerate(HEADLINES))}) AS t(gold_id, url, title)),
found AS (SELECT id, url, {_TOKENS.format("title")} AS tokens FROM cand),
aligned AS (SELECT gold_id, arg_min(id, CAST(id AS BIGINT)) AS id FROM gold g JOIN found f ON g.url = f.url OR {_agree("g.tokens", "f.tokens")} >= 0.64 GROUP BY 1)"""

_WINDOW_SQL = "CASE domain " + " ".join(f"WHEN '{d.name}' THEN {d.window_days}" for d in catalog.DOMAINS) + " END"
_RECOVERED_SQL = rf"""{_REPORTS_SQL}, u AS (SELECT *, CAST(regexp_extract(url, '/item/(\d+)$', 1) AS BIGINT) AS k FROM reports WHERE published_at IS NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, domain, title, id) AS n FROM u),
t AS (SELECT url, CASE WHEN k % 5 <> 0 THEN TIMESTAMP '2026-08-01 01:02:03' + to_days(CAST(k % 28 AS INTEGER)) END AS dated FROM b WHERE n = 1 ORDER BY {_STANDING} DESC, score DESC, url LIMIT 8),
found AS (SELECT id, domain, url, CASE WHEN dated IS NULL THEN 'missing' WHEN dated > TIMESTAMP '{NOW}' + to_hours(6) THEN 'future-dated' WHEN dated < TIMESTAMP '{NOW}' - to_days({_WINDOW_SQL}) THEN 'expired'
  ELSE 'recovered' END AS status, dated FROM u JOIN t USING (url))"""

ORACLES: dict[str, str] = {
    "pool": f"""WITH {CANDIDATES_SQL}, old AS (SELECT {_TOKENS.format("h")} AS tokens FROM (VALUES {_ROWS((h,) for h in HEADLINES[:3])}) AS t(h)),
t AS (SELECT *, {_TOKENS.format("title")} AS tokens FROM ranked),
s AS (SELECT domain, id, score6 - CASE WHEN EXISTS (SELECT 1 FROM old WHERE {_agree("t.tokens", "old.tokens")} >= 0.62) THEN 18.0 ELSE 0.0 END AS pool_score FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pool_score DESC, id) AS place FROM s)
SELECT domain, id, round(pool_score, 6) AS pool_score, place FROM p WHERE place <= 60""",
    "relevant": f"""WITH {CANDIDATES_SQL}, reports AS (SELECT *, {_TEXT} AS x FROM cand), {plans_news.LISTS_SQL},
f AS (SELECT *, lower(x) AS low FROM feat),
g AS (SELECT *, {_COUNT(AI.topics)} AS topics, {_COUNT(AI.impacts)} AS impacts, {" + ".join(f"CAST(regexp_matches(x, '(?i){p}') AS INTEGER)" for _, p in AI.tags)} AS tags,
  len(entities) AS ne, len(actions) AS na, list_has_any(objects, {_listed(list(AI.objects))}) AS own,
  reliability = 'primary' AND ({" OR ".join(f"source_id = '{h}' OR ends_with(source_id, '.{h}')" for h in AI.hosts)}) AS official FROM f)
SELECT id, CAST(round(topics * 4 + impacts * 1.5 + tags * 2.5 + least(ne, 3) + least(na, 2) * 1.5 + CAST(own AS INTEGER) * 5 + CAST(official AS INTEGER) * 8, 6) AS DOUBLE) AS match,
  topics > 0 OR official OR (own AND (ne > 0 OR na > 0)) OR (tags > 0 AND (ne > 0 OR na > 0)) AS relevant FROM g""",
    "gates": f"""WITH {_REPORTS_SQL}, late AS (SELECT *, row_number() OVER (PARTITION BY domain, source_id ORDER BY rank) > 2 AS late FROM reports),
placed AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY late, rank) AS position, CASE WHEN published_at IS NULL THEN 'unverified' ELSE 'single-source' END AS level FROM late),
st AS (SELECT *, count(*) OVER (PARTITION BY domain, source_id) AS ps, count(*) OVER (PARTITION BY domain, lead) AS pl FROM placed WHERE position <= 5),
g AS (SELECT domain, count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT source_id) AS sources, max(ps) AS ps, max(pl) AS pl, count_if(reliability = 'other') AS other,
  count_if(level = 'unverified') AS weak, count_if(level = 'unverified' AND position <= 3) AS early, count_if(position = 1 AND reliability = 'other' AND level = 'single-source') AS first
  FROM st GROUP BY 1)
SELECT domain, array_to_string(list_sort(list_filter([CASE WHEN n <> 5 THEN 'count' END, CASE WHEN ids <> n THEN 'repeated-id' END, CASE WHEN sources < 3 THEN 'few-sources' END,
  CASE WHEN ps > 2 THEN 'source-over-2' END, CASE WHEN pl > 2 THEN 'lead-over-2' END, CASE WHEN other > 1 THEN 'other-over-1' END,
  CASE WHEN weak > 1 OR early > 0 THEN 'unverified' END, CASE WHEN first > 0 THEN 'weak-first' END], lambda x: x IS NOT NULL)), ',') AS errors FROM g""",
    "verification": f"""WITH {_REPORTS_SQL}, {_grades_sql("grades", "reports")}, e AS (SELECT domain, event_id AS id, level, max(score) AS score FROM reports JOIN grades USING (event_id) GROUP BY ALL),
p AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY level NOT IN ('single-source', 'unverified'),
  score + {_by_sql("level", targets.URGENCY, 16)} DESC, id) AS place FROM e)
SELECT * FROM p WHERE place <= 2""",
    "materials": f"""WITH {_REPORTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {_STANDING} DESC, score DESC, id) AS n FROM reports)
SELECT event_id, id, url FROM b WHERE n <= 3 ORDER BY domain, event_id, n LIMIT 30""",
    "recovered_dates": f"WITH {_RECOVERED_SQL} SELECT id, domain, url, status, strftime(dated, '%Y-%m-%d %H:%M:%S') AS found_at FROM found",
    "redated": f"""WITH {_RECOVERED_SQL} SELECT r.id, r.domain, strftime(coalesce(r.published_at, f.dated), '%Y-%m-%d %H:%M:%S') AS published_at,
  round(r.score + CASE WHEN f.status = 'recovered' THEN 20.0 + greatest(0.0, 36.0 - greatest(0.0, (epoch(TIMESTAMP '{NOW}') - epoch(f.dated)) / 3600.0) / 4) ELSE 0.0 END, 6) AS score
FROM reports r LEFT JOIN found f ON r.id = f.id AND r.domain = f.domain WHERE f.status IS NULL OR f.status NOT IN ('expired', 'future-dated')""",
    "alignment": f"WITH {_ALIGNED_SQL} SELECT gold_id, id FROM aligned",
    "gold_recall": f"WITH {_ALIGNED_SQL} SELECT floor(count(*) / {len(HEADLINES) + 2} * 10000 + 0.5) / 10000 AS recall FROM aligned",
    "contributions": f"""WITH {_REPORTS_SQL}, f AS (SELECT event_id, max({_STANDING}) AS s FROM reports GROUP BY 1)
SELECT {_listed(STAGES)}[5 - s] AS stage, count(*) AS n FROM f GROUP BY 1""",
    "evidence_changes": f"""WITH {_REPORTS_SQL}, media AS (SELECT * FROM reports WHERE reliability <> 'primary'), {_grades_sql("x", "media")}, {_grades_sql("y", "reports")}
SELECT CAST(count_if({_ORDINAL("y.level")} > {_ORDINAL("x.level")}) AS BIGINT) AS better, CAST(count_if({_ORDINAL("y.level")} < {_ORDINAL("x.level")}) AS BIGINT) AS worse FROM x JOIN y USING (event_id)""",
    "feed_reports": """SELECT page_id AS feed_id, 'News ' || page_id AS title, 'https://www.x.org/' || page_id AS url, 'd & e' AS description, '2026-08-16 07:30:00' AS published_at FROM pages""",
}
