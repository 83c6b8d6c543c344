"""Queries registered in __spark_entry__.py, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import checks, lexicons
from tidewire.functions import text as T
from tidewire.operators import candidates as C
from tidewire.operators import events as E
from tidewire.operators import reports as R
from tidewire.operators import selection as S
from tidewire.plans import benchmarks, discovery, evaluation, gates, ingestion, news, stories
from tidewire.plans.base import CANDIDATES_SQL, NOW, _candidates, _hits_sql, _pages, _scored, _strip_sql, _wires_sql


def strip_html(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", T.strip_html(F.col("html")).alias("text"))


def clean_urls(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, folder).select("page_id", T.clean_url(url).alias("url"), T.hostname(url).alias("host"), T.shorten(url, 30).alias("short"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat_ws(" ", "title", "description")
    lists = {"entities": lexicons.ENTITIES, "actions": lexicons.ACTIONS, "objects": lexicons.OBJECTS, "locations": lexicons.LOCATIONS}
    return _candidates(spark, folder).select("id", *(F.array_join(T.hits(text, v), ",").alias(k) for k, v in lists.items()))


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("id", F.array_join(T.key_numbers(F.col("title")), ",").alias("numbers"))


def ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("id", "domain", "source_id", "reliability", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    relevant = F.contains(F.lower("title"), F.lit("openai")) | (F.col("domain") != "world")
    return C.decided(_candidates(spark, folder), NOW, 3, relevant).groupBy("domain", "reason").agg(F.count("*").alias("n"))


def quota(spark: SparkSession, folder: str) -> DataFrame:
    return C.within_quota(_scored(spark, folder), ["domain", "reliability"], 4, 32, C.total_order()).select("id", "domain", "reliability")


def diversity(spark: SparkSession, folder: str) -> DataFrame:
    return C.diverse(_scored(spark, folder), "domain", "source_id").select("domain", "id", "source_id", F.col("place").cast("long"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candidates(spark, folder).withColumn("event_id", F.concat_ws(":", "domain", F.regexp_extract("title", "^(.*) ", 1))).withColumn("independence_key", checks.independence_key(F.col("title"), F.col("description"), F.col("source_id")))
    return E.evidence(rows).select("event_id", "level", "source_count", "independent_count", "primary_present")


def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return E.duplicate_pairs(C.with_features(_scored(spark, folder)))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return E.build_events(C.with_features(_scored(spark, folder)))


def shares(spark: SparkSession, folder: str) -> DataFrame:
    return R.shared_share(_candidates(spark, folder), "domain", "url")


def pairwise(spark: SparkSession, folder: str) -> DataFrame:
    return R.pairwise(_candidates(spark, folder), "url", "source_id")


def ownership(spark: SparkSession, folder: str) -> DataFrame:
    fits = _scored(spark, folder).groupBy("source_id", "domain").agg(F.round(F.max("score"), 6).alias("fit"))
    return R.owners(fits, "source_id", "domain", "fit").withColumn("margin", F.round("margin", 6))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    return R.digest(_scored(spark, folder).withColumn("score", F.round("score", 6)), "source_id", "score").select("id", "source_id", "score")


def dates(spark: SparkSession, folder: str) -> DataFrame:
    html = F.concat(F.lit('<meta property="article:published_time" content="2026-08-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('T01:02:03Z">'), "html")
    return _pages(spark, folder).select("page_id", F.date_format(T.published_in(html), "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def han(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", F.round(T.han_share(F.concat(F.coalesce("text", F.lit("")), F.lit("中国"))), 6).alias("share"))


def leaders(spark: SparkSession, folder: str) -> DataFrame:
    return E.deduplicated(C.with_features(_scored(spark, folder)))


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return E.match_pairs(C.with_features(_scored(spark, folder)))


def redaction(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", checks.redact_secrets(F.col("text")).alias("text"))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", checks.has_html_artifact(F.coalesce("html", F.lit(""))).alias("artifact"))


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", checks.article_body(F.col("html"), least=40).alias("body"))


def slates(spark: SparkSession, folder: str) -> DataFrame:
    """Five of each domain: the best 60 candidates as events of one report, preselected under caps."""
    w = Window.partitionBy("domain").orderBy(*C.total_order())
    pool = _scored(spark, folder).withColumn("place", F.row_number().over(w)).where("place <= 60")
    pool = pool.withColumn("lead", F.col("title")).withColumn("level", F.when(F.col("published_at").isNull(), "unverified").otherwise("single-source"))
    pool = pool.select("domain", "id", F.col("place").cast("long"), "source_id", "lead", "level", "reliability")
    chosen = S.preselect(pool, capped=True).join(pool.drop("place"), ["domain", "id"])
    return S.slates(chosen)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        events, strip_html, clean_urls, features, numbers, ranking, decisions, quota, diversity, evidence, duplicates, shares, pairwise, ownership, digest, dates, han,
        leaders, matches, redaction, artifacts, bodies, slates, *evaluation.QUERIES, *news.QUERIES, *stories.QUERIES, *discovery.QUERIES, *benchmarks.QUERIES,
        *ingestion.QUERIES, *gates.QUERIES,
    )
}

_TEXT = "title || ' ' || description"
ORACLES: dict[str, str] = {
    "strip_html": f"SELECT page_id, {_strip_sql('html')} AS text FROM pages",
    "clean_urls": r"""
WITH p AS (SELECT page_id, url, split_part(url, '#', 1) AS bare FROM pages),
q AS (SELECT *, split_part(bare, '?', 1) AS base, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref|source|rss)(?:=|$)')) AS kept FROM p)
SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN regexp_replace(lower(regexp_extract(base, '^([^:]+://[^/]*)', 1))
  || regexp_extract(base, '^[^:]+://[^/]*(.*)$', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '/$', '') ELSE trim(url) END AS url,
  CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\d*\.', '') ELSE 'unknown-source' END AS host,
  CASE WHEN length(url) > 30 THEN rtrim(left(url, 29)) || '…' ELSE url END AS short FROM q""",
    "features": f"WITH {CANDIDATES_SQL} SELECT id, {_hits_sql(_TEXT, lexicons.ENTITIES)} AS entities, {_hits_sql(_TEXT, lexicons.ACTIONS)} AS actions, "
    f"{_hits_sql(_TEXT, lexicons.OBJECTS)} AS objects, {_hits_sql(_TEXT, lexicons.LOCATIONS)} AS locations FROM cand",
    "ranking": f"WITH {CANDIDATES_SQL} SELECT id, domain, source_id, reliability, score6 AS score, rank FROM ranked",
    "decisions": f"""WITH {CANDIDATES_SQL} SELECT domain, CASE WHEN published_at < TIMESTAMP '{NOW}' - to_days(3) THEN 'expired'
  WHEN published_at > TIMESTAMP '{NOW}' + to_hours(6) THEN 'future' WHEN NOT (contains(lower(title), 'openai') OR domain <> 'world') THEN 'irrelevant'
  ELSE 'accepted' END AS reason, count(*) AS n FROM cand GROUP BY 1, 2""",
    "quota": f"""WITH {CANDIDATES_SQL}, own AS (SELECT *, row_number() OVER (PARTITION BY domain, reliability ORDER BY rank) AS g FROM ranked)
SELECT id, domain, reliability FROM own WHERE g <= 4 ORDER BY score DESC, published_at IS NULL, published_at DESC, url, domain, title, id LIMIT 32""",
    "diversity": f"""WITH {CANDIDATES_SQL}, late AS (SELECT *, row_number() OVER (PARTITION BY domain, source_id ORDER BY rank) > 2 AS late FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY late, rank) AS place FROM late)
SELECT domain, id, source_id, place FROM placed WHERE place <= 5""",
    "evidence": f"""WITH {CANDIDATES_SQL}, g AS (SELECT domain || ':' || regexp_extract(title, '^(.*) ', 1) AS event_id, count(DISTINCT source_id) AS source_count,
  count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN coalesce({_wires_sql(_TEXT)}, source_id) END) AS independent_count, bool_or(reliability = 'primary') AS primary_present,
  bool_or(regexp_matches({_TEXT}, '(?i){lexicons.RUMOR}')) AS rumor FROM cand GROUP BY 1)
SELECT event_id, CASE WHEN primary_present AND independent_count >= 1 THEN 'confirmed' WHEN independent_count >= 2 THEN 'corroborated'
  WHEN source_count = 1 AND rumor THEN 'unverified' WHEN source_count = 1 THEN 'single-source' ELSE 'unverified' END AS level,
  source_count, independent_count, primary_present FROM g""",
    "duplicates": f"""WITH {CANDIDATES_SQL}, t AS (SELECT *, regexp_replace(lower(title), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g') AS key,
  list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS tokens FROM ranked)
SELECT l.domain, l.id AS a, r.id AS b FROM t l JOIN t r ON l.domain = r.domain AND l.rank < r.rank WHERE l.url = r.url OR l.key = r.key
  OR len(list_intersect(l.tokens, r.tokens)) / (len(l.tokens) + len(r.tokens) - len(list_intersect(l.tokens, r.tokens))) >= 0.94""",
    "shares": f"""WITH {CANDIDATES_SQL}, s AS (SELECT domain, url, count(*) AS n FROM cand GROUP BY 1, 2)
SELECT domain, CAST(sum(n) AS BIGINT) AS rows, floor(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) * 10000 + 0.5) / 10000 AS shared_share FROM s GROUP BY 1""",
    "pairwise": f"""WITH {CANDIDATES_SQL}, p AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM cand GROUP BY url, source_id)),
f AS (SELECT sum(n * (n - 1) / 2) AS f FROM (SELECT count(*) AS n FROM cand GROUP BY url)), g AS (SELECT sum(n * (n - 1) / 2) AS g FROM (SELECT count(*) AS n FROM cand GROUP BY source_id))
SELECT coalesce(floor(p / nullif(f, 0) * 10000 + 0.5) / 10000, 0.0) AS precision, coalesce(floor(p / nullif(g, 0) * 10000 + 0.5) / 10000, 0.0) AS recall FROM p, f, g""",
    "ownership": f"""WITH {CANDIDATES_SQL}, fits AS (SELECT source_id, domain, round(max(score), 6) AS fit FROM scored GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS place, fit - lead(fit) OVER w AS margin FROM fits WINDOW w AS (PARTITION BY source_id ORDER BY fit DESC, domain))
SELECT source_id, domain AS owner, fit, round(margin, 6) AS margin, coalesce(margin, 5.0) < 5.0 AS low_confidence FROM o WHERE place = 1""",
    "digest": f"""WITH {CANDIDATES_SQL}, o AS (SELECT id, source_id, score6 AS score, row_number() OVER (PARTITION BY source_id ORDER BY score6 DESC, id) AS n FROM ranked)
SELECT id, source_id, score FROM o WHERE n = 1 ORDER BY score DESC, id LIMIT 3""",
    "dates": "SELECT page_id, '2026-08-0' || CAST(page_id % 9 + 1 AS VARCHAR) || ' 01:02:03' AS published_at FROM pages",
    "han": r"""SELECT doc_id, round(length(regexp_replace(x, '[^\p{Han}]', '', 'g')) / length(regexp_replace(x, '[^\p{L}]', '', 'g')), 6) AS share
FROM (SELECT doc_id, coalesce(text, '') || '中国' AS x FROM documents)""",
    "redaction": r"""SELECT doc_id, regexp_replace(regexp_replace(text, 'Bearer\s+[^\s"'']+', 'Bearer [REDACTED]', 'gi'), '\b(?:tvly|sk)-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g') AS text
FROM documents""",
    "artifacts": r"""SELECT page_id, regexp_matches(coalesce(html, ''), '(?i)</?[a-z][^>]*>|&(?:#\d+|#x[\da-f]+|[a-z][a-z0-9]+);|(?:^|\s)#{2,}\s|\b(?:javascript:void|document\.cookie)\b') AS artifact
FROM pages""",
}
ORACLES |= evaluation.ORACLES | news.ORACLES | stories.ORACLES | discovery.ORACLES | benchmarks.ORACLES | ingestion.ORACLES | gates.ORACLES
FLAGSHIP = "events"
