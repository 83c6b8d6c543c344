"""Queries on feeds and what becomes of their items, over reports made of whole documents (plans/news.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import catalog
from tidewire.plans.base import NOW, _strip_sql
from tidewire.plans.news import _LISTING, FEATURES_SQL, _match_sql, _reports
from tidewire.sources import feeds

#: Characters that XML cannot hold: a feed with one is broken.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _escaped(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    """A feed for each report: one item with its whole text, then one without a link. Some never landed, some are cut off."""
    rows = _reports(spark, folder)
    n, tag = F.col("id").cast("long"), lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    link = F.when(n % 5 == 0, tag("guid", F.col("url"))).otherwise(tag("link", F.concat("url", F.lit("?utm_source=feed"))))
    date = F.coalesce(tag("pubDate", F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), F.lit("<pubDate>soon</pubDate>"))
    item = F.concat(F.lit("<item>"), tag("title", _escaped(F.col("title"))), link, tag("description", _escaped(F.col("description"))), date, F.lit("</item>"))
    xml = F.concat(F.lit("<rss><channel>"), item, F.lit("<item>"), tag("title", _escaped(F.col("title"))), F.lit("</item>"), F.when(n % 17 != 0, "</channel></rss>").otherwise(""))
    return rows.withColumn("feed_id", n).withColumn("xml", F.when(n % 19 != 0, xml)).withColumn("focused", F.col("reliability") == "primary")


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    landed = _landed(spark, folder)
    return feeds.feed_decisions(landed.select("feed_id", "xml"), landed.select("feed_id", "domain", "source_id", "reliability", "weight", "focused"), NOW)


def feed_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder).select("feed_id", F.col("item").cast("long").alias("item"), "domain", "url", "reason", F.round("score", 6).alias("score"), F.array_join("tags", ",").alias("tags"), "candidate_id")


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """What feeds gave each domain, together with the dated reports as what searches found."""
    found = _reports(spark, folder).where("published_at is not null")
    return feeds.collected(_decisions(spark, folder), found)


QUERIES = (feed_decisions, collections)

_STATUS = f"CASE WHEN doc_id % 19 = 0 THEN 'unreachable' WHEN doc_id % 17 = 0 OR regexp_matches(description, '{NO_XML}') THEN 'broken' ELSE 'read' END"
_ITEMS = FEATURES_SQL.replace("FROM reports)", "FROM items)").replace(
    "lists AS (", f"""items AS (SELECT * REPLACE (title || ' ' || plain AS x, plain AS description, coalesce(published_at, TIMESTAMP '{NOW}') AS published_at)
  FROM (SELECT *, {_STATUS} AS status, {_strip_sql("description")} AS plain FROM reports)),
lists AS (""", 1)  # fmt: skip


def _judged_sql(d: catalog.Domain) -> str:
    tags = ", ".join(f"CASE WHEN regexp_matches(x, '(?i){p}') THEN '{t}' END" for t, p in d.tags)
    found = f"list_filter([{tags}], lambda v: v IS NOT NULL)"
    return f"""SELECT *, CASE WHEN {_LISTING} THEN 'non-article-page' WHEN published_at < TIMESTAMP '{NOW}' - to_days({d.window_days}) THEN 'expired'
    WHEN published_at > TIMESTAMP '{NOW}' + to_hours(6) THEN 'future' WHEN NOT (reliability = 'primary' OR relevant) THEN 'irrelevant' ELSE 'accepted' END AS why,
    CASE WHEN len({found}) > 0 THEN array_to_string(({found})[1:3], ',') ELSE '{d.default_tag}' END AS listed,
    CASE reliability WHEN 'primary' THEN 42.0 WHEN 'tier-1' THEN 36.0 WHEN 'tier-2' THEN 31.0 ELSE 24.0 END
    + greatest(0.0, 36.0 - greatest(0.0, (epoch(TIMESTAMP '{NOW}') - epoch(published_at)) / 3600.0) / 4) + least(impacts * 2.5, 18.0) + least(8.0, length(x) / 220) + learning AS points
  FROM ({_match_sql(d)}) AS m"""


DECISIONS_SQL = f"""{_ITEMS}, j AS ({" UNION ALL ".join(_judged_sql(d) for d in catalog.DOMAINS)}),
dec AS (SELECT doc_id AS feed_id, CASE WHEN status = 'read' THEN 0 END AS item, domain, source_id, CASE WHEN status = 'read' THEN url ELSE '' END AS url,
    CASE WHEN status = 'read' THEN why ELSE status END AS reason, CAST(CASE WHEN status = 'read' AND why = 'accepted' THEN round(points, 6) END AS DOUBLE) AS score,
    CASE WHEN status = 'read' AND why = 'accepted' THEN listed END AS tags,
    CASE WHEN status = 'read' AND why = 'accepted' THEN substr(sha1(domain || ':' || source_id || ':' || url), 1, 12) END AS candidate_id FROM j
  UNION ALL SELECT doc_id, 1, domain, source_id, '', 'missing-field', NULL, NULL, NULL FROM items WHERE status = 'read')"""
ORACLES: dict[str, str] = {
    "feed_decisions": f"WITH {DECISIONS_SQL} SELECT feed_id, CAST(item AS BIGINT) AS item, domain, url, reason, score, tags, candidate_id FROM dec",
    "collections": f"""WITH {DECISIONS_SQL}, c AS (SELECT domain, source_id, 1 AS fed FROM dec WHERE reason = 'accepted' UNION ALL SELECT domain, source_id, 0 FROM base WHERE published_at IS NOT NULL),
f AS (SELECT domain, count(*) AS failed FROM dec WHERE item IS NULL GROUP BY 1)
SELECT domain, count(*) AS fetched, CAST(sum(fed) AS BIGINT) AS from_feeds, CAST(sum(1 - fed) AS BIGINT) AS from_searches, count(DISTINCT source_id) AS sources, coalesce(any_value(failed), 0) AS failed
FROM c LEFT JOIN f USING (domain) GROUP BY 1""",
}
