"""Queries on stages, verification and a labelled set, over reports made of whole documents (plans/news.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.operators import benchmarks as B
from tidewire.operators import events as E
from tidewire.operators import syndication
from tidewire.operators.tables import durable
from tidewire.plans import discovery
from tidewire.plans.base import _listed
from tidewire.plans.news import REPORTS_SQL, SYNDICATION_SQL, _reports
from tidewire.sources import news

PHASES = ["rss", "base", "dynamic", "verification"]


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with what they count as, and size, the length of their texts, in place of those."""
    rows = _reports(spark, folder)
    keys = syndication.effective_keys(rows).select("id", F.col("effective_key").alias("independence_key"))
    narrow = E.with_rumor(rows.withColumn("size", F.length("description"))).select("id", "domain", "event_id", "title", "url", "published_at", "source_id", "reliability", "size", "rumor")
    return durable(narrow.join(keys, "id"))


def stage_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Reports are found by the stage that their text's length deals, unless a later decision, by the title's length, says otherwise."""
    rows = _reports(spark, folder).withColumn("place", F.col("id").cast("long"))
    dealt = lambda n: F.element_at(F.array(*map(F.lit, PHASES)), (n % 4 + 1).cast("int"))
    size, title = F.length("description"), F.length("title")
    candidates = rows.where("published_at is not null").select("id", "place", B.stage_of(dealt(size)).alias("stage"))
    decisions = rows.select(F.col("id").alias("candidate_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), title.alias("t"), size.alias("s"))
    decisions = decisions.select("candidate_id", "place", dealt(F.col("t") + F.col("place")).alias("phase"), ((F.col("s") + F.col("place")) % 3 == 0).alias("accepted"))
    stages = B.candidate_stages(candidates, decisions)
    return B.contribution(B.event_stages(rows, stages), rows.where(F.col("event_id").rlike("acquires$|launches$")))


def search_stages(spark: SparkSession, folder: str) -> DataFrame:
    return B.searches(discovery.search_trace(spark, folder))


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """What reports of other sources than media add to each event that has any: level, change and how many reports came."""
    rows = _reports(spark, folder).withColumn("independence_key", F.concat(F.lit("publisher:"), "source_id"))
    before = rows.where("reliability <> 'primary'")
    return B.verification_changes(E.evidence(before), E.evidence(rows), before, rows)


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """All reports are labelled: by subject, act and whether they are dated. A run found the dated ones whose texts have no length of a fourth kind."""
    rows = _keyed(spark, folder).withColumn("place", F.col("id").cast("long"))
    label = F.concat_ws(":", "event_id", F.col("published_at").isNull().cast("string"))
    labelled = rows.withColumn("gold_id", label).withColumn("cluster", F.split_part("event_id", F.lit(":"), F.lit(2)))
    gold = labelled.groupBy("gold_id").agg(F.min_by("domain", "place").alias("domain")).withColumn("expected", F.array(*map(F.lit, (B.OFFICIAL, B.INDEPENDENT, B.COPIES))))
    found = rows.where("published_at is not null and size % 4 <> 0")
    shared = found.groupBy("event_id", "independence_key").agg((F.count_distinct("source_id") > 1).alias("shared")).groupBy("event_id").agg(F.bool_or("shared").alias("copies"))
    events = found.groupBy("event_id").agg(F.min("place").alias("place"), F.min_by("title", "place").alias("title"), F.min_by("domain", "place").alias("domain"))
    events = events.join(E.evidence(found).select("event_id", "primary_present", "independent_count"), "event_id").join(shared, "event_id")
    ownership = events.where(F.col("event_id").rlike("^Iran")).select("event_id", F.lit(news.DOMAINS[2]).alias("owner"))
    slashed = labelled.select("gold_id", F.concat("url", F.lit("/")).alias("url"), "cluster")
    return B.benchmark_metrics(
        gold, slashed, labelled.select("gold_id", "title"), found.select("id", "place", "url", "title"), events, found.select("event_id", "url"), ownership,
        events.where(F.col("event_id").rlike("acquires$|launches$")),
    )


QUERIES = (stage_contributions, search_stages, verified, benchmark)

_STAGES = [*B.STAGES]
_AT = lambda n: f"{_listed(_STAGES)}[({n}) % 4 + 1]"
_FINAL = "regexp_matches(event_id, 'acquires$|launches$')"
_LEVEL = """CASE WHEN p AND i >= 1 THEN 'confirmed' WHEN i >= 2 THEN 'corroborated' WHEN s = 1 AND r THEN 'unverified' WHEN s = 1 THEN 'single-source' ELSE 'unverified' END"""
_RANK = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.ORDINAL.items()) + " ELSE 0 END"
_TOKENS = "list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))"
_NEAR = "len(list_intersect(g.tokens, t.tokens)) >= 0.64 * (len(g.tokens) + len(t.tokens) - len(list_intersect(g.tokens, t.tokens)))"


def _levels_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT event_id, {_LEVEL} AS level FROM (SELECT event_id, count(DISTINCT source_id) AS s, count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN source_id END) AS i,
  bool_or(reliability = 'primary') AS p, bool_or(regexp_matches(x, '(?i){lexicons.RUMOR}')) AS r FROM reports WHERE {where} GROUP BY 1))"""


ORACLES: dict[str, str] = {
    "stage_contributions": f"""WITH {REPORTS_SQL},
st AS (SELECT event_id, id, CASE WHEN (length(description) + 1) % 3 = 0 THEN {_AT("length(title) + 1")} WHEN length(description) % 3 = 0 THEN {_AT("length(title)")}
  WHEN published_at IS NOT NULL THEN {_AT("length(description)")} END AS stage FROM reports),
ev AS (SELECT event_id, coalesce(min(list_position({_listed(_STAGES)}, stage)), 4) AS first, list_distinct(list(stage)) AS found FROM st GROUP BY 1)
SELECT stage, CAST((SELECT count(*) FROM ev WHERE first = k) AS BIGINT) AS new_events, CAST((SELECT count(*) FROM ev WHERE first = k AND {_FINAL}) AS BIGINT) AS final_events,
  CAST((SELECT count(*) FROM ev WHERE list_contains(found, stage) AND {_FINAL}) AS BIGINT) AS supported_events
FROM (SELECT unnest({_listed(_STAGES)}) AS stage, unnest([1, 2, 3, 4]) AS k)""",
    "search_stages": f"""WITH t AS ({discovery.ORACLES["search_trace"]})
SELECT phase || '-search' AS stage, CAST(count_if(outcome IN ('completed', 'cache-hit')) AS BIGINT) AS queries, CAST(sum(results) AS BIGINT) AS results FROM t WHERE phase IS NOT NULL GROUP BY 1""",
    "verified": f"""WITH {REPORTS_SQL}, {_levels_sql("b", "reliability <> 'primary'")}, {_levels_sql("a", "TRUE")},
n AS (SELECT event_id, count(*) AS ids FROM reports WHERE reliability = 'primary' GROUP BY 1)
SELECT a.event_id, coalesce(b.level, a.level) AS level_before, a.level AS level_after, CASE WHEN {_RANK("a.level")} > {_RANK("coalesce(b.level, a.level)")} THEN 'better'
  WHEN {_RANK("a.level")} < {_RANK("coalesce(b.level, a.level)")} THEN 'worse' ELSE 'same' END AS change, CASE WHEN b.level IS NULL THEN 0 ELSE coalesce(ids, 0) END AS added
FROM a LEFT JOIN b USING (event_id) LEFT JOIN n USING (event_id)""",
    "benchmark": f"""WITH {SYNDICATION_SQL},
lab AS (SELECT *, event_id || ':' || CASE WHEN published_at IS NULL THEN 'true' ELSE 'false' END AS gold_id, split_part(event_id, ':', 2) AS cluster, {_TOKENS} AS words_of FROM keyed),
f AS (SELECT * FROM lab WHERE published_at IS NOT NULL AND length(description) % 4 <> 0),
sh AS (SELECT event_id, bool_or(n > 1) AS copies FROM (SELECT event_id, key, count(DISTINCT source_id) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT event_id, min(doc_id) AS place, arg_min(words_of, doc_id) AS tokens, arg_min(domain, doc_id) AS own, bool_or(reliability = 'primary') AS p,
  count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN key END) AS i FROM f GROUP BY 1),
ev AS (SELECT *, CASE WHEN starts_with(event_id, 'Iran') THEN '{news.DOMAINS[2]}' ELSE own END AS owner FROM e JOIN sh USING (event_id)),
names AS (SELECT DISTINCT gold_id, words_of AS tokens FROM lab),
c AS (SELECT DISTINCT gold_id FROM (SELECT l.gold_id FROM lab l JOIN f USING (url) UNION ALL SELECT g.gold_id FROM names g JOIN (SELECT DISTINCT words_of AS tokens FROM f) t ON {_NEAR})),
m AS (SELECT gold_id, arg_min(event_id, place) AS event_id FROM (SELECT l.gold_id, f.event_id, ev.place FROM lab l JOIN f USING (url) JOIN ev ON f.event_id = ev.event_id
  UNION ALL SELECT g.gold_id, t.event_id, t.place FROM names g JOIN ev t ON {_NEAR}) GROUP BY 1),
gold AS (SELECT gold_id, arg_min(domain, doc_id) AS domain FROM lab GROUP BY 1),
r AS (SELECT gold.*, c.gold_id IS NOT NULL AS candidate, ev.* FROM gold LEFT JOIN c USING (gold_id) LEFT JOIN m USING (gold_id) LEFT JOIN ev ON m.event_id = ev.event_id),
of_url AS (SELECT url, arg_max(f.event_id, ev.place) AS found FROM f JOIN ev USING (event_id) GROUP BY 1),
s AS (SELECT cluster, found, count(*) AS n FROM lab JOIN of_url USING (url) GROUP BY 1, 2),
pr AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM s) AS p, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM s GROUP BY found)) AS f,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM s GROUP BY cluster)) AS g),
v AS (SELECT count(*) AS n, count_if(candidate) AS c, count_if(event_id IS NOT NULL AND {_FINAL}) AS fin, count(event_id) AS m, count_if(owner = domain) AS d,
  sum(CAST(coalesce(p, FALSE) AS INTEGER) + CAST(coalesce(i > 0, FALSE) AS INTEGER) + CAST(coalesce(copies, FALSE) AS INTEGER)) AS k FROM r)
SELECT floor(c / n * 10000 + 0.5) / 10000 AS candidate_recall, floor(fin / n * 10000 + 0.5) / 10000 AS final_recall, floor(pr.p / pr.f * 10000 + 0.5) / 10000 AS clustering_precision,
  floor(pr.p / pr.g * 10000 + 0.5) / 10000 AS clustering_recall, floor(d / m * 10000 + 0.5) / 10000 AS domain_accuracy, floor(k / (n * 3) * 10000 + 0.5) / 10000 AS source_coverage FROM v, pr""",
}
