"""Queries on searches and their budgets, over reports made of whole documents (plans/news.py); a run is a day of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import catalog, lexicons
from tidewire.operators import candidates as C
from tidewire.operators import discovery as D
from tidewire.operators.followups import discovery_query
from tidewire.operators.tables import durable
from tidewire.plans.base import NOW, _listed
from tidewire.plans.news import REPORTS_SQL, _reports

KINDS = ["cached", "fetched", "failed"]


def _runs(reports: DataFrame) -> DataFrame:
    """reports with run, their day, and at, three in the afternoon of it; undated ones are of the last run."""
    day = F.to_date(F.coalesce("published_at", F.lit(NOW).cast("timestamp")))
    return reports.withColumn("run", F.date_format(day, "yyyy-MM-dd")).withColumn("at", day.cast("timestamp") + F.make_dt_interval(hours=F.lit(15)))


def _kind(size) -> F.Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (size % 3 + 1).cast("int"))


def search_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Each report asks for its title or its subject in its run, some on its own host; texts of reports tell how questions were answered."""
    rows = _runs(_reports(spark, folder)).withColumn("place", F.col("id").cast("long"))
    phase = F.when(F.col("place") % 3 == 0, "base").when(F.col("place") % 3 == 1, "dynamic")
    query = F.when(F.col("place") % 7 == 0, F.concat(F.lit("site:"), "source_id", F.lit("  "), "title")).when(F.col("place") % 2 == 0, F.split_part("event_id", F.lit(":"), F.lit(1)))
    query = query.when(F.col("place") % 31 != 0, F.col("title"))
    requests = D.with_options(rows.select("run", "at", "domain", "place", phase.alias("phase"), query.alias("query")))
    size = F.length("description")
    answers = rows.select("run", D.normal_query(query).alias("request"), _kind(size).alias("kind"), F.when(size % 11 != 0, F.col("place")).alias("position")).where(size % 5 != 0)
    found = D.traced(requests, D.answer_kinds(answers))
    return found.select("run", "domain", "place", "phase", "request", "starts", "ends", F.array_join("hosts", ",").alias("hosts"), "outcome", "results")


def discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds for each day: a report answers a fixed question of its domain, and the question that its own features lead to.

    A question's answers are its reports by id. What earlier digests said are the titles of the reports themselves.
    """
    reports = _runs(_reports(spark, folder))
    rows = C.with_features(reports)
    base = F.create_map(*(F.lit(x) for d, queries in D.TEMPLATES.items() for x in (d, F.array(*map(F.lit, queries)))))
    fixed = F.element_at(base[F.col("domain")], (F.floor(F.col("id").cast("long") / 4) % 4 + 1).cast("int"))
    asked = rows.withColumn("query", F.explode(F.array(fixed, discovery_query(F.col("published_at")))))
    size = F.length("description")
    kind = F.when(fixed == F.col("query"), "fetched").otherwise(_kind(size % 2))
    order = Window.partitionBy("run", "request").orderBy(F.col("id").cast("long"))
    # Which report answers what is settled without texts; those of what a run is let ask join it.
    landed = asked.select("run", D.normal_query(F.col("query")).alias("request"), kind.alias("kind"), "id")
    answers = durable(landed.withColumn("position", F.row_number().over(order)).where(F.col("position") <= D.ANSWERS))  # a search gives no more answers than that
    texts = reports.select("id", "title", "description", "url", "published_at", "source_id", "reliability", "weight", "provider_score")
    said = reports.select(F.lit("earlier").alias("id"), "domain", "title", F.col("id").cast("long").alias("position")).where(F.col("position") < D.SIGNALS * len(catalog.DOMAINS))
    _, hits = D.discover(reports.select("run", "at").distinct(), answers, said.select("domain", "position", F.col("title").alias("signal")), texts)
    return hits.select("run", "domain", "phase", F.col("place").cast("long").alias("place"), F.col("position").cast("long").alias("position"), "id", "reason", F.round("score", 6).alias("score"), "candidate_id", "kept")


QUERIES = (search_trace, discovery)

_WINDOW = "CASE domain " + " ".join(f"WHEN '{d.name}' THEN {d.window_days}" for d in catalog.DOMAINS) + " END"
ORACLES: dict[str, str] = {
    "search_trace": f"""WITH {REPORTS_SQL},
q AS (SELECT CAST(coalesce(published_at, TIMESTAMP '{NOW}') AS DATE) AS day, domain, doc_id AS place, CASE doc_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'dynamic' END AS phase, length(description) AS size,
  CASE WHEN doc_id % 7 = 0 THEN 'site:' || source_id || '  ' || title WHEN doc_id % 2 = 0 THEN split_part(event_id, ':', 1) WHEN doc_id % 31 <> 0 THEN title END AS query,
  CASE WHEN doc_id % 7 = 0 AND list_contains({_listed([h for h in lexicons.OFFICIAL_HOSTS])}, source_id) THEN source_id ELSE '' END AS hosts FROM reports),
r AS (SELECT *, trim(regexp_replace(lower(coalesce(query, '')), '\\s+', ' ', 'g')) AS request, strftime(day, '%Y-%m-%d') AS run, strftime(day - to_days({_WINDOW}), '%Y-%m-%d') AS starts,
  strftime(day + to_days(1), '%Y-%m-%d') AS ends FROM q),
k AS (SELECT run, request, CASE WHEN bool_or(size % 3 = 0) THEN 'cached' WHEN bool_or(size % 3 = 1) THEN 'fetched' ELSE 'failed' END AS kind, count_if(size % 11 <> 0) AS n
  FROM r WHERE size % 5 <> 0 GROUP BY 1, 2),
s AS (SELECT r.*, kind, n, row_number() OVER (PARTITION BY run, request, starts, ends, hosts ORDER BY place) AS seen FROM r LEFT JOIN k USING (run, request)),
p AS (SELECT run, place, phase, row_number() OVER (PARTITION BY run, domain, phase ORDER BY place) AS i FROM s WHERE request <> '' AND seen = 1 AND kind <> 'cached'),
a AS (SELECT run, place, row_number() OVER (PARTITION BY run ORDER BY place) AS i FROM p WHERE phase IS NULL OR i <= CASE phase WHEN 'base' THEN 4 ELSE 2 END),
o AS (SELECT s.*, CASE WHEN request = '' THEN 'disabled' WHEN seen > 1 THEN 'duplicate-query' WHEN kind = 'cached' THEN 'cache-hit' WHEN kind IS NULL THEN 'replay-miss'
  WHEN coalesce(a.i > 32, TRUE) THEN 'quota-exhausted' WHEN kind = 'failed' THEN 'failed' ELSE 'completed' END AS outcome FROM s LEFT JOIN a USING (run, place))
SELECT run, domain, place, phase, request, starts, ends, hosts, outcome, CAST(CASE WHEN outcome IN ('cache-hit', 'completed') THEN least(n, 8) ELSE 0 END AS BIGINT) AS results FROM o""",
}
