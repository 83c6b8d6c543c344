"""Which events, pages and dates a run follows up: verification, full texts, missing dates.

The numbers of targets are the operators' own limits: each is the budget of a run, whatever the size of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.catalog import DOMAINS, Domain
from tidewire.functions.text import published_in
from tidewire.operators.selection import by_level

#: How urgent a second source is at each level of evidence, and the order of reliability.
URGENCY = {"confirmed": -20, "corroborated": -12, "single-source": 24, "unverified": 16}
RELIABILITY = {"primary": 4, "tier-1": 3, "tier-2": 2}
RECOVERED = 20.0


def standing(tier: Column) -> Column:
    """4 for primary sources down to 1 for others."""
    return F.coalesce(*(F.when(tier == k, F.lit(v)) for k, v in RELIABILITY.items()), F.lit(1))


def verification_targets(events: DataFrame, per: int = 2) -> DataFrame:
    """(domain, id, place): events (domain, id, score, level) of each domain to find a second source for.

    Events with one source or unverified ones come first, then by score and urgency, then by id.
    """
    settled = (~F.col("level").isin("single-source", "unverified")).cast("int")
    order = Window.partitionBy("domain").orderBy(settled, F.desc(F.col("score") + by_level(F.col("level"), URGENCY)), "id")
    return events.select("domain", "id", F.row_number().over(order).cast("long").alias("place")).where(F.col("place") <= per)


def material_targets(reports: DataFrame, per_event: int = 3, overall: int = 30) -> DataFrame:
    """(event_id, id, url): the reports (event_id, event_place, id, url, reliability, score) whose pages are read in full.

    The best of each event by standing and score, in order of events, within the budget of the run.
    """
    order = Window.partitionBy("event_id").orderBy(standing(F.col("reliability")).desc(), F.desc("score"), "id")
    best = reports.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_event)
    return best.orderBy("event_place", "event_id", "n").limit(overall).select("event_id", "id", "url")


def window_of(domain: Column) -> Column:
    """How many days back a domain looks; that of a domain by default for others."""
    return F.coalesce(*(F.when(domain == d.name, F.lit(d.window_days)) for d in DOMAINS), F.lit(Domain.window_days))


def date_records(candidates: DataFrame, pages: DataFrame, now: str, limit: int = 8) -> DataFrame:
    """(id, domain, url, status, found_at) of undated candidates whose page is read for a date.

    Copies of a URL are read once. URLs come in order of their best copy: its standing, then its score; `limit` are read.
    pages: url, html, one row for each URL. status: missing, future-dated, expired or recovered; copies of one URL in several
    domains may differ, since each domain has its own window.
    """
    undated = candidates.where("published_at is null").select("id", "domain", "url", "title", "score", "reliability")
    best = undated.groupBy("url").agg(F.min(F.struct((-F.col("score")).alias("s"), "domain", "title", "id", "reliability")).alias("b"))
    targets = best.orderBy(standing(F.col("b.reliability")).desc(), "b.s", "url").limit(limit).select("url")
    read = F.broadcast(targets).join(pages.select("url", published_in(F.col("html")).alias("found_at")), "url", "left")  # at most `limit` rows
    at = F.lit(now).cast("timestamp")
    status = (
        F.when(F.col("found_at").isNull(), "missing")
        .when(F.col("found_at") > at + F.make_dt_interval(hours=F.lit(6)), "future-dated")
        .when(F.col("found_at") < at - F.make_dt_interval(days=window_of(F.col("domain"))), "expired")
        .otherwise("recovered")
    )
    return undated.join(read, "url").select("id", "domain", "url", status.alias("status"), "found_at")


def with_recovered_dates(candidates: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """candidates with the dates of date_records() and the score that these give; those found expired or in the future go."""
    known = records.select("id", "domain", "status", "found_at")
    rows = candidates.join(known, ["id", "domain"], "left").where("status is null or status not in ('expired', 'future-dated')")
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("found_at")) / 3600.0)
    gain = F.when(F.col("status") == "recovered", RECOVERED + F.greatest(F.lit(0.0), 36.0 - hours / 4)).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + gain).withColumn("published_at", F.coalesce("published_at", "found_at")).drop("status", "found_at")
