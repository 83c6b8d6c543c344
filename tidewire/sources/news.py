"""Sources of candidates: landed pages as news items, and source tiers by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.text import clean_url, hostname, of_host, strip_html

DOMAINS = ("ai-tech", "markets", "world", "learning")


def reliability(host: Column) -> Column:
    """primary for official hosts, tier-1 or tier-2 for known media, else other."""
    return (
        F.when(of_host(host, lexicons.OFFICIAL_HOSTS), "primary")
        .when(of_host(host, lexicons.TIER_ONE_HOSTS), "tier-1")
        .when(of_host(host, lexicons.TIER_TWO_HOSTS), "tier-2")
        .otherwise("other")
    )


def weight(tier: Column) -> Column:
    """The weight of a source by its tier."""
    return F.when(tier == "primary", 42.0).when(tier == "tier-1", 36.0).when(tier == "tier-2", 31.0).otherwise(24.0)


def read_json_lines(spark: SparkSession, path: str, schema: str, day: str | None = None) -> DataFrame:
    """Landed search responses or history: JSON with a fixed schema; day keeps one date's partition."""
    rows = spark.read.schema(schema).json(path)
    return rows if day is None else rows.where(F.col("date") == day)


def pages_as_candidates(pages: DataFrame, headlines: list[str], hosts: list[str], start: str = "2026-08-16 00:00:00") -> DataFrame:
    """Candidates from landed pages. Pages of the test tables have no news: headlines and hosts are dealt out by page_id."""
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(F.col("page_id") / step), F.lit(len(values))) + 1).cast("int"))
    title = F.concat(pick(headlines, 1), F.lit(" "), F.regexp_extract("html", r"<title>(\S*)", 1))
    url = F.concat(F.lit("https://www."), pick(hosts, 3), F.lit("/item/"), F.floor(F.col("page_id") / 2).cast("string"), F.lit("?utm_source=feed"))
    hours = F.pmod(F.col("page_id"), F.lit(11)) * 9
    base = pages.where("page_id is not null").select(
        F.col("page_id").cast("string").alias("id"),
        F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(F.col("page_id"), F.lit(4)) + 1).cast("int")).alias("domain"),
        title.alias("title"),
        strip_html(F.col("html")).alias("description"),
        clean_url(url).alias("url"),
        F.when(F.pmod("page_id", F.lit(13)) != 0, F.lit(start).cast("timestamp") - F.make_dt_interval(hours=hours)).alias("published_at"),
        hostname(url).alias("source_id"),
    )
    tier = base.withColumn("reliability", reliability(F.col("source_id")))
    return tier.withColumn("weight", weight(F.col("reliability")))
