"""Candidates: features, filter ladder with reasons, score, total order, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.quantities import comparable
from tidewire.functions.catalog import Domain
from tidewire.functions.checks import is_non_article
from tidewire.functions.text import bound, dates_in, found_in, hits, implied_or, key_numbers, normal_title, tags_of, text_tokens, title_tokens
from tidewire.operators.relevance import learning_relevance
from tidewire.operators.tables import durable


def with_features(df: DataFrame) -> DataFrame:
    """Entities, actions, objects, places and dates of title and text, key numbers, tokens: computed once, compared often.

    entities are aliased and other names, title_entities aliased ones alone; actions may follow from objects.
    """
    text, title = F.concat_ws(" ", "title", "description"), F.coalesce("title", F.lit(""))
    said, titled = (lambda c: F.col("_said")[c]), (lambda c: F.col("_titled")[c])
    second = df.select("*", found_in(text).alias("_said"), found_in(title).alias("_titled")).select(
        "*",
        said("objects").alias("objects"),
        titled("objects").alias("title_objects"),
        said("entities").alias("entities"),
        said("locations").alias("locations"),
        titled("aliased").alias("title_entities"),
        titled("locations").alias("title_locations"),
        dates_in(text).alias("dates"),
        key_numbers(text).alias("numbers"),
        normal_title(F.col("title")).alias("title_key"),
        title_tokens(F.col("title")).alias("title_tokens"),
        text_tokens(F.col("description"), lexicons.STOP_WORDS).alias("text_tokens"),
        text_tokens(text, lexicons.STOP_WORDS).alias("all_tokens"),
    )
    return second.select(
        "*",
        implied_or(said("named"), F.col("objects")).alias("actions"),
        implied_or(titled("named"), F.col("title_objects")).alias("title_actions"),
        F.transform("numbers", comparable).alias("quantities"),
    ).drop("_said", "_titled")


def specific() -> Column:
    """Whether title and text of with_features() rows name an entity, and an action or object of their own."""
    named = hits(F.concat_ws(" ", "title", "description"), lexicons.ACTIONS)
    return (F.size("entities") > 0) & ((F.size(named) > 0) | (F.size("objects") > 0))


def decided(
    df: DataFrame, now: str | Column, window_days: int | Column = 10, relevant: Column | None = None, listing: Column | None = None, relevance_first: bool = False
) -> DataFrame:
    """The first reason against each candidate, accepted without one; no row is lost, so the result is the audit too.

    listing: whether a row is no article. Feeds are judged by date first, search hits (relevance_first) by relevance.
    """
    at = F.lit(now).cast("timestamp")
    days = F.lit(window_days) if isinstance(window_days, int) else window_days
    fit = F.when(~relevant, "irrelevant") if relevant is not None else F.lit(None).cast("string")
    dates = [
        F.when(F.col("published_at") < at - F.make_dt_interval(days=days), "expired"),
        F.when(F.col("published_at") > at + F.make_dt_interval(hours=F.lit(6)), "future"),
    ]
    reason = F.coalesce(
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing-field"),
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "missing-field"),
        F.when(listing, "non-article-page") if listing is not None else F.lit(None).cast("string"),
        *([fit, *dates] if relevance_first else [*dates, fit]),
        F.lit("accepted"),
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")


def with_score(df: DataFrame, now: str | Column, impact_terms: list[str] | tuple[str, ...], learning: bool = False) -> DataFrame:
    """Source weight, freshness, impact terms, length of text, and a deduction for unknown dates.

    learning: what is of personal relevance counts too, as in the domain of that name.
    """
    text = F.concat_ws(" ", "title", "description")
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("published_at")) / 3600.0)
    fresh = F.coalesce(F.greatest(F.lit(0.0), F.lit(36.0) - age / 4), F.lit(0.0))
    impact = bound(F.lower(text), lambda low: sum((F.contains(low, F.lit(t)).cast("double") * 2.5 for t in impact_terms), F.lit(0.0)))
    detail = F.least(F.lit(8.0), F.length(text) / 220)
    unknown = F.when(F.col("published_at").isNull(), 20.0).otherwise(0.0)
    return df.withColumn("score", F.col("weight") + fresh + F.least(impact, F.lit(18.0)) + detail - unknown + (learning_relevance(text) if learning else F.lit(0)))


def search_bonus(match: Column, provider_score: Column) -> Column:
    """What a search hit's score has besides with_score(): half its match, 12 at most, and up to 6 for the provider's score."""
    return F.least(F.lit(12.0), match / 2) + F.greatest(F.lit(0.0), F.least(F.lit(6.0), F.coalesce(provider_score, F.lit(0.0)) * 6))


def hits_as_candidates(rows: DataFrame, domain: Domain, now: str | Column) -> DataFrame:
    """Search hits of one domain (with_features() and with_signals() rows, provider_score) judged, scored, tagged and named."""
    text = F.concat_ws(" ", "title", "description")
    listing = is_non_article(F.col("title"), F.col("url"), specific())
    judged = decided(rows, now, domain.window_days, F.col("relevant"), listing, relevance_first=True)
    scored = with_score(judged, now, domain.impacts, domain.name == "learning").withColumn("score", F.col("score") + search_bonus(F.col("match"), F.col("provider_score")))
    key = F.concat(F.lit(f"{domain.name}:search:"), "url")
    return scored.withColumn("tags", tags_of(text, domain)).withColumn("candidate_id", F.when(F.col("accepted"), F.substring(F.sha1(key.cast("binary")), 1, 12)))


def total_order() -> list[Column]:
    """Score, then known dates, later times, URL, domain, title and id."""
    known = F.col("published_at").isNotNull().cast("int")
    return [F.desc("score"), known.desc(), F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp")).desc(), F.asc("url"), F.asc("domain"), F.asc("title"), F.asc("id")]


def ranked(df: DataFrame, *within: str) -> DataFrame:
    """rank from 1 in the total order, within each of these columns' values.

    The rows are dealt out by ranges of the order, so that one value may hold any share of them; each range numbers its own
    rows, and the counts of the ranges before it, one row for each range and value, are added.
    """
    order = [*(F.asc(c) for c in within), *total_order()]
    df = durable(df)  # the ranges come from a look at all rows before they are dealt
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_range", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    counts = rows.groupBy("_range", *within).agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    names = {c: f"_of_{c}" for c in within}
    counts = counts.withColumnRenamed("_range", "_of_range").withColumnsRenamed(names)
    same = F.col("_range") == F.col("_of_range")
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    rank = (F.col("_n") - F.col("_first") + 1 + F.col("_before")).cast("int")
    return rows.join(F.broadcast(counts), same).withColumn("rank", rank).select(*df.columns, "rank")


def within_quota(df: DataFrame, groups: list[str], per_group: int, overall: int, order: list[Column]) -> DataFrame:
    """Admission in order: the first per_group rows of each group, of those the first `overall`.

    Groups keep at most per_group rows before the rows of all meet, so the last step orders few rows.
    """
    first = df.withColumn("_in_group", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_in_group") <= per_group)
    return first.orderBy(*order).limit(overall).drop("_in_group")


def diverse(df: DataFrame, group: str, by: str, per: int = 2, limit: int = 5) -> DataFrame:
    """For each group the best `limit` rows by rank, rows beyond `per` of one value of `by` only after all others."""
    inner = Window.partitionBy(group, by).orderBy("rank")
    late = df.withColumn("_late", (F.row_number().over(inner) > per).cast("int"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_late", "rank"))
    return late.withColumn("place", place).where(F.col("place") <= limit).drop("_late")
