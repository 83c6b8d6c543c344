"""How well candidates and events fit a domain: match signals, relevance, fit, and the gate before selection."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.catalog import LOW_VALUE, MARKET_CORE, MARKET_OBJECTS, Domain
from tidewire.functions.text import _finder, _fold, folded_pattern, hits, occurring, of_host
from tidewire.operators.selection import FIT, by_level

# Patterns of personal relevance for the learning domain.
LEARNING_PRIORITY = (
    r"\bIB\b|international baccalaureate|\bOECD\b|\bPISA\b|\bUNESCO\b|AI literacy|artificial intelligence literacy|assessment|learning science"
    r"|curriculum reform|education reform|national education policy|国际文凭|经合组织|联合国教科文组织|人工智能素养|AI 素养|评估|学习科学|课程改革|教育改革|国家教育政策"
)
LEARNING_LOCAL = (
    r"local school|school board|school district|campus event|campus police|principal appointed|superintendent|地方学校|学区|校园活动|校长任命|校园治安"
)
LEARNING_NATIONAL = r"national|nationwide|federal|ministry|department of education|supreme court|constitutional|全国|国家级|联邦|教育部|最高法院|违宪"


@F.pandas_udf(T.IntegerType())
def learning_relevance(texts: pd.Series) -> pd.Series:
    """Eight for each mention of a priority, 24 at most; 24 less for what is of local interest only; 0 for null."""
    return texts.map(_learning).astype("int32")


def _learning(text: str | None) -> int:
    low = _fold(text or "")
    kinds = {i for i, _ in _finder(*((("", p),) for p in (LEARNING_PRIORITY, LEARNING_LOCAL, LEARNING_NATIONAL))).matches(low)}
    n = sum(1 for _ in _priorities().finditer(low)) if 0 in kinds else 0
    return min(24, n * 8) - (24 if 1 in kinds and 2 not in kinds else 0)


@functools.cache
def _priorities() -> re.Pattern:
    return re.compile(folded_pattern(LEARNING_PRIORITY), re.ASCII)


def with_signals(df: DataFrame, domain: Domain, query_tokens: list[str] | Column | None = None) -> DataFrame:
    """match (a score) and relevant for rows with title, description, source_id, reliability and the features."""
    text = F.concat_ws(" ", "title", "description")
    counts = {"_topics": occurring(text, domain.topics), "_impacts": occurring(text, domain.impacts), "_tags": F.size(hits(text, list(domain.tags)))}
    asked = query_tokens if isinstance(query_tokens, Column) else F.array(*map(F.lit, query_tokens or [])).cast("array<string>")
    in_query = F.lit(0) if query_tokens is None else F.size(F.array_intersect(F.col("text_tokens"), asked))  # words are made only where they are asked for
    topics, impacts, tags = (F.col(c) for c in counts)
    own = F.arrays_overlap("objects", F.array(*map(F.lit, domain.objects))) if domain.objects else F.lit(False)
    official = (F.col("reliability") == "primary") & (of_host(F.col("source_id"), list(domain.hosts)) if domain.hosts else F.lit(False))
    acts = (F.size("entities") > 0) | (F.size("actions") > 0)
    match = (
        topics * 4 + impacts * 1.5 + tags * 2.5 + F.least(in_query, F.lit(5)) * 1.25 + F.least(F.size("entities"), F.lit(3))
        + F.least(F.size("actions"), F.lit(2)) * 1.5 + own.cast("int") * 5 + official.cast("int") * 8
        + (learning_relevance(text) if domain.name == "learning" else F.lit(0))
    )
    relevant = (topics > 0) | official | (own & acts) | ((tags > 0) & (acts | (in_query > 0))) | ((in_query >= 2) & acts)
    return df.withColumns(counts).withColumn("match", match.cast("double")).withColumn("relevant", relevant).drop(*counts)


def event_fit(reports: DataFrame, levels: DataFrame) -> DataFrame:
    """(event_id, fit, relevant): the best report's match, the evidence and the depth of the features of all reports.

    reports are with_signals() and event_id, and listing where some may be no articles; levels are (event_id, level).
    """
    found = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    worded = hits(F.concat_ws(" ", "title", "description"), [("low-value", LOW_VALUE), ("market", MARKET_CORE)])
    per = reports.withColumn("_worded", worded).groupBy("event_id").agg(
        F.greatest(F.lit(0.0), F.max("match")).alias("best"),
        F.bool_or(F.col("relevant") & (F.col("match") >= 4)).alias("relevant"),
        found("entities").alias("e"), found("actions").alias("a"), found("objects").alias("o"), found("numbers").alias("n"),
        F.count("published_at").alias("dated"),
        F.bool_or(F.array_contains("_worded", "low-value")).alias("low_value"),
        F.bool_or((F.size("entities") > 0) & (F.size("actions") > 0)).alias("concrete"),
        F.bool_or(F.array_contains("_worded", "market") | F.arrays_overlap("objects", F.array(*map(F.lit, MARKET_OBJECTS)))).alias("market_core"),
        F.bool_and(F.col("listing") if "listing" in reports.columns else F.lit(False)).alias("listing"),
    )
    depth = F.least("e", F.lit(3)) + F.least("a", F.lit(2)) + F.least("o", F.lit(2)) + F.least("n", F.lit(2)) * 0.5 + (F.col("dated") > 0).cast("int")
    return per.join(levels, "event_id").withColumn("fit", F.col("best") + by_level(F.col("level"), FIT) + depth)


def assessed(fits: DataFrame, markets: bool = False) -> DataFrame:
    """event_fit() with the first reason against each event, accepted without one; markets: events must be of the market."""
    reason = (
        F.when(F.col("listing"), "non-article-page")
        .when(F.col("low_value"), "low-news-value")
        .when(F.lit(markets) & ~F.col("market_core"), "domain-mismatch")
        .when(~F.col("concrete"), "no-event-action")
        .when(~F.col("relevant") | (F.col("fit") < 8), "domain-mismatch")
        .otherwise("accepted")
    )
    return fits.select("event_id", "fit", reason.alias("reason"))
