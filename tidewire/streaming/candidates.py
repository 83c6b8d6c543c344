"""Candidates as a stream: each clean URL once within the time that late reports are waited for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import clean_url


def first_reports(stream: DataFrame, time_col: str = "published_at", url_col: str = "url", wait: str = "72 hours") -> DataFrame:
    """The first report of each clean URL; state is dropped once the watermark has passed. Rows without a time are left out."""
    dated = stream.where(F.col(time_col).isNotNull()).withColumn(url_col, clean_url(F.col(url_col)))
    return dated.withWatermark(time_col, wait).dropDuplicatesWithinWatermark([url_col])


def counts(stream: DataFrame, by: str, time_col: str = "published_at", width: str = "1 hour", wait: str = "72 hours") -> DataFrame:
    """Reports in each window of time for each value of `by`."""
    windows = stream.withWatermark(time_col, wait).groupBy(F.window(time_col, width).alias("w"), by)
    return windows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
