"""Offline evaluation: ratios, diversity, pairwise precision and recall, ownership margins, daily digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n by d to four places, half up; 0 where d is 0 or null."""
    return F.coalesce(F.floor(n / F.nullif(d, F.lit(0)) * 10000 + 0.5) / 10000, F.lit(0.0))


def shared_share(df: DataFrame, group: str, key: str) -> DataFrame:
    """For each group the share of rows whose key is in other rows of the group too."""
    sizes = df.groupBy(group, key).agg(F.count("*").alias("n"))
    return sizes.groupBy(group).agg(F.sum("n").alias("rows"), ratio(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.sum("n")).alias("shared_share"))


def pairwise(df: DataFrame, found: str, gold: str) -> DataFrame:
    """Precision and recall of the pairs that `found` puts together, against those of `gold`; from group sizes, not pairs."""
    sizes = df.groupBy(found, gold).agg(F.count("*").alias("n"))
    kinds = {"p": sizes, "f": sizes.groupBy(found).agg(F.sum("n").alias("n")), "g": sizes.groupBy(gold).agg(F.sum("n").alias("n"))}
    counted = None
    for kind, df_ in kinds.items():
        part = df_.select(F.lit(kind).alias("kind"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
        counted = part if counted is None else counted.unionByName(part)
    one = counted.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("pairs"))), F.lit(0.0)).alias(k) for k in kinds))
    return one.select(ratio(F.col("p"), F.col("f")).alias("precision"), ratio(F.col("p"), F.col("g")).alias("recall"))


def owners(fits: DataFrame, item: str, domain: str, fit: str, low: float = 5.0) -> DataFrame:
    """The domain with the best fit for each item, its margin to the second, and whether that is low."""
    w = Window.partitionBy(item).orderBy(F.desc(fit), F.asc(domain))
    best = fits.withColumn("place", F.row_number().over(w)).withColumn("margin", F.col(fit) - F.lead(fit).over(w))
    return best.where("place = 1").select(item, F.col(domain).alias("owner"), fit, "margin", (F.coalesce("margin", F.lit(low)) < low).alias("low_confidence"))


def digest(events: DataFrame, lead: str, score: str, limit: int = 3) -> DataFrame:
    """The best `limit` events, one for each lead entity at most."""
    w = Window.partitionBy(lead).orderBy(F.desc(score), F.asc("id"))
    first = events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.orderBy(F.desc(score), F.asc("id")).limit(limit)
