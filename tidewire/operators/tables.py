"""Cutting lineage in a folder that driver and executors share, and joins on keys that very many rows hold."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder named in spark.checkpoint.dir; in a local one only where that is unset and Spark runs on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewire-"))
    return df.checkpoint()


def spread_join(many: DataFrame, few: DataFrame, key: str, row: Column, how: str = "inner", most: int = 50_000, copied: int = 0) -> DataFrame:
    """many joined with few on key, where any key may hold a third of all rows of many.

    A key with more than `most` rows is dealt to several tasks by the hash of `row`, a column of many, and its rows of few
    are copied to each of them. `most` grows with many, so that at most 100,000 keys are dealt out: their list is broadcast.
    few should have few rows a key, since those are what is copied. Null keys meet nothing; how is inner or left.
    copied: a few with at most so many rows is copied to all tasks instead, and many's rows stay where they are.
    """
    if copied and (few := durable(few)).count() <= copied:
        return many.join(F.broadcast(few), key, how)
    counts = durable(many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(most, -(-total // 100_000))
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(row), parts).cast("int")).drop("_parts")
    each = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [key, "_part"], how).drop("_part")
