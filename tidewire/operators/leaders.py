"""Greedy leaders without pairs: each row joins the first kept row, in rank order, that it shares a group with.

The kept rows are the first independent set in rank order. Each round keeps the rows that come first among the open rows
of all their groups and drops the rows that share a group with a kept one. Groups meet only as minima, which Spark
combines before the shuffle: a group with a third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.tables import durable


def greedy_leaders(members: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(id, leader) for members (id, rank, key): a row for each group that a row is in; ranks are unique.

    links (key, other), in both directions, makes the rows of one group neighbours of the other's; rows of a group are
    neighbours of each other. Each round decides the first open row at least; a chain of neighbours in rank order is decided
    about one row a round.
    """
    sees = members.select("key", F.col("key").alias("other"))
    sees = durable((sees if links is None else sees.unionByName(links.select("key", "other"))).distinct())
    state = durable(members.select("id", "rank", "key").distinct().withColumn("leader", F.lit(None).cast("struct<rank:bigint,id:string>")))
    while True:
        # What each group holds: its first kept row, and the first row that is still open.
        me = F.struct(F.col("rank").cast("long").alias("rank"), F.col("id").cast("string").alias("id"))
        held = state.groupBy(F.col("key").alias("other")).agg(
            F.min(F.when(F.col("leader.id") == F.col("id"), me)).alias("kept"), F.min(F.when(F.col("leader").isNull(), me)).alias("open")
        )
        near = sees.join(held, "other").groupBy("key").agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
        seen = state.join(near, "key").groupBy("id", "rank").agg(F.min("kept").alias("kept"), F.min("open").alias("open"), F.min("leader").alias("old"))
        found = (
            F.when(F.col("old").isNotNull(), F.col("old"))
            .when(F.col("kept.rank") < F.col("rank"), F.when(F.col("open.rank").isNull() | (F.col("open.rank") > F.col("kept.rank")), F.col("kept")))
            .when(F.col("open.rank") == F.col("rank"), me)
        )
        decided = seen.select("id", found.alias("leader"))
        state = durable(state.drop("leader").join(decided, "id"))
        if state.where("leader is null").isEmpty():
            return state.select("id", F.col("leader.id").alias("leader")).distinct()
