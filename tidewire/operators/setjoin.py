"""Exact similarity join of token sets by prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def similar_sets(left: DataFrame, right: DataFrame, least: float, *within: str) -> DataFrame:
    """Pairs (a, b, similarity) of left and right rows (id, tokens, and the columns of `within`, which must be equal).

    similarity: common by all tokens, at least `least`. Equal sets count once: pass distinct sets where copies are many.
    Sets that agree to `least` share one of the rarest n - ceil(n * least) + 1 tokens of both; only rows that share such
    a token and whose sizes fit meet. Null and empty sets are in no pair.
    """
    keys = list(within)
    both = left.select(*keys, "tokens").unionByName(right.select(*keys, "tokens"))
    counts = both.select(*keys, F.explode(F.array_distinct("tokens")).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("df"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        sets = df.select(*keys, F.col("id").alias(name), F.array_distinct("tokens").alias(f"set_{name}")).where(F.size(f"set_{name}") > 0)
        each = sets.select(*keys, name, F.size(f"set_{name}").alias("n"), F.explode(f"set_{name}").alias("token")).join(counts, [*keys, "token"])
        place = F.row_number().over(Window.partitionBy(*keys, name).orderBy("df", "token"))
        rare = each.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
        return rare.select(*keys, name, "token", F.col("n").alias(f"n_{name}")), sets

    (rare_a, sets_a), (rare_b, sets_b) = prefixes(left, "a"), prefixes(right, "b")
    sizes = (F.col("n_a") >= F.ceil(F.col("n_b") * least)) & (F.col("n_b") >= F.ceil(F.col("n_a") * least))
    pairs = rare_a.join(rare_b, [*keys, "token"]).where(sizes).select(*keys, "a", "b").distinct()
    full = pairs.join(sets_a, [*keys, "a"]).join(sets_b, [*keys, "b"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    similarity = common / (F.size("set_a") + F.size("set_b") - common)
    return full.withColumn("similarity", similarity).where(F.col("similarity") >= least).select(*keys, "a", "b", "similarity")
