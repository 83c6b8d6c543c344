"""Connected components: union-find within each partition, then smallest labels over shuffles until none changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import written


def _forest(edges: DataFrame) -> DataFrame:
    """Of each partition's edges, a forest with the same components: a row (a, b) for every node but the roots."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def out() -> pa.RecordBatch:
            kept = [(x, root(x)) for x in list(parent)]
            kept = [(x, r) for x, r in kept if x != r]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000:
                yield out()
                parent.clear()
        yield out()

    return edges.mapInArrow(unite, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of edges (a, b): label is the smallest node of its component.

    Loops and repeated edges are harmless; null ends are dropped; no edges give no rows. Each round takes the smallest
    label around each node, then the label of that label, so rounds grow with the logarithm of a component's diameter.
    """
    edges = written(_forest(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")), "forest")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(around, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = lower.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        step = written(step, "labels")
        changed = not step.where("label <> old").isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels
