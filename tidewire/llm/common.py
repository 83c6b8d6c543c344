"""What the corpus operators share: tables that cut lineage, word splitting, hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it waits for the driver's garbage collection.

    Python gives up its hold on JVM objects a moment after its own collection, hence the second turn.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def as_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc_id and text alone, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key() -> Column:
    """With doc_id, tells rows apart; rows equal in both have equal results."""
    return F.xxhash64("text")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column's values in UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    return x ^ (x >> np.uint64(31))


def batches_of(items: list, weights: list[int], most: int) -> Iterator[list]:
    """Consecutive groups of items with at most so much weight each, or one item."""
    group: list = []
    total = 0
    for item, weight in zip(items, weights, strict=True):
        if group and total + weight > most:
            yield group
            group, total = [], 0
        group.append(item)
        total += weight
    if group:
        yield group
