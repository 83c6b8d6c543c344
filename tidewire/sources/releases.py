"""Tables that readers see whole: data is written first, then one small commit that names it; readers follow commits.

A run that ends between the two leaves data that nobody reads, and the release before it stays current. Commits are rows of
their own folder, so that runs that write at once do not touch each other's.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import nfkc

_COMMIT = "seq long, day string, version int, complete boolean, path string"


def _commit(spark: SparkSession, root: str, day: str, path: str | None, version: int = 1, complete: bool = True) -> None:
    seq = time.time_ns()
    spark.createDataFrame([(seq, day, version, complete, path)], _COMMIT).coalesce(1).write.json(f"{root}/commits/{seq}-{uuid.uuid4().hex}")


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """The commits under root; none where nothing was written yet."""
    try:
        return spark.read.schema(_COMMIT).json(f"{root}/commits/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def release(stories: DataFrame, gates: DataFrame, root: str, day: str) -> bool:
    """Publish stories (with a domain) as the release of this day, and return True; nothing changes if a gate (domain, errors) is broken.

    One commit makes the digest and all its domains current at once, as the latest release and as the day's.
    """
    if not gates.where(F.col("errors") != "").isEmpty():
        return False
    path = f"{root}/data/{day}-{uuid.uuid4().hex}"
    stories.write.partitionBy("domain").json(path)
    _commit(stories.sparkSession, root, day, path)
    return True


def released(spark: SparkSession, root: str, day: str | None = None) -> DataFrame | None:
    """The release of a day, or the latest; None if there is none. Of a day's releases the last counts."""
    commits = _commits(spark, root)
    last = (commits if day is None else commits.where(F.col("day") == day)).orderBy(F.desc("seq")).first()
    return None if last is None else spark.read.json(last["path"])


def store_answers(answers: DataFrame, root: str, day: str, version: int = 1) -> None:
    """Add answers (query, position and more) of a search to the day's cache; several writes of a query are kept, the last is read."""
    path = f"{root}/data/{day}-{uuid.uuid4().hex}"
    answers.withColumn("request", _request()).withColumn("written", F.lit(time.time_ns())).write.json(path)
    _commit(answers.sparkSession, root, day, path, version, complete=False)


def mark_complete(spark: SparkSession, root: str, day: str, version: int = 1) -> None:
    _commit(spark, root, day, None, version)


def is_complete(spark: SparkSession, root: str, day: str, version: int = 1) -> bool:
    return not _commits(spark, root).where((F.col("day") == day) & (F.col("version") == version) & F.col("complete")).isEmpty()


def cached_answers(spark: SparkSession, root: str, day: str, version: int = 1) -> DataFrame | None:
    """The day's answers, of each query those of the last write; None if there are none of this day and version.

    Queries are the same if they agree in compatibility normal form, letter case and white space. A query that was answered
    with nothing has to be stored as a row with a null position, which is read as no answer.
    """
    commits = _commits(spark, root).where((F.col("day") == day) & (F.col("version") == version) & F.col("path").isNotNull())
    paths = [r["path"] for r in commits.select("path").collect()]  # as many as writes in a day
    if not paths:
        return None
    rows = spark.read.json(paths)
    last = rows.groupBy("request").agg(F.max("written").alias("written"))
    return rows.join(last, ["request", "written"], "left_semi").where("position is not null").drop("request", "written")


def _request() -> Column:
    return F.trim(F.regexp_replace(nfkc(F.col("query")), r"(?U)\s+", " "))
