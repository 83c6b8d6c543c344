"""Sinks: stories by date and domain, held back if a gate is broken; diagnostics by run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.checks import redact_secrets


def publish(stories: DataFrame, gates: DataFrame, folder: str, day: str) -> bool:
    """Write stories as JSON for this day, by domain, and return True; write nothing if a gate (domain, errors) is broken.

    A second run of a day replaces that day alone.
    """
    if not gates.where(F.col("errors") != "").isEmpty():
        return False
    dated = stories.withColumn("date", F.lit(day))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "domain").json(folder)
    return True


def write_diagnostics(rows: DataFrame, folder: str, run_id: str, secrets: tuple[str, ...] = ()) -> None:
    """Append a run's rows as JSON, without secrets in any text column."""
    texts = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    safe = rows.select(*(redact_secrets(F.col(c), secrets).alias(c) if c in texts else F.col(c) for c in rows.columns))
    safe.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(folder)
