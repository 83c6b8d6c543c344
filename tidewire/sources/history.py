"""Earlier digests as an input: what they said and what they told readers to watch, by domain."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGEST = (
    "briefings array<struct<domain: string, stories: array<struct<title: string, summary: string, keyFacts: array<string>, "
    "trend: struct<signalsToWatch: array<string>>>>, watchNext: array<string>>>"
)


def landed_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, json): a row for each digest file; none if nothing has landed there yet."""
    try:
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("json"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id string, json string")


def _listed(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def _briefings(landed: DataFrame) -> DataFrame:
    """(id, briefing): of each digest (id, json), the first briefing of each domain. JSON that cannot be read has none."""
    briefings = F.from_json("json", DIGEST)["briefings"]
    domains = F.transform(briefings, lambda b: b["domain"])
    first = F.filter(briefings, lambda b, i: F.array_position(domains, b["domain"]) == i + 1)
    return landed.select("id", F.explode(first).alias("briefing"))


def previous_titles(landed: DataFrame) -> DataFrame:
    """(id, domain, position, title): the stories of earlier digests, from position 1."""
    found = _briefings(landed).select("id", F.col("briefing.domain").alias("domain"), F.posexplode("briefing.stories.title"))
    return found.select("id", "domain", (F.col("pos") + 1).cast("long").alias("position"), F.col("col").alias("title"))


def previous_signals(landed: DataFrame) -> DataFrame:
    """(id, domain, position, signal): of each story title, summary, facts and signals, then what to watch; empty ones are left out."""
    said = F.transform("briefing.stories", lambda s: F.concat(F.array(s["title"], s["summary"]), _listed(s["keyFacts"]), _listed(s["trend"]["signalsToWatch"])))
    signals = F.concat(_listed(F.flatten(said)), _listed(F.col("briefing.watchNext")))
    full = F.filter(signals, lambda v: v.isNotNull() & (v != ""))
    found = _briefings(landed).select("id", F.col("briefing.domain").alias("domain"), F.posexplode(full))
    return found.select("id", "domain", (F.col("pos") + 1).cast("long").alias("position"), F.col("col").alias("signal"))
