"""Choice under constraints: pools, preselection, slates of five, publication gates, ranking of stories.

Pools are cut to a fixed number of rows for each domain first, which is the operator's own limit; the folds over them
read no more than that.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.setjoin import similar_sets

#: How evidence counts in a score, in a fit, and as an order.
BOOST = {"confirmed": 18, "corroborated": 14, "single-source": 3, "unverified": -16}
FIT = {"confirmed": 8, "corroborated": 6, "single-source": 1, "unverified": -3}
ORDINAL = {"unverified": 0, "single-source": 1, "corroborated": 2, "confirmed": 3}
PRIMARY_HOST = r"(?:^|\.)(?:federalreserve|bls|bea|sec|eia|treasury)\.gov$"
TIER_ONE_HOST = r"(?:^|\.)(?:reuters|apnews|bbc|bloomberg|ft|wsj|cnbc|npr|theguardian|dw|aljazeera|lemonde)\.(?:com|org|co\.uk|fr)$"


def by_level(level: Column, values: dict[str, int]) -> Column:
    """The value of a level of evidence; that of unverified for others."""
    return F.coalesce(*(F.when(level == k, F.lit(v)) for k, v in values.items()), F.lit(values["unverified"]))


def effective_reliability(host: Column, tier: Column) -> Column:
    """A host's own standing before the tier that was collected."""
    return F.when(host.rlike(f"(?i){PRIMARY_HOST}"), "primary").when(host.rlike(f"(?i){TIER_ONE_HOST}"), "tier-1").otherwise(tier)


def candidate_pool(df: DataFrame, previous: DataFrame, limit: int = 60, penalty: float = 18.0, least: float = 0.62) -> DataFrame:
    """The best rows of each domain, after a deduction for titles like those of earlier runs.

    df has id, domain, title_tokens and score; previous has id, domain and tokens.
    """
    sets = df.select("domain", "id", F.col("title_tokens").alias("tokens"))
    known = similar_sets(sets, previous, least, "domain").select("domain", F.col("a").alias("id")).distinct().withColumn("known", F.lit(True))
    scored = df.join(known, ["domain", "id"], "left").withColumn("pool_score", F.col("score") - F.when(F.col("known"), penalty).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("pool_score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= limit).drop("known")


#: How many events of one kind a preselection takes.
CAPS = {"source": 2, "lead": 2, "other": 1, "unverified": 1}


def _in_turn(rows: list, kinds: tuple[str, ...], limit: int, late: str | None = None) -> list:
    """Rows whose kinds all have room, in turn, up to `limit`; then the rest in order. Rows of the kind `late` wait for three others."""
    used: Counter = Counter()
    admitted: list = []
    for row in rows:
        own = {"source": row.source_id, "lead": row.lead, "other": row.reliability == "other" or None, "unverified": row.level == "unverified" or None}
        slots = [(kind, own[kind]) for kind in kinds if own[kind] is not None]
        waits = late is not None and own[late] is not None and len(admitted) < 3
        if len(admitted) < limit and not waits and all(used[slot] < CAPS[slot[0]] for slot in slots):
            used.update(slots)
            admitted.append(row)
    names = {row.id for row in admitted}
    return (admitted + [row for row in rows if row.id not in names])[:limit]


def preselect(pool: DataFrame, limit: int = 10, capped: bool = False) -> DataFrame:
    """(domain, id, position): up to `limit` events of each domain in order of place.

    Two of a source and two of a lead entity at most; unverified ones only after three others, or with `capped` one
    unverified and one of another source at most; open places go to the rest in order. pool has domain, id, place,
    source_id, lead, level and reliability, and is a candidate_pool().
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values("place").itertuples(index=False))
        got = _in_turn(rows, ("source", "lead"), limit, late="unverified")
        if capped:
            names = {r.id for r in got}
            got = _in_turn(got + [r for r in rows if r.id not in names], tuple(CAPS), limit)
        return pd.DataFrame({"domain": [r.domain for r in got], "id": [r.id for r in got], "position": range(1, len(got) + 1)})

    columns = pool.select("domain", "id", "place", "source_id", "lead", "level", "reliability")
    return columns.groupBy("domain").applyInPandas(choose, "domain string, id string, position long")


def slate_errors(rows: list, size: int = 5) -> list[str]:
    """The rules that events in order break together, sorted; those of gate()."""
    if not rows:
        return ["count"]
    sources, leads = Counter(r.source_id for r in rows), Counter(r.lead for r in rows)
    weak = [r.level == "unverified" for r in rows]
    rules = {
        "count": len(rows) != size, "few-sources": len(sources) < 3, "source-over-2": max(sources.values()) > 2, "lead-over-2": max(leads.values()) > 2,
        "other-over-1": sum(r.reliability == "other" for r in rows) > 1, "unverified": sum(weak) > 1 or any(weak[:3]),
        "weak-first": rows[0].reliability == "other" and rows[0].level == "single-source",
    }
    return sorted(name for name, broken in rules.items() if broken)


def slate_is_valid(rows: list) -> bool:
    """Whether five events in order may be published together."""
    return not slate_errors(rows)


def slates(selected: DataFrame, size: int = 5, most: int = 10) -> DataFrame:
    """(domain, id, position, feasible): the first valid combination of five of each domain's preselection, else the first five.

    Events come ordered by verified before unverified within reliable before other, then by position.
    """
    group_order = F.when(F.col("reliability") == "other", 2).otherwise(0) + F.when(F.col("level") == "unverified", 1).otherwise(0)
    bounded = selected.where(F.col("position") <= most).withColumn("_group", group_order)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values(["group", "position"]).itertuples(index=False))
        valid = next((c for c in combinations(rows, size) if slate_is_valid(list(c))), None)
        got = list(valid or rows[:size])
        return pd.DataFrame({"domain": [r.domain for r in got], "id": [r.id for r in got], "position": range(1, len(got) + 1), "feasible": valid is not None})

    columns = bounded.select("domain", "id", "position", "source_id", "lead", "level", "reliability", F.col("_group").alias("group"))
    return columns.groupBy("domain").applyInPandas(choose, "domain string, id string, position long, feasible boolean")


def gate(stories: DataFrame, size: int = 5) -> DataFrame:
    """For each domain the rules that its stories (domain, id, position, source_id, lead, level, reliability) break, sorted."""
    per = stories.groupBy("domain").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("source_id").alias("sources"),
        F.count_if(F.col("reliability") == "other").alias("other"),
        F.count_if(F.col("level") == "unverified").alias("unverified"),
        F.count_if((F.col("level") == "unverified") & (F.col("position") <= 3)).alias("early"),
        F.count_if((F.col("position") == 1) & (F.col("reliability") == "other") & (F.col("level") == "single-source")).alias("weak_first"),
    )
    most = lambda c, name: stories.groupBy("domain", c).agg(F.count("*").alias("k")).groupBy("domain").agg(F.max("k").alias(name))
    all_ = per.join(most("source_id", "per_source"), "domain").join(most("lead", "per_lead"), "domain")
    rules = {
        "count": F.col("n") != size, "repeated-id": F.col("ids") != F.col("n"), "few-sources": F.col("sources") < 3, "source-over-2": F.col("per_source") > 2,
        "lead-over-2": F.col("per_lead") > 2, "other-over-1": F.col("other") > 1, "unverified": (F.col("unverified") > 1) | (F.col("early") > 0),
        "weak-first": F.col("weak_first") > 0,
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return all_.select("domain", F.array_join(F.array_sort(broken), ",").alias("errors"))


def renumbered(stories: DataFrame) -> DataFrame:
    """Stories with a new position: restricted ones, unverified or of other sources, after the rest, order kept."""
    late = ((F.col("level") == "unverified") | (F.col("reliability") == "other")).cast("int")
    return stories.withColumn("position", F.row_number().over(Window.partitionBy("domain").orderBy(late, "position")).cast("long"))
