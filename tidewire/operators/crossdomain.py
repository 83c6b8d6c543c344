"""Events that several domains selected: how surely two are one, and which domain keeps it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.quantities import compatible
from tidewire.functions.similarity import disjoint, jaccard, overlap

_COMPARED = (
    "domain", "id", "last_at", "urls", "title_key", "title_tokens", "title_entities", "title_actions", "title_objects", "title_locations", "title_quantities", "entities",
)


def confidence(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """high, medium or none: how surely two events of different domains are one."""
    hours = F.abs(F.unix_timestamp(a("last_at")) - F.unix_timestamp(b("last_at"))) / 3600
    indicator = lambda x: F.array_intersect(x, F.array(*map(F.lit, lexicons.INDICATORS)))
    entity, action, object_ = (overlap(a(c), b(c)) > 0 for c in ("title_entities", "title_actions", "title_objects"))
    title = jaccard(a("title_tokens"), b("title_tokens"))
    apart = disjoint(indicator(a("title_objects")), indicator(b("title_objects")))
    for c in ("title_objects", "title_actions", "title_locations"):
        apart |= disjoint(a(c), b(c))
    return (
        F.when(hours.isNull() | (hours > 72), "none")
        .when(F.arrays_overlap(a("urls"), b("urls")) | (a("title_key") == b("title_key")), "high")
        .when(apart | ~compatible(a("title_quantities"), b("title_quantities")), "none")
        .when((entity & action & object_ & (hours <= 48)) | ((title >= 0.92) & entity & (action | object_)), "high")
        .when((title >= 0.62) | (overlap(a("entities"), b("entities")) > 0) | action | object_, "medium")
        .otherwise("none")
    )


def cross_domain_pairs(selected: DataFrame, most: int = 10) -> DataFrame:
    """(a_domain, a, b_domain, b, confidence) of high and medium pairs, a's domain before b's by name.

    selected: the events that domains chose, with place; each domain's first `most` are read, which is the operator's
    limit. Pairs share a URL, a title or one of its tokens, an entity, an action or an object, as all such pairs do.
    """
    parts = {"urls": "u|", "title_tokens": "t|", "title_actions": "a|", "title_objects": "o|", "entities": "e|", "title_entities": "e|"}
    named = [F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, p=p: F.concat(F.lit(p), x)) for c, p in parts.items()]
    keyed = selected.where(F.col("place") <= most).withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("n|"), "title_key")), *named))))
    side = lambda p: keyed.select("key", *(F.col(c).alias(f"{p}_{c}") for c in _COMPARED))
    met = side("a").join(side("b"), "key").where("a_domain < b_domain").drop("key").dropDuplicates(["a_domain", "a_id", "b_domain", "b_id"])
    judged = met.withColumn("confidence", confidence(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).where("confidence <> 'none'")
    return judged.select("a_domain", F.col("a_id").alias("a"), "b_domain", F.col("b_id").alias("b"), "confidence")


def merged(selected: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """(domain, id, winner_domain, winner, kept) of each domain's first `most` events.

    In the order of domains and places, an event joins the first group that holds a sure match from another domain. The
    winner has the best fit, then the best priority, then the earlier domain and the smaller id. Only bounded rows meet in
    one task: `most` for each domain of `order`; events of other domains are left out.
    """
    chosen = selected.where((F.col("place") <= most) & F.col("domain").isin(order))
    high = cross_domain_pairs(chosen, most).where("confidence = 'high'")
    name = lambda p: F.struct(F.col(f"{p}_domain").alias("domain"), F.col(p).alias("id"))
    both = high.select(name("a").alias("x"), name("b").alias("y")).unionByName(high.select(name("b").alias("x"), name("a").alias("y")))
    near = both.groupBy("x").agg(F.collect_set(F.concat_ws("\x1f", "y.domain", "y.id")).alias("near")).select("x.*", "near")
    rows = chosen.select("domain", "id", "place", "fit", "priority").join(near, ["domain", "id"], "left")
    rows = rows.withColumn("near", F.coalesce("near", F.array().cast("array<string>"))).withColumn("turn", F.array_position(F.array(*map(F.lit, order)), F.col("domain")))

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for row in table.sort_values(["turn", "place"]).itertuples(index=False):
            known = set(row.near)
            own = next((g for g in groups if any(f"{m.domain}\x1f{m.id}" in known for m in g)), None)
            if own is None:
                groups.append(own := [])
            own.append(row)
        out = []
        for g in groups:
            best = min(g, key=lambda m: (-m.fit, -m.priority, m.turn, m.id))
            out += [(m.domain, m.id, best.domain, best.id, m is best or m.domain == best.domain and m.id == best.id) for m in g]
        return pd.DataFrame(out, columns=["domain", "id", "winner_domain", "winner", "kept"])

    return rows.groupBy().applyInPandas(fold, "domain string, id string, winner_domain string, winner string, kept boolean")
