"""Comparable values of key numbers, and whether two reports' numbers can be of one event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What units multiply by.
DOLLARS = {"t": 1e12, "b": 1e9, "m": 1e6}
UNITS = {"trillion": 1e12, "万亿": 1e12, "万亿元": 1e12, "billion": 1e9, "亿元": 1e8, "million": 1e6, "gw": 1e3, "mw": 1.0}


def comparable(value: Column) -> Column:
    """A struct of raw, kind (currency, percent or quantity) and amount; kind is null for what has no known form."""
    number = r"^(\d+(?:\.\d+)?)"
    part = lambda p, g=1: F.regexp_extract(value, p, g)
    times = lambda unit, table: F.coalesce(*(F.when(unit == u, F.lit(m)) for u, m in table.items()), F.lit(1.0))
    usd, percent, bps = r"^usd:(\d+(?:\.\d+)?)([btm]?)$", number + r"\s?%$", number + r"\s?bps$"
    quantity = number + r"\s?(trillion|billion|million|万亿元|万亿|亿元|gw|mw)$"
    kind = F.when(value.rlike(usd), "currency").when(value.rlike(percent) | value.rlike(bps), "percent").when(value.rlike(quantity), "quantity")
    amount = (
        F.when(value.rlike(usd), part(usd).try_cast("double") * times(part(usd, 2), DOLLARS))
        .when(value.rlike(percent), part(percent).try_cast("double"))
        .when(value.rlike(bps), part(bps).try_cast("double") / 100)
        .when(value.rlike(quantity), part(quantity).try_cast("double") * times(part(quantity, 2), UNITS))
    )
    return F.struct(value.alias("raw"), kind.alias("kind"), amount.alias("amount"))


def close(a: Column, b: Column) -> Column:
    """Equal kinds and amounts within 1.5 %, percentages within 0.05 at least; numbers without a kind by their spelling."""
    scale = F.greatest(F.abs(a["amount"]), F.abs(b["amount"]), F.lit(1.0)) * 0.015
    within = F.abs(a["amount"] - b["amount"]) <= F.when(a["kind"] == "percent", F.greatest(scale, F.lit(0.05))).otherwise(scale)
    known = a["kind"].isNotNull() & b["kind"].isNotNull()
    return F.when(known, (a["kind"] == b["kind"]) & within).otherwise(a["raw"] == b["raw"])


def compatible(a: Column, b: Column) -> Column:
    """Whether any pair of numbers agrees; arrays of comparable(), empty ones agree with all."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.exists(a, lambda x: F.exists(b, lambda y: close(x, y)))
