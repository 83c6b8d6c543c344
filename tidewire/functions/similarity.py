"""Similarity of token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Common by all elements of two sets given as arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Common elements by those of the smaller set; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def disjoint(a: Column, b: Column) -> Column:
    """Whether both sets have elements and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def angles_distinct(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Whether two stories of one event look at it differently: token sets of titles, summaries and facts, none of which agree much."""
    title, summary, facts = (jaccard(x, y) for x, y in zip(a, b, strict=True))
    return (title < 0.5) & (summary < 0.42) & (facts < 0.42)
