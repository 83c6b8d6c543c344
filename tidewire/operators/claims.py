"""Whether reports support what is claimed of their event: features of the claim against those of the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.checks import is_placeholder_summary
from tidewire.functions.quantities import close, compatible
from tidewire.functions.similarity import disjoint, overlap
from tidewire.operators.candidates import with_features

_CLAIM = ("entities", "actions", "objects", "locations", "dates", "numbers", "quantities", "all_tokens")


def indicators(objects: Column) -> Column:
    return F.array_intersect(objects, F.array(*map(F.lit, lexicons.INDICATORS)))


def matches(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether features b can be of the event with features a: no clash of indicators, or of both objects and actions; and an
    entity, an object, or an action at one place in common."""
    clash = disjoint(indicators(a("objects")), indicators(b("objects"))) | (disjoint(a("objects"), b("objects")) & disjoint(a("actions"), b("actions")))
    met = lambda c: F.arrays_overlap(a(c), b(c))
    return ~clash & (met("entities") | met("objects") | (met("actions") & met("locations")))


def conflicts(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether features b contradict the event with features a."""
    both = (F.size(indicators(a("objects"))) > 0) & (F.size(indicators(b("objects"))) > 0)
    apart = {c: disjoint(a(c), b(c)) for c in ("objects", "actions", "entities")}
    return (both & ~F.arrays_overlap(a("objects"), b("objects"))) | (apart["objects"] & (apart["actions"] | apart["entities"]))


def supports(claim: Callable[[str], Column], report: Callable[[str], Column]) -> Column:
    """Whether a report bears a claim out: whatever entities, actions and objects the claim names are the report's too, its
    numbers fit, and besides a sixth of the words, a number, or two kinds of features agree."""
    kinds = ("entities", "actions", "objects")
    met = {c: F.arrays_overlap(claim(c), report(c)) for c in kinds}
    fits = F.lit(True)
    for c in kinds:
        fits = fits & ((F.size(claim(c)) == 0) | met[c])
    has_numbers = F.size(claim("numbers")) > 0
    agreed = sum((met[c].cast("int") for c in kinds), F.lit(0))
    enough = has_numbers | (agreed >= 2) | (overlap(claim("all_tokens"), report("all_tokens")) >= 0.16)  # words last: they are many
    return fits & (~has_numbers | compatible(claim("quantities"), report("quantities"))) & enough


def supported(claims: DataFrame, reports: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, id, claim, supports) for each claim (event, claim) and each report of its event, with_features() rows.

    A claim that is empty or says nothing is supported by none.
    """
    stated = with_features(claims.select(event, F.col("claim").alias("title"), F.lit("").alias("description")))
    stated = stated.select(event, F.col("title").alias("claim"), *(F.col(c).alias(f"claim_{c}") for c in _CLAIM))
    met = supports(lambda c: F.col(f"claim_{c}"), F.col)
    return reports.join(stated, event).select(event, "id", "claim", (met & ~is_placeholder_summary(F.col("claim"))).alias("supports"))


def numbers_borne_out(claim: Callable[[str], Column], report: Callable[[str], Column], tokens: Column, plain: Column) -> Column:
    """Whether a report has the numbers of a claim, and no other entity, action, indicator or date than the claim's.

    Key numbers must each fit one of the report's; without any, the claim's number tokens must stand in plain, the report's
    text in lower case without thousands separators and number words.
    """
    stated, known = claim("quantities"), report("quantities")
    keyed = F.size(stated) > 0
    each = F.forall(stated, lambda x: F.exists(known, lambda y: close(x, y)))
    literal = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(plain, t))
    apart = disjoint(indicators(claim("objects")), indicators(report("objects"))) | disjoint(claim("entities"), report("entities")) | disjoint(claim("actions"), report("actions"))
    dated = (F.size(claim("dates")) == 0) | (F.size(report("dates")) == 0) | (F.size(F.array_except(claim("dates"), report("dates"))) == 0)
    return F.when(keyed, (F.size(known) > 0) & each).otherwise(literal) & ~apart & dated


def adds_detail(title: Callable[[str], Column], summary: Callable[[str], Column]) -> Column:
    """Whether a summary has a number, date, place, entity, action or object that its title has not."""
    found = F.lit(False)
    for c in ("numbers", "dates", "locations", "entities", "actions", "objects"):
        found = found | (F.size(F.array_except(summary(c), title(c))) > 0)
    return found
