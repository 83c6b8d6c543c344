"""Cleaned material: the sentences of a report that can be of the event its title names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.checks import sentences
from tidewire.functions.similarity import disjoint
from tidewire.functions.text import found_in, implied_or, strip_html, text_tokens
from tidewire.operators.claims import indicators, matches

#: Fixed value: titles that name no event.
GENERIC_TITLE = r"(?i)^(?:press release(?: details)?|news|article|homepage|untitled|exclusive)$"
_KINDS = ("entities", "actions", "objects", "locations")


def prints(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with what the column `text` says, each name after the prefix: entities, actions (named or implied), objects, locations,
    tokens, named (actions in so many words) and first (the aliased entity that comes first)."""
    value, found = F.coalesce(F.col(text), F.lit("")), (lambda c: F.col("_found")[c])
    first = df.withColumn("_found", found_in(value)).withColumn(f"{prefix}objects", found("objects"))
    return first.select(
        "*",
        found("entities").alias(f"{prefix}entities"),
        implied_or(found("named"), F.col(f"{prefix}objects")).alias(f"{prefix}actions"),
        found("locations").alias(f"{prefix}locations"),
        text_tokens(value, lexicons.STOP_WORDS).alias(f"{prefix}tokens"),
        found("named").alias(f"{prefix}named"),
        found("first").alias(f"{prefix}first"),
    ).drop("_found")


def _fits(title: str) -> Column:
    """Whether the sentence on a row can be of the event of its title."""
    t, s = (lambda c: F.col(f"t_{c}")), (lambda c: F.col(f"s_{c}"))
    marked = lambda c: F.size(indicators(c("objects"))) > 0
    clash = disjoint(t("objects"), s("objects")) | (marked(t) & marked(s) & ~F.arrays_overlap(t("objects"), s("objects")))
    says = ~F.col(title).rlike(GENERIC_TITLE) & (F.size(t("entities")) + F.size(t("actions")) + F.size(t("objects")) > 0)
    near = matches(t, s) | F.arrays_overlap(t("actions"), s("actions")) | (F.size(F.array_intersect(t("tokens"), s("tokens"))) >= 2)
    return ~clash & (~says | near)


def cleaned_material(reports: DataFrame, text: str = "description", key: str = "id") -> DataFrame:
    """(key, material) for reports (key, title, text): the sentences of the text that fit the title, each once, in order.

    A sentence is out if its objects are others than the title's, or both name indicators and none in common. Where the
    title names something, a sentence must share an entity, an object, an action or two words with it. Legal notes,
    navigation and what has under 12 characters go first. Keys are unique; null texts and titles are empty. A text's
    sentences are judged as rows, wherever they are, and come together again by key, only those that stay.
    """
    rows = reports.select(key, strip_html(F.col("title")).alias("_title"), F.col(text).alias("_text"))
    titled = prints(rows, "_title", "t_")
    each = titled.select(key, "_title", *(f"t_{c}" for c in (*_KINDS, "tokens")), F.posexplode(sentences(F.col("_text"))).alias("_at", "_sentence"))
    fit = prints(each, "_sentence", "s_").where(_fits("_title")).select(key, "_at", "_sentence")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_sentence"))), lambda x: x["_sentence"])
    kept = fit.groupBy(key).agg(F.trim(F.array_join(F.array_distinct(ordered), " ")).alias("material"))
    return reports.select(key).join(kept, key, "left").select(key, F.coalesce("material", F.lit("")).alias("material"))


def with_material(reports: DataFrame, key: str = "id") -> DataFrame:
    """reports with anchor and material.

    anchor: the title and what fits it of the description; material: that, what fits of full_text where there is one, and
    the day of publication.
    """
    day = F.date_format("published_at", "yyyy-MM-dd")
    found = reports.join(cleaned_material(reports, "description", key).withColumnRenamed("material", "_deck"), key)
    parts = ["title", "_deck"]
    if "full_text" in reports.columns:
        found = found.join(cleaned_material(reports, "full_text", key).withColumnRenamed("material", "_body"), key)
        parts.append("_body")
    return found.withColumn("anchor", F.trim(F.concat_ws(" ", "title", "_deck"))).withColumn("material", F.trim(F.concat_ws(" ", *parts, day))).drop("_deck", "_body")
