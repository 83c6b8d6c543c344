"""Numbers that reports bear out: which reports support a text's numbers, facts with numbers, and cutting out what none supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.checks import fact_sentences, number_words
from tidewire.functions.numerals import has_numbers, mended, number_sentences, numeric_expressions, says_enough, without_expressions
from tidewire.functions.quantities import comparable
from tidewire.functions.similarity import disjoint
from tidewire.functions.text import composed, dates_in, found_in, key_numbers, number_tokens
from tidewire.operators.claims import indicators, numbers_borne_out
from tidewire.operators.material import cleaned_material, with_material
from tidewire.operators.tables import durable, spread_join

_PRINT = ("entities", "actions", "objects", "dates")
#: An event's reports hold whole texts: they are not dealt out for up to so many claims, which go to them.
CLAIMS = 10_000


def _told(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with what the column `text` names itself: entities, actions, objects and dates; nothing is inferred."""
    value, found = F.coalesce(F.col(text), F.lit("")), (lambda c: F.col("_found")[c])
    return df.withColumn("_found", found_in(value)).select(
        "*",
        found("entities").alias(f"{prefix}entities"), found("named").alias(f"{prefix}actions"), found("objects").alias(f"{prefix}objects"), dates_in(value).alias(f"{prefix}dates"),
    ).drop("_found")


def with_said(reports: DataFrame) -> DataFrame:
    """reports without full_text, with r_*: what title and description name themselves, found once for all that asks for it."""
    return _told(reports.withColumn("_all", F.concat_ws(" ", "title", "description")), "_all", "r_").drop("_all")


def supporting_reports(reports: DataFrame, event: str = "event_id") -> DataFrame:
    """What reports can support numbers with: (event, id, url and columns m_*, r_*, quantities, plain).

    reports: event, id, url, title, description, source_name, published_at, full_text if there is one, and material if they are
    with_material() rows already; with_said() rows have r_* already. m_* is of the cleaned material with the publisher's name, r_* of all that the report says; quantities and plain, its text in lower
    case without thousands separators and number words, are of all that it says too: cleaning may cut a source's numbers.
    """
    body = [F.coalesce("full_text", F.lit(""))] if "full_text" in reports.columns else []
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit(""))
    rows = (reports if "material" in reports.columns else with_material(reports)).withColumn("_material", F.concat_ws(" ", "material", "source_name"))
    rows = rows.withColumn("_raw", F.concat_ws(" ", "title", "description", *body)).withColumn("_dated", F.concat_ws(" ", "_raw", day))
    told = _told(rows, "_material", "m_")
    told = told if "r_entities" in told.columns else _told(told, "_raw", "r_")
    plain = F.lower(F.replace(number_words(F.col("_dated")), F.lit(","), F.lit("")))
    wide = told.withColumn("quantities", F.transform(key_numbers(F.col("_dated")), comparable)).withColumn("plain", plain)
    return wide.select(event, "id", "url", *(f"{p}{c}" for p in ("m_", "r_") for c in _PRINT), "quantities", "plain")


def _claims(df: DataFrame, text: str) -> DataFrame:
    """df with what a claim's numbers are judged by: n_* of the column `text`, its quantities and its number tokens."""
    value = F.col(text)
    return _told(df, text, "n_").withColumn("n_quantities", F.transform(key_numbers(value), comparable)).withColumn("n_tokens", number_tokens(value))


def _numbers_agree() -> Column:
    """Whether the report on a row has the numbers of the claim on it, and names nothing that speaks against it."""
    report = lambda c: F.col(c if c == "quantities" else f"m_{c}")
    return numbers_borne_out(lambda c: F.col(f"n_{c}"), report, F.col("n_tokens"), F.col("plain"))


def _context_agrees() -> Column:
    """Whether the whole sentence on a row can be of the report on it."""
    apart = disjoint(indicators(F.col("c_objects")), indicators(F.col("r_objects"))) | disjoint(F.col("c_entities"), F.col("r_entities")) | disjoint(F.col("c_actions"), F.col("r_actions"))
    dated = (F.size("c_dates") == 0) | (F.size("r_dates") == 0) | (F.size(F.array_except("c_dates", "r_dates")) == 0)
    return ~apart & dated


def number_support(texts: DataFrame, support: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, text, id, url) for texts (event, text) with numbers: the reports of the event that have all of them.

    Texts without numbers are not listed: any report will do for them. An event's reports are many, its texts few.
    """
    asked = _claims(texts.select(event, "text").where(has_numbers(F.col("text"))).distinct(), "text")
    return spread_join(support, asked, event, F.col("id"), copied=CLAIMS).where(_numbers_agree()).select(event, "text", "id", "url")


def number_facts(reports: DataFrame, event: str = "event_id", most: int = 24) -> DataFrame:
    """(event, fact, place, id, url): the first `most` sentences with numbers that reports of an event state, and who states them.

    reports: event, place (which orders an event's reports), id, url, title, description and full_text if there is one.
    Facts come from titles and cleaned texts, in the reports' order; those equal in compatibility normal form and white
    space are one, with each report that states it. One row for each fact and report.
    """
    parts = [reports.select(event, "place", "id", "url", F.lit(0).alias("part"), F.col("title").alias("text"))]
    for i, c in enumerate(c for c in ("description", "full_text") if c in reports.columns):
        kept = cleaned_material(reports, c).withColumnRenamed("material", "text")
        parts.append(reports.select(event, "place", "id", "url").join(kept, "id").select(event, "place", "id", "url", F.lit(i + 1).alias("part"), "text"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    each = rows.select(event, "place", "id", "url", "part", F.posexplode(fact_sentences(F.col("text"))).alias("at", "sentence"))
    fact = F.trim(F.regexp_replace(composed(F.col("sentence")), r"(?U)\s+", " "))
    each = durable(each.select(event, F.struct("place", "part", "at").alias("first"), "id", "url", fact.alias("fact")))
    first = each.groupBy(event, "fact").agg(F.min("first").alias("first"))
    chosen = first.withColumn("place", F.row_number().over(Window.partitionBy(event).orderBy("first")).cast("int")).where(F.col("place") <= most)
    stated = spread_join(each.select(event, "fact", "id", "url").distinct().withColumn("_key", _pair(event)), chosen.select("place", _pair(event).alias("_key")), "_key", F.col("id"))
    return stated.select(event, "fact", "place", "id", "url")


def _pair(event: str) -> Column:
    return F.concat_ws("\x1f", event, "fact")


def sanitized(fields: DataFrame, support: DataFrame, event: str = "event_id", whole: bool = False) -> DataFrame:
    """(event, field, at, text, cut) for fields (event, field, at, text): texts without the numbers that no report bears out.

    Each sentence's numeric expressions are looked for in the event's reports (supporting_reports() rows); those that
    none supports in its sentence are cut out, and words left hanging with them go too. Sentences of which under six
    letters or digits stay are dropped; text is null where nothing stays. cut counts the expressions cut out. Texts
    without numbers are trimmed. What stands between expressions stays as it is.

    whole: texts are judged as one sentence, and kept however short. Where fields have urls, those reports alone count for
    a text that names any.
    """
    keys = [event, "field", "at"]
    linked = F.coalesce("urls", F.array().cast("array<string>")) if "urls" in fields.columns else F.array().cast("array<string>")
    cut_up = F.array("text") if whole else number_sentences(F.col("text"))
    each = durable(fields.select(*keys, F.array_sort(linked).alias("urls"), F.posexplode(cut_up).alias("s", "sentence")))
    own = [event, "sentence", "urls"]
    judged = each.where(F.size(numeric_expressions(F.col("sentence"))) > 0).select(*own).distinct()
    spans = judged.select(*own, F.posexplode(F.transform(numeric_expressions(F.col("sentence")), F.trim)).alias("i", "raw"))
    asked = _told(_claims(spans, "raw"), "sentence", "c_")
    met = spread_join(support, asked, event, F.col("id"), copied=CLAIMS).where((F.size("urls") == 0) | F.array_contains("urls", F.col("url")))
    known = met.groupBy(*own, "i").agg(F.bool_or(_numbers_agree() & _context_agrees()).alias("known"))
    bad = spans.join(known, [*own, "i"], "left").where(~F.coalesce("known", F.lit(False))).groupBy(*own).agg(F.collect_set("i").alias("bad"))
    none = F.array().cast("array<int>")
    fixed = judged.join(bad, own, "left").withColumn("bad", F.coalesce("bad", none))
    fixed = fixed.select(*own, mended(without_expressions(F.col("sentence"), F.col("bad"))).alias("fixed"), F.size("bad").alias("n"))
    rows = each.join(fixed, own, "left").withColumn("fixed", F.coalesce("fixed", F.trim("sentence")))
    order = F.array_sort(F.collect_list(F.when(F.lit(whole) | says_enough(F.col("fixed")), F.struct("s", "fixed"))))
    found = rows.groupBy(*keys).agg(F.trim(F.array_join(F.transform(order, lambda x: x["fixed"]), "")).alias("_fixed"), F.coalesce(F.sum("n"), F.lit(0)).alias("_cut"))
    whole = fields.select(*keys, "text").join(found, keys, "left")
    text = F.when(has_numbers(F.col("text")), F.nullif("_fixed", F.lit(""))).otherwise(F.trim("text"))
    return whole.select(*keys, text.alias("text"), F.when(has_numbers(F.col("text")), F.coalesce("_cut", F.lit(0))).otherwise(0).cast("long").alias("cut"))
