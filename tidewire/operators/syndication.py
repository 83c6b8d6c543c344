"""Copies of one text under several publishers: what an event's reports count as when independent sources are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import lexicons
from tidewire.functions.checks import wire_key
from tidewire.functions.text import normal_title, text_tokens, title_tokens
from tidewire.operators.tables import durable


def _of_others(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, first): the first agencies that reports with this group and key name, one each of two sources.

    Whatever its own source, a report finds the first one of others among them.
    """
    per = rows.where(F.col("wire").isNotNull() & F.col(key).isNotNull()).groupBy(group, key, "source_id").agg(F.min("wire").alias("w"))
    two = per.withColumn("_n", F.row_number().over(Window.partitionBy(group, key).orderBy("w", "source_id"))).where("_n <= 2")
    return two.groupBy(group, key).agg(F.array_sort(F.collect_list(F.struct("w", "source_id"))).alias("first"))


def _shared(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key) that several sources have."""
    return rows.where(F.col(key).isNotNull()).groupBy(group, key).agg((F.min("source_id") < F.max("source_id")).alias("several")).where("several").select(group, key)


def _short(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"content:{kind}:"), F.substring(F.sha1(value.cast("binary")), 1, 12))


def _prefix(words: str, least: float) -> Column:
    """Of a set of words those of which sets that agree to `least` share one: the longest, which are the rarest in most texts."""
    ordered = F.array_sort(F.transform(words, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(F.slice(ordered, 1, F.greatest(F.size(words) - F.ceil(F.size(words) * F.lit(least)).cast("int") + 1, F.lit(0))), lambda x: x["v"])


def _near_titles(titles: DataFrame, asked: DataFrame, named: DataFrame, group: str) -> DataFrame:
    """(group, title_key, other): titles of asked and of named reports that agree to 0.9 in their words, each with itself too.

    titles: group, title_key, tokens, a row a title; asked and named: group and title_key. Equal titles agree if they have words.
    """
    sets = titles.where(F.size("tokens") > 0).select(group, "title_key", "tokens", F.size("tokens").alias("n"))
    keyed = sets.select(group, "title_key", "n", F.explode(_prefix("tokens", 0.8999)).alias("t"))
    a = keyed.join(asked.distinct(), [group, "title_key"], "left_semi")
    b = keyed.join(named.distinct(), [group, "title_key"], "left_semi").select(group, "t", F.col("title_key").alias("other"), F.col("n").alias("m"))
    met = a.join(b, [group, "t"]).where((F.col("n") >= F.col("m") * 0.8999) & (F.col("m") >= F.col("n") * 0.8999)).select(group, "title_key", "other").distinct()
    full = met.join(sets.drop("n"), [group, "title_key"]).join(sets.select(group, F.col("title_key").alias("other"), F.col("tokens").alias("_tokens")), [group, "other"])
    heads = F.size(F.array_intersect("tokens", "_tokens"))
    return full.where(heads / (F.size("tokens") + F.size("_tokens") - heads) >= 0.9).select(group, "title_key", "other")


def _near_classes(classes: DataFrame, titles: DataFrame, group: str) -> DataFrame:
    """(class, by_likeness): the first agency of another source's class with nearly the same title and description.

    classes: class, group, title_key, words, asked, w, s0, s1; titles: (group, title_key, other) that agree. Classes of such
    titles meet by a word of the description's prefix, as a number, so that what is shuffled is narrow; their sets come
    together only for pairs whose sizes fit. The limits here leave room for rounding; the exact ones follow. Descriptions
    without words are alike: those meet by titles alone.
    """
    word = F.explode(F.when(F.size("words") == 0, F.array(F.lit(""))).otherwise(_prefix("words", 0.8199))).alias("d")
    n = F.size("words").alias("n")
    a = classes.where("asked").select(group, "title_key", F.col("class").alias("a"), n, word).join(titles, [group, "title_key"])
    a = a.select(F.xxhash64(group, "other", "d").alias("key"), "a", F.col("n").alias("na"))
    b = classes.where("w is not null").select(group, "title_key", F.col("class").alias("b"), n, word)
    b = b.select(F.xxhash64(group, "title_key", "d").alias("key"), "b", F.col("n").alias("nb"))
    met = a.join(b, "key").where("a <> b").where((F.col("na") >= F.col("nb") * 0.8199) & (F.col("nb") >= F.col("na") * 0.8199)).select("a", "b").distinct()
    side = lambda p: classes.select(F.col("class").alias(p), *(F.col(c).alias(f"{c}_{p}") for c in (group, "title_key", "words", "w", "s0", "s1")))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where(F.col(f"{group}_a") == F.col(f"{group}_b"))
    agreed = titles.select(F.col(group).alias(f"{group}_a"), F.col("title_key").alias("title_key_a"), F.col("other").alias("title_key_b"))
    pairs = pairs.join(agreed, [f"{group}_a", "title_key_a", "title_key_b"], "left_semi")  # numbers that clash by chance end here
    both = F.size(F.array_intersect("words_a", "words_b"))
    alike = both >= 0.82 * (F.size("words_a") + F.size("words_b") - both)
    return pairs.where(alike).where("not (s0_a = s1_b and s1_a = s0_b)").groupBy(F.col("a").alias("class")).agg(F.min("w_b").alias("by_likeness"))


def _with_keys(rows: DataFrame) -> DataFrame:
    """rows (title, description and more) with their normal titles and texts, and both as one; empty texts have none."""
    full = rows.withColumn("title_key", normal_title(F.col("title"))).withColumn("text_key", F.nullif(normal_title(F.col("description")), F.lit("")))
    return full.withColumn("both_key", F.concat_ws(":", "title_key", F.coalesce("text_key", F.lit(""))))


def effective_keys(reports: DataFrame, group: str = "event_id") -> DataFrame:
    """(group, id, wire, effective_key, via) for reports (group, id, source_id, url, title, description).

    A report counts as the agency that it names. Naming none, it counts as the first agency named by another source's
    report with the same URL, title or description, or with a title that agrees to 0.9 and a description to 0.82. Without
    an agency, sources that share a URL, or both title and description, count as that content; others as their publisher.
    via says which of these applied. Reports meet in groups of equal keys and as minima; pairs are made only of classes of
    equal titles and descriptions, and only of those that share a rare word of both.
    """
    reports = reports.select(group, "id", "source_id", "url", "title", F.coalesce("description", F.lit("")).alias("description"))
    full = _with_keys(reports)
    # From here on texts are known by their digests: rows are joined several times, and would take their texts with them.
    digest = lambda c: F.unhex(F.sha2(F.col(c).cast("binary"), 256)).alias(c)
    rows = base = durable(full.select(
        group, "id", "source_id", "url", wire_key(F.col("title"), F.col("description"), F.col("source_id")).alias("wire"), digest("title_key"), digest("text_key"), digest("both_key"),
        F.when(F.col("text_key").isNotNull(), _short("fingerprint", F.col("both_key"))).alias("fingerprint"),
    ))
    for key, name in (("url", "by_url"), ("title_key", "by_title"), ("text_key", "by_text")):
        named = _of_others(base, group, key).withColumnRenamed("first", f"_{name}")
        other = F.filter(f"_{name}", lambda x: x["source_id"] != F.col("source_id"))
        rows = rows.join(named, [group, key], "left").withColumn(name, F.try_element_at(other, F.lit(1))["w"]).drop(f"_{name}")
    for key, name in (("url", "same_url"), ("both_key", "same_both")):
        rows = rows.join(_shared(base, group, key).withColumn(name, F.lit(True)), [group, key], "left").withColumn(name, F.coalesce(name, F.lit(False)))

    # Likeness counts only where nothing before it does. Those reports' classes of equal titles and descriptions meet classes that
    # name an agency, titles first: texts are taken into words only for classes whose titles agree with one of the other side.
    rows = durable(rows)
    open_ = F.coalesce("wire", "by_url", "by_title", "by_text").isNull()
    sides = rows.groupBy(group, "both_key").agg(
        F.first("title_key").alias("title_key"), F.bool_or(open_).alias("asked"), F.min("wire").alias("w"), F.min("source_id").alias("s0"), F.max("source_id").alias("s1"), F.min("id").alias("id")
    )
    sides = durable(sides.where("asked or w is not null"))
    asked, named = (sides.where(which).select(group, "title_key") for which in ("asked", "w is not null"))
    titles = full.select(group, "title", digest("title_key")).distinct().select(group, "title_key", F.array_sort(title_tokens(F.col("title"))).alias("tokens"))
    titles = durable(titles.groupBy(group, "title_key").agg(F.min("tokens").alias("tokens")))
    near = durable(_near_titles(titles, asked, named, group))
    mine, theirs = near.select(group, "title_key").distinct(), near.select(group, F.col("other").alias("title_key")).distinct()
    met = sides.where("asked").join(mine, [group, "title_key"], "left_semi").unionByName(sides.where("w is not null").join(theirs, [group, "title_key"], "left_semi"))
    met = durable(met.dropDuplicates([group, "both_key"]))
    few = F.broadcast(met) if met.count() <= 100_000 else met  # most texts meet none: they are not dealt out for that
    # Whose texts are wanted is told by ids before keys are made of them again.
    wanted = reports.join(F.broadcast(met.select("id")), "id", "left_semi") if few is not met and met.where("id is null").isEmpty() else reports
    texts = _with_keys(wanted).select(F.col(group).alias("_group"), F.col("id").alias("_id"), F.col("both_key").alias("_text"), "description").withColumn("_both", digest("_text")).drop("_text")
    same = (F.col("_group") == F.col(group)) & (F.col("_both") == F.col("both_key")) & F.col("_id").eqNullSafe(F.col("id"))
    texts = texts.join(few, same).select(*met.columns, text_tokens(F.col("description"), lexicons.STOP_WORDS).alias("words"))
    classes = durable(texts.dropDuplicates([group, "both_key"]).withColumn("class", F.monotonically_increasing_id()))
    near = _near_classes(classes, near, group).join(classes.select("class", group, "both_key"), "class").select(group, "both_key", "by_likeness")
    rows = rows.join(near, [group, "both_key"], "left")

    ways = [
        ("attribution", F.col("wire")), ("canonical-url", F.col("by_url")), ("exact-title", F.col("by_title")), ("exact-description", F.col("by_text")),
        ("likeness", F.col("by_likeness")), ("shared-url", F.when(F.col("same_url"), _short("url", F.col("url")))),
        ("shared-text", F.when(F.col("same_both"), F.col("fingerprint"))),
        ("publisher", F.concat(F.lit("publisher:"), "source_id")),
    ]
    return rows.select(
        group, "id", "wire", F.coalesce(*(key for _, key in ways)).alias("effective_key"), F.coalesce(*(F.when(key.isNotNull(), F.lit(way)) for way, key in ways)).alias("via")
    )
