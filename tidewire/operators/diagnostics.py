"""Diagnosis and evaluation of a run: missed merges, alignment with a gold set, contributions of stages, upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.checks import has_english_fragment, has_html_artifact
from tidewire.functions.text import normal_title
from tidewire.operators.reports import ratio
from tidewire.operators.selection import ORDINAL, by_level
from tidewire.operators.setjoin import similar_sets


def missed_merges(events: DataFrame, least: float = 0.32, hours: int = 72) -> DataFrame:
    """Pairs of one domain's events that share an entity and an action, whose titles agree to `least`, within so many hours.

    events: id, domain, tokens, entities, actions, at. Pairs come from the similarity join, not from all pairs.
    """
    pairs = similar_sets(events.select("domain", "id", "tokens"), events.select("domain", "id", "tokens"), least, "domain").where("a < b")
    side = lambda p: events.select("domain", F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("entities", "actions", "at")))
    both = pairs.join(side("a"), ["domain", "a"]).join(side("b"), ["domain", "b"])
    apart = F.abs(F.unix_timestamp("a_at") - F.unix_timestamp("b_at"))
    shared = F.arrays_overlap("a_entities", "b_entities") & F.arrays_overlap("a_actions", "b_actions")
    return both.where(shared & (apart <= hours * 3600)).select("domain", "a", "b", F.round("similarity", 6).alias("similarity"))


def aligned(gold_urls: DataFrame, gold_titles: DataFrame, found: DataFrame, least: float = 0.64) -> DataFrame:
    """(gold_id, id): the first found row, by place, with a URL of the gold event or a title that agrees with one of its names.

    gold_urls: gold_id, url; gold_titles: gold_id, tokens; found: id, place, url, tokens.
    """
    bare = lambda c: F.regexp_replace(c, "/$", "")
    by_url = gold_urls.select("gold_id", bare("url").alias("url")).join(found.select("id", bare("url").alias("url")), "url").select("gold_id", "id")
    names = gold_titles.select(F.to_json(F.struct("gold_id", "tokens")).alias("id"), "tokens", "gold_id").distinct()
    by_title = similar_sets(names.select("id", "tokens"), found.select("id", "tokens"), least)
    by_title = by_title.join(names.select(F.col("id").alias("a"), "gold_id"), "a").select("gold_id", F.col("b").alias("id"))
    matches = by_url.unionByName(by_title).join(found.select("id", "place"), "id")
    return matches.groupBy("gold_id").agg(F.min_by("id", "place").alias("id"))


def recall(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: the share of gold events (gold_id) that are matched."""
    marked = gold.select("gold_id").distinct().join(matches.select("gold_id", F.lit(1).alias("hit")).distinct(), "gold_id", "left")
    return marked.agg(ratio(F.count("hit"), F.count("*")).alias("recall"))


def first_stage(reports: DataFrame, event: str, stage: Column, order: list[str]) -> DataFrame:
    """How many events each discovery stage found first, in this order of stages."""
    place = F.array_position(F.array(*map(F.lit, order)), stage)
    first = reports.where(place > 0).groupBy(event).agg(F.min(place).alias("place"))
    return first.groupBy("place").agg(F.count("*").alias("n")).select(F.element_at(F.array(*map(F.lit, order)), F.col("place").cast("int")).alias("stage"), "n")


def upgrades(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many events (event_id, level) have better and worse evidence after verification."""
    both = before.select("event_id", by_level(F.col("level"), ORDINAL).alias("x")).join(after.select("event_id", by_level(F.col("level"), ORDINAL).alias("y")), "event_id")
    return both.agg(F.count_if(F.col("y") > F.col("x")).alias("better"), F.count_if(F.col("y") < F.col("x")).alias("worse"))


def event_snapshots(reports: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, article_ids, article_urls, entities, actions, numbers): what an event consists of, sorted.

    reports: event, id, url, entities, actions and numbers.
    """
    ids = lambda c: F.array_sort(F.collect_set(c))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return reports.groupBy(event).agg(ids("id").alias("article_ids"), ids("url").alias("article_urls"), *(union(c).alias(c) for c in ("entities", "actions", "numbers")))


def _disjoint_within(reports: DataFrame, event: str, column: str) -> DataFrame:
    """Events two of whose reports name something in this list column and nothing in common; classes of equal lists meet, once each."""
    sets = reports.select(event, F.array_sort(F.array_distinct(column)).alias("x")).where(F.size("x") > 0).distinct()
    several = sets.groupBy(event).agg((F.count("*") > 1).alias("several")).where("several").select(event)
    sets = sets.join(several, event, "left_semi")
    return sets.join(sets.withColumnRenamed("x", "y"), event).where((F.col("x") < F.col("y")) & ~F.arrays_overlap("x", "y")).select(event).distinct()


def false_merges(reports: DataFrame, conflicts: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, reasons): why an event may hold reports of several; events without a reason are left out.

    reports: event, actions and numbers, as named; conflicts: events whose dates conflict.
    """
    found = [
        _disjoint_within(reports, event, "actions").withColumn("reason", F.lit("conflicting-actions")),
        _disjoint_within(reports, event, "numbers").withColumn("reason", F.lit("conflicting-key-numbers")),
        conflicts.select(event).distinct().withColumn("reason", F.lit("published-time-conflict")),
    ]
    all_ = found[0].unionByName(found[1]).unionByName(found[2])
    return all_.groupBy(event).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def dispositions(before: DataFrame, after: DataFrame, members: DataFrame, ownership: DataFrame, preselected: DataFrame, final: DataFrame) -> DataFrame:
    """(domain, id, event_id, outcome, reason): what became of each candidate (domain, id) of a run.

    after: candidates left by date recovery; members (domain, id, event_id); ownership (event_id, owner): events merged into
    another; preselected and final: event_id.
    """
    key = ["domain", "id"]
    rows = before.select(*key).distinct().join(after.select(*key).distinct().withColumn("stays", F.lit(True)), key, "left")
    rows = rows.join(members.select(*key, F.col("event_id").alias("own")), key, "left").join(ownership.select(F.col("event_id").alias("own"), "owner"), "own", "left")
    rows = rows.withColumn("event_id", F.coalesce("owner", "own"))
    mark = lambda df, c, name: df.select(F.col("event_id").alias(c)).distinct().withColumn(name, F.lit(True))
    rows = rows.join(mark(final, "event_id", "chosen"), "event_id", "left").join(mark(preselected, "own", "listed"), "own", "left")
    reason = (
        F.when(F.col("stays").isNull(), "date-recovery-rejected")
        .when(F.col("event_id").isNull(), "unknown-date-no-event")
        .when(F.col("chosen"), "final-selected")
        .when(F.col("listed"), "preselected-not-final")
        .otherwise("not-preselected")
    )
    outcome = F.when(reason == "final-selected", "selected").when(reason == "preselected-not-final", "retained").otherwise("eliminated")
    return rows.select(*key, "event_id", outcome.alias("outcome"), reason.alias("reason"))


def run_metrics(before: DataFrame, after: DataFrame, events: DataFrame, final: DataFrame) -> DataFrame:
    """One row about a run: dates missing and in conflict, evidence of what was chosen, concentration of sources, copies.

    before, after: candidates (domain, id, published_at, url, print) around date recovery; events: event_id, date_conflict;
    final: event_id, level, primary_present and source_id.
    """
    first = before.dropDuplicates(["domain", "id"]).agg(F.count("*").alias("candidates"), F.count_if(F.col("published_at").isNull()).alias("missing"))
    left = after.dropDuplicates(["domain", "id"])
    open_ = left.agg(F.count_if(F.col("published_at").isNull()).alias("unresolved"))
    of_events = events.agg(F.count("*").alias("events"), F.count_if("date_conflict").alias("conflict_events"))
    levels = [F.count_if(F.col("level") == k).alias(k.replace("-", "_")) for k in ORDINAL]
    chosen = final.agg(F.count("*").alias("final_events"), F.count_if("primary_present").alias("official"), *levels)
    most = final.groupBy(F.coalesce("source_id", F.lit("unknown-source")).alias("s")).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    shared = lambda c, name: left.groupBy(c).agg(F.count("*").alias("n")).agg(ratio(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.sum("n")).alias(name))
    row = first
    for part in (open_, of_events, chosen, most, shared("url", "duplicate_url_ratio"), shared("print", "duplicate_content_ratio")):
        row = row.crossJoin(part)  # one row each
    return row.select(
        "candidates", "missing", ratio(F.col("missing"), F.col("candidates")).alias("missing_ratio"), "unresolved", "conflict_events",
        ratio(F.col("conflict_events"), F.col("events")).alias("conflict_ratio"), "final_events", ratio(F.col("official"), F.col("final_events")).alias("official_ratio"),
        *(k.replace("-", "_") for k in ORDINAL), ratio(F.col("most"), F.col("final_events")).alias("source_concentration"), "duplicate_url_ratio", "duplicate_content_ratio",
    )


def content_quality(stories: DataFrame, by: str = "domain") -> DataFrame:
    """Counts for each domain over stories (title, summary, fields): summaries that repeat their title, left-over HTML, English fragments.

    fields: all texts of a story as an array; the counts of HTML and fragments are of fields.
    """
    title, summary = normal_title(F.col("title")), normal_title(F.col("summary"))
    rows = stories.select(by, "fields", title.alias("t"), summary.alias("s"))
    repeats = F.startswith("s", F.col("t")) | ((F.length("t") > 12) & F.contains("s", F.col("t")))
    broken = lambda test: F.coalesce(F.sum(F.size(F.filter("fields", test))), F.lit(0)).cast("long")
    return rows.groupBy(by).agg(
        F.count_if(repeats).alias("repeated_summaries"), broken(has_html_artifact).alias("html_artifacts"), broken(has_english_fragment).alias("english_fragments")
    )
