"""Evaluation of a run by stages and against a labelled set: what found each event, what verification changed, recall and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import title_tokens
from tidewire.operators.reports import pairwise, ratio
from tidewire.operators.selection import ORDINAL, by_level
from tidewire.operators.setjoin import similar_sets

# Stages in the order in which they count, and what kinds of sources an event can have.
STAGES = ["rss", "base-search", "dynamic-search", "verification-search"]
OFFICIAL, INDEPENDENT, COPIES = "official", "independent-media", "wire-copy"


def stage_of(phase: Column) -> Column:
    """The stage of a decision or search by its phase: rss, base, dynamic or verification."""
    return F.when(phase == "rss", phase).otherwise(F.concat(phase, F.lit("-search")))


def candidate_stages(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, stage): the stage that found each candidate.

    candidates: id, place and stage; decisions: candidate_id, place, phase and accepted. The last accepted decision about a
    candidate counts, by place; without one, what the last of its own rows says.
    """
    own = candidates.groupBy("id").agg(F.max_by("stage", "place").alias("own"))
    said = decisions.where(F.col("accepted") & F.col("candidate_id").isNotNull()).groupBy(F.col("candidate_id").alias("id")).agg(F.max_by(stage_of(F.col("phase")), "place").alias("said"))
    return own.join(said, "id", "full").select("id", F.coalesce("said", "own").alias("stage"))


def event_stages(members: DataFrame, stages: DataFrame) -> DataFrame:
    """(event_id, first, found): the first stage that found a report of each event (event_id, id), and all that did, in order.

    Events none of whose reports has a known stage come from verification.
    """
    order = F.array(*map(F.lit, STAGES))
    known = members.select("event_id", "id").join(stages.where(F.col("stage").isin(*STAGES)), "id", "left")
    found = known.groupBy("event_id").agg(F.collect_set("stage").alias("s")).withColumn("found", F.filter(order, lambda v: F.array_contains("s", v)))
    return found.select("event_id", F.coalesce(F.try_element_at("found", F.lit(1)), F.lit(STAGES[-1])).alias("first"), "found")


def contribution(events: DataFrame, final: DataFrame) -> DataFrame:
    """For each stage: how many events it found first, how many of those were chosen, and of how many chosen ones it has reports.

    events as of event_stages(), final: event_id.
    """
    chosen = events.join(final.select("event_id", F.lit(True).alias("chosen")).distinct(), "event_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    each = chosen.select("chosen", "first", F.explode(F.array_union("found", F.array("first"))).alias("stage"), "found")
    new = F.col("first") == F.col("stage")
    counted = each.groupBy("stage").agg(
        F.count_if(new).alias("new_events"), F.count_if(new & F.col("chosen")).alias("final_events"), F.count_if(F.col("chosen") & F.array_contains("found", F.col("stage"))).alias("supported_events")
    )
    rows = events.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string").join(counted, "stage", "left")
    return rows.select("stage", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("new_events", "final_events", "supported_events")))


def searches(trace: DataFrame) -> DataFrame:
    """(stage, queries, results) of a trace (phase, outcome, results): how many questions were answered, and by how much."""
    known = trace.where(F.col("phase").isNotNull()).groupBy(stage_of(F.col("phase")).alias("stage"))
    return known.agg(F.count_if(F.col("outcome").isin("completed", "cache-hit")).alias("queries"), F.coalesce(F.sum("results"), F.lit(0)).cast("long").alias("results"))


def added_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """(event_id, id): reports that events have after verification and had not before, of events that were there before."""
    known = before.select("event_id").distinct()
    fresh = after.select("event_id", "id").distinct().join(before.select("event_id", "id").distinct(), ["event_id", "id"], "left_anti")
    return fresh.join(known, "event_id", "left_semi")


def verification_changes(before: DataFrame, after: DataFrame, members_before: DataFrame, members_after: DataFrame) -> DataFrame:
    """(event_id, level_before, level_after, change, added): what verification did to each event after it.

    before, after: event_id, level; members: event_id, id. An event that was not there before is held against itself: nothing
    changed or was added. added counts added_reports(); change is better, worse or same.
    """
    old = before.select("event_id", F.col("level").alias("_old"), F.lit(True).alias("_known"))
    added = added_reports(members_before, members_after).groupBy("event_id").agg(F.count("*").alias("added"))
    rows = after.select("event_id", F.col("level").alias("level_after")).join(old, "event_id", "left").join(added, "event_id", "left")
    level = F.when(F.col("_known"), F.col("_old")).otherwise(F.col("level_after"))
    x, y = by_level(level, ORDINAL), by_level(F.col("level_after"), ORDINAL)
    change = F.when(y > x, "better").when(y < x, "worse").otherwise("same")
    return rows.select("event_id", level.alias("level_before"), "level_after", change.alias("change"), F.coalesce("added", F.lit(0)).cast("long").alias("added"))


def final_evidence(clusters: DataFrame, verified: DataFrame) -> DataFrame:
    """(event_id, level): what verified events (event_id, level) have, else what clusters say."""
    both = clusters.select("event_id", F.col("level").alias("_own")).join(verified.select("event_id", F.col("level").alias("_new")), "event_id", "full")
    return both.select("event_id", F.coalesce("_new", "_own").alias("level"))


def _bare(url: str) -> Column:
    return F.regexp_replace(url, "/$", "")


def first_matches(gold_urls: DataFrame, gold_titles: DataFrame, urls: DataFrame, titles: DataFrame, least: float = 0.64) -> DataFrame:
    """(gold_id, id): the first row, by place, with a URL of the gold event or a title that agrees with one of its names.

    gold_urls: gold_id, url; gold_titles: gold_id, title; urls: id, place, url; titles: id, place, title. Only the first row of
    each URL and of each set of title words meets the gold events, so a URL or title may be that of a third of all rows.
    """
    first = F.min(F.struct("place", "id")).alias("f")
    asked = gold_urls.select("gold_id", _bare("url").alias("url")).distinct()
    by_url = asked.join(urls.groupBy(_bare("url").alias("url")).agg(first), "url").select("gold_id", "f")
    as_set = lambda df: df.withColumn("tokens", F.array_sort(title_tokens(F.col("title")))).where(F.size("tokens") > 0)
    names, sets = as_set(gold_titles).select("gold_id", "tokens").distinct(), as_set(titles).groupBy("tokens").agg(first)
    named = lambda df: df.select(F.array_join("tokens", " ").alias("id"), "tokens").distinct()
    near = similar_sets(named(names), named(sets), least).select("a", "b")
    by_title = near.join(names.select(F.array_join("tokens", " ").alias("a"), "gold_id"), "a").join(sets.select(F.array_join("tokens", " ").alias("b"), "f"), "b").select("gold_id", "f")
    return by_url.unionByName(by_title).groupBy("gold_id").agg(F.min("f").alias("f")).select("gold_id", "f.id")


def benchmark_metrics(
    gold: DataFrame, gold_articles: DataFrame, gold_titles: DataFrame, candidates: DataFrame, events: DataFrame, event_urls: DataFrame, ownership: DataFrame, final: DataFrame
) -> DataFrame:
    """One row: recall of candidates and of what was chosen, precision and recall of clusters, accuracy of domains, coverage of kinds of sources.

    gold: gold_id, domain and expected (kinds of sources); gold_articles: gold_id, url and cluster; gold_titles: gold_id, title;
    candidates: id, place, url, title; events: event_id, place, title, domain, primary_present, independent_count and copies
    (whether reports of several sources are one text); event_urls: event_id, url; ownership: event_id, owner; final: event_id.
    A URL of several events counts as of the last. Pairs are counted from sizes of groups, not made.
    """
    at = gold_articles.select("gold_id", "url")
    found = first_matches(at, gold_titles, candidates.select("id", "place", "url"), candidates.select("id", "place", "title"))
    ids = events.select(F.col("event_id").alias("id"), "place")
    urls = event_urls.select(F.col("event_id").alias("id"), "url").join(ids, "id")
    matched = first_matches(at, gold_titles, urls, events.select(F.col("event_id").alias("id"), "place", "title")).withColumnRenamed("id", "event_id")
    mark = lambda df, key, name: df.select(key, F.lit(True).alias(name)).distinct()
    kinds = F.filter(
        F.array(F.when(F.col("primary_present"), OFFICIAL), F.when(F.col("independent_count") > 0, INDEPENDENT), F.when(F.col("copies"), COPIES)), lambda v: v.isNotNull()
    )
    of_events = events.select("event_id", F.col("domain").alias("own"), kinds.alias("kinds")).join(ownership.select("event_id", "owner"), "event_id", "left")
    rows = gold.join(mark(found, "gold_id", "candidate"), "gold_id", "left").join(matched, "gold_id", "left").join(of_events, "event_id", "left").join(mark(final, "event_id", "chosen"), "event_id", "left")
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    covered = F.filter(expected, lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False)))
    one = rows.agg(
        F.count("*").alias("n"), F.count_if("candidate").alias("c"), F.count_if("chosen").alias("f"), F.count("event_id").alias("m"),
        F.count_if(F.coalesce("owner", "own") == F.col("domain")).alias("d"), F.sum(F.size(expected)).alias("e"), F.sum(F.size(covered)).alias("k"),
    )
    cluster_of = urls.groupBy(_bare("url").alias("url")).agg(F.max_by("id", F.struct("place", "id")).alias("found"))
    labelled = gold_articles.select(_bare("url").alias("url"), "cluster").join(cluster_of, "url")
    return one.crossJoin(pairwise(labelled, "found", "cluster")).select(  # one row each
        ratio(F.col("c"), F.col("n")).alias("candidate_recall"), ratio(F.col("f"), F.col("n")).alias("final_recall"), F.col("precision").alias("clustering_precision"),
        F.col("recall").alias("clustering_recall"), ratio(F.col("d"), F.col("m")).alias("domain_accuracy"), ratio(F.col("k"), F.col("e")).alias("source_coverage"),
    )
