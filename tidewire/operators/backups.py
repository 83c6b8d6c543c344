"""Backups: when stories fall out of a slate, which of the preselected events take their places."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import pattern
from tidewire.operators.selection import slate_errors
from tidewire.operators.tables import durable

# Topics that readers of a domain follow, and what is of little value.
TOPIC_PRIORITY = {
    "ai-tech": r"AI基础设施|人工智能基础设施|芯片|半导体|服务器|HBM|高带宽内存|先进封装|AI\s*Coding|编程智能体|Agent|算力",
    "markets": r"公司基本面|财报|营收|利润|通胀|CPI|PPI|PCE|利率|债券收益率|油价|投资|融资",
    "world": r"能源|航运|海峡|粮食|地缘|冲突|停火|制裁|科技安全|出口管制|供应链",
    "learning": r"\bIB\b|International Baccalaureate|\bOECD\b|\bPISA\b|\bUNESCO\b|AI Literacy|人工智能素养|AI素养|学习科学|Assessment|评估|课程改革|教育政策",
}
LOW_VALUE_TOPIC = r"celebrity|viral|shocking|奇闻|网红|明星八卦|普通校园活动|校友聚会|校长任命|school board meeting|campus event"


def backup_priority(domain: Column, text: Column, score: Column, fit: Column, reliability: Column) -> Column:
    """How well an event fills a gap: score and fit, topics that readers follow, and the standing of its source."""
    topics = F.coalesce(*(F.when(domain == d, F.size(F.regexp_extract_all(text, F.lit(pattern(p)), F.lit(0)))) for d, p in TOPIC_PRIORITY.items()), F.lit(0))
    standing = F.when(reliability == "primary", 5).when(reliability == "tier-1", 3).otherwise(0)
    official = F.when((domain == "learning") & (reliability == "primary"), 5).otherwise(0)
    return score + fit * 0.25 + F.least(topics, F.lit(4)) * 4 + standing + official - F.when(text.rlike(pattern(LOW_VALUE_TOPIC)), 18).otherwise(0)


def stabilized(options: DataFrame, size: int = 5, most: int = 10) -> DataFrame:
    """(domain, id, position, errors): the slate of each domain that breaks the fewest rules.

    options: domain, id, original (position in the present slate, null for backups), priority, source_id, lead, level and
    reliability; valid events only, of which the `most` best of each domain are read: kept ones by position, then backups by
    priority. Among slates that break as few rules, the one with more kept stories, then with more priority, then the one
    whose ids come first. Restricted stories come last within a slate. Fewer than `size` options give no slate.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.fillna({"original": float("inf")}).sort_values(["original", "priority", "id"], ascending=[True, False, True]).head(most).itertuples(index=False))
        best, got = None, []
        for some in combinations(rows, size):
            order = sorted(some, key=lambda r: r.level == "unverified" or r.reliability == "other")  # stable: the rest in order
            kept = sum(r.original != float("inf") for r in some)
            key = (len(slate_errors(order)), -kept, -sum(r.priority for r in some), [r.id for r in order])
            if best is None or key < best:
                best, got = key, order
        return pd.DataFrame(
            {"domain": [r.domain for r in got], "id": [r.id for r in got], "position": range(1, len(got) + 1), "errors": ",".join(slate_errors(got)) if got else ""}
        )

    columns = options.select("domain", "id", F.col("original").cast("double"), F.col("priority").cast("double"), "source_id", "lead", "level", "reliability")
    return columns.groupBy("domain").applyInPandas(choose, "domain string, id string, position long, errors string")


def replacements(before: DataFrame, after: DataFrame, forced: DataFrame) -> DataFrame:
    """(domain, removed, added, reason): what left a slate (domain, id, position) against what came, in order.

    forced (domain, id): events that had to leave as another domain has them. Where less came than left, the last one stands in.
    """
    out = before.join(after.select("domain", "id"), ["domain", "id"], "left_anti").join(forced.select("domain", "id", F.lit(True).alias("forced")), ["domain", "id"], "left")
    gone = out.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("position", F.col("id"), F.coalesce("forced", F.lit(False)).alias("forced")))).alias("gone"))
    came = after.join(before.select("domain", "id"), ["domain", "id"], "left_anti").groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("came"))
    rows = gone.join(came, "domain").select("domain", F.posexplode("gone").alias("i", "g"), "came")
    added = F.element_at("came", F.least(F.col("i") + 1, F.size("came")))
    return rows.select("domain", F.col("g.id").alias("removed"), added["id"].alias("added"), F.when(F.col("g.forced"), "cross-domain-duplicate").otherwise("content-gate").alias("reason"))


def without_shared(options: DataFrame, conflicts: DataFrame, rounds: int = 4) -> DataFrame:
    """stabilized() slates in which no two domains hold events of one conflict (a, b: ids, b to leave), or the last state reached.

    Each round drops the events that must leave from the options and chooses again: one pass for each domain at most.
    """
    slate = durable(stabilized(options))
    for _ in range(rounds):
        ids = slate.select("id")
        gone = conflicts.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("b").alias("id")).distinct()
        if gone.isEmpty():
            break
        options = durable(options.join(gone, "id", "left_anti"))
        slate = durable(stabilized(options))
    return slate
