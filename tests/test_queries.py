"""Queries against their SQL on the small tables, and the folds against plain loops."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire import plans
from tidewire.operators import events

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_folds_match_a_plain_loop(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "e"), ("b", "e"), ("a", "e")]
    ids = "abcdef"
    df = spark.createDataFrame([(c, i + 1) for i, c in enumerate(ids)], "id string, rank int")
    edges = spark.createDataFrame(pairs, "a string, b string")
    for complete in (False, True):
        groups = []
        for c in ids:
            fits = [g for g in groups if (all((x, c) in pairs for x in g) if complete else (g[0], c) in pairs)]
            if fits:
                fits[0].append(c)
            else:
                groups.append([c])
        got = {r.id: r.leader for r in events._folded(df, edges, complete).collect()}
        assert got == {c: g[0] for g in groups for c in g}


def test_folds_in_small_blocks_match_a_plain_loop(spark):
    import random

    draw = random.Random(5)
    ids = [f"n{i:02d}" for i in range(16)]
    for dense, block, links in ((0.8, 2, (True, False)), (0.5, 3, (True,))):
        pairs = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if draw.random() < dense}
        ranks = sorted(draw.sample(range(1, 30), len(ids)))  # unique, with gaps
        df = spark.createDataFrame(list(zip(ids, ranks, strict=True)), "id string, rank int")
        edges = spark.createDataFrame(sorted(pairs), "a string, b string")
        for complete in links:
            groups = []
            for c in ids:
                own = next((g for g in groups if (all((x, c) in pairs for x in g) if complete else (g[0], c) in pairs)), None)
                groups.append([c]) if own is None else own.append(c)
            got = {r.id: r.leader for r in events._folded(df, edges, complete, block).collect()}
            assert got == {c: g[0] for g in groups for c in g}


def test_a_chain_longer_than_any_fixed_number_of_rounds(spark):
    from tidewire.operators.leaders import greedy_leaders

    rows = [(f"{i:03d}", i, f"{i + d}") for i in range(12) for d in (0, 1)]  # each row shares a group with the next
    got = {r.id: r.leader for r in greedy_leaders(spark.createDataFrame(rows, "id string, rank int, key string")).collect()}
    assert got == {f"{i:03d}": f"{i - i % 2:03d}" for i in range(12)}


def test_events_have_reports_and_grades(spark):
    found = plans.QUERIES["events"](spark, DATA)
    assert found.count() > 0
    assert found.where(F.col("reports") < 1).isEmpty()
    assert found.where(F.col("level").isNull()).isEmpty()
