"""Hard negatives against a plain loop: clusters, ties, rare labels, small blocks, several lengths and edges."""

import math
import random

import numpy as np
import pytest
from tidewire.llm import hard_negatives, queries

DATA = "/root/testdata/sf0.001"


def plain(rows, every=100, scale=256, p=5, n=5):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        best[i] = min(best.get(i, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted(i for i in best if i % every == 0):
        label, v = best[a]
        scored = sorted((-dot(v, w), i, lab) for i, (lab, w) in best.items() if i != a)
        for ps, pos, _ in [s for s in scored if s[2] == label][:p]:
            near = [(i, s) for s, i, lab in scored if lab != label and 80 * -ps <= 100 * -s <= 100 * -ps][:n]
            out += [(a, pos, r + 1, i, -ps, -s) for r, (i, s) in enumerate(near)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_query_on_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, None if lab is None else (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    got = queries.op13_hard_negatives(spark, DATA)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(got.dtypes)["rank"] == "int"
    assert found(got) == plain(moved)


@pytest.mark.parametrize(("seed", "spread", "options"), [(1, 0.1, {}), (2, 1.0, {"block": 3, "pivots": 3, "sample": 10}), (3, 0.0, {"pivots": 1}), (4, 0.4, {"pivots": 64, "sample": 400})])
def test_against_a_plain_loop(spark, seed, spread, options):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)) if i % 50 else 9, (centres[i % 6] + spread * rng.normal(size=8)).astype("float32").tolist()) for i in range(300)]
    assert found(hard_negatives.hard_negatives(table(spark, rows), every=10, **options)) == plain(rows, every=10)


def test_edges(spark):
    random.seed(6)
    same = [0.5, 0.5, -0.25]
    rows = [(i, i % 2, same) for i in range(60)]  # one vector, ties everywhere
    rows += [(100, 0, [0.0, 0.0, 0.0]), (200, 1, [0.1]), (300, 1, []), (400, None, same), (500, 1, None), (600, 1, [None, 1.0]), (700, 1, [float("nan")]), (None, 1, same)]
    rows += [(800, 1, same), (800, 1, same), (800, 0, [0.9, 0.1, 0.2]), (-100, 3, [9.0, -9.0, 3.0]), (900, 8, [-0.5, -0.5, 0.25])]
    df = table(spark, rows)
    extra = df.selectExpr("*", "1 as rank", "'x' as pivot", "2 as v", "3 as score").repartition(3)
    assert found(hard_negatives.hard_negatives(extra, every=100)) == plain(rows)
    assert found(hard_negatives.hard_negatives(extra, every=20, positives=2, negatives=3, pivots=2)) == plain(rows, every=20, p=2, n=3)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
