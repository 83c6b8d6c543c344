"""Ranked search against a plain loop, with blocks of items, small sorts, ties and edges."""

import math
import random
import re
from collections import Counter

import numpy as np
from tidewire.llm import lexical_search, queries

DATA = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = Counter(t for text in {x for i, x in items if i == item} for t in terms(text))
        scored = []
        for d, c, n in counted:
            m = 75 + 25 * n * n_docs // length
            s = sum(times * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: r[:2])


def test_query_on_its_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op12_search(spark, DATA)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert found(got) == plain(docs, items)


def test_small_blocks_and_small_sorts(spark, monkeypatch):
    random.seed(8)
    words = ["alpha", "Beta", "été", "x1", "漢字", "gamma", "delta", "I", "ß"]
    text = lambda k: " ".join(random.choices(words, weights=range(1, 10), k=k))
    docs = [(i if i % 7 else None, text(random.randint(0, 40))) for i in range(120)] + [(500, None), (501, ""), (502, ". - !"), (3, "alpha alpha"), (3, "alpha alpha")]
    items = [(i, text(random.randint(1, 9))) for i in range(12)] + [(1, "gamma gamma"), (1, "gamma gamma"), (None, "alpha"), (99, None), (98, ""), (97, "unheard")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 4)
    assert found(lexical_search.ranked_search(d, q, k=4)) == want
    monkeypatch.setattr(lexical_search, "_AT_ONCE", 7)
    assert found(lexical_search.ranked_search(d, q, k=4, block=6)) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "alpha " * 60_000, 1), (2, "alpha beta", 2)], "doc_id long, text string, score int")
    items = spark.createDataFrame([("b", "beta", 3), ("a", "Alpha alpha", 4)], "item_id string, text string, rank int")
    assert [r[:3] for r in found(lexical_search.ranked_search(docs, items))] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 2)]
    assert lexical_search.ranked_search(docs.limit(0), items).count() == 0 and lexical_search.ranked_search(docs, items.limit(0)).count() == 0


def test_radix_order_and_sums():
    rng = np.random.default_rng(3)
    for top in (1, 300, 1 << 17, 1 << 40, (1 << 63) - 1):
        keys = rng.integers(0, top, 2000).astype(np.uint64)
        assert (lexical_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
        impacts = rng.integers(0, 1 << 40, 2000)
        distinct, sums = lexical_search.accumulated(keys, impacts)
        want = {k: int(impacts[keys == k].sum()) for k in np.unique(keys)}
        assert dict(zip(distinct.tolist(), sums.tolist(), strict=True)) == {int(k): v for k, v in want.items()}
