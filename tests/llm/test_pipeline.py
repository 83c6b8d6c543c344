"""The pipeline and its stages against brute force, on small tables with nulls, copies, repeated rows and empty tables."""

import random

import numpy as np
import pytest

import brute
import corpus_pipeline
import public_tokenizers
from tidewire.llm import quality

random.seed(11)
VOCABULARY = [a + b + c for a in ("ba", "de", "fi", "go") for b in ("la", "mo", "ne") for c in ("s", "t", "rk", "m")]
say = lambda n: " ".join(random.choices(VOCABULARY, k=n))
PASSAGE = say(16)
GOOD = [say(random.randint(60, 120)) + "." for _ in range(60)]
BAD = ["buy " * random.randint(40, 90) if i % 2 else "### %% @@ " * random.randint(15, 40) for i in range(60)]
EXTRA = [
    (300, GOOD[0], "en", "a"), (301, GOOD[1] + " tail", "en", None), (302, say(30) + " " + PASSAGE + " " + say(30), None, "b"),
    (303, say(40) + " write to ann.b@host.example.org or call +1 (555) 010-9999 soon " + say(40), "de", "b"), (304, None, None, None), (305, "", "en", "a"),
    (None, say(70), "en", "a"), (306, GOOD[0], "en", "a"), (306, GOOD[0], "en", "a"), (307, say(9000), "en", "a"),
]
ROWS = [(i, t, "en", "hot") for i, t in enumerate(GOOD)] + [(100 + i, t, "en", "hot") for i, t in enumerate(BAD)] + EXTRA
LABELS = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (5, None, None)]
ITEMS = [(1, PASSAGE), (None, None), (3, "")]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels=LABELS, items=ITEMS):
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("tables"), ROWS)


def plain_scores(rows, labels, shrink=0.1, ridge=0.05):
    """Scores from the textbook densities, with inverses and determinants of whole covariances."""
    stats = [np.array(quality.statistics((t or "").encode())) for _, t in rows]
    quality_of = [(d, q) for d, q, _ in labels if q in (0, 1) and d is not None]
    x = {c: np.array([s for (d, _), s in zip(rows, stats) for e, q in quality_of if d == e and q == c and not brute.crc_held_out(d)]) for c in (0, 1)}
    n = {c: len(x[c]) for c in (0, 1)}
    cov = {c: np.cov(x[c].T, bias=True) for c in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    floor = ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
    logs = []
    for c in (0, 1):
        full = (1 - shrink) * cov[c] + shrink * pooled + floor
        away = np.array(stats) - x[c].mean(axis=0)
        logs.append(np.log(n[c] / sum(n.values())) - 0.5 * np.linalg.slogdet(full)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(full), away))
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def redacted(text):
    for kind, start, end in sorted(brute.base_spans(text), key=lambda s: -s[1]):
        text = text[:start] + f"[{kind.upper()}]" + text[end:]
    return text


def plain_stages(rows):
    """What each filtering stage keeps, as (doc_id, text)."""
    kept = [(d, t) for (d, t), s in zip(rows, plain_scores(rows, LABELS)) if s >= 0.3]
    yield kept
    named = [(d, t) for d, t in kept if d is not None]
    stays = {d for d, _, _, k in brute.near_duplicates(sorted(set(named), key=str), 5, 80) if k}
    kept = [(d, t) for d, t in kept if d is None or d in stays]
    yield kept
    bad = {d for d, *_, hit in brute.contamination(kept, ITEMS) if hit}
    kept = [(d, t) for d, t in kept if d not in bad]
    yield kept
    yield [(d, None if t is None else redacted(t)) for d, t in kept]


def test_scores_match_the_densities(spark):
    rows = [(d, t) for d, t, *_ in ROWS]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, label string, stats int")
    got = quality.quality_scores(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    order = lambda pairs: sorted(pairs, key=str)
    want = order((d, round(float(s), 5)) for (d, _), s in zip(rows, plain_scores(rows, LABELS)))
    assert order((r.doc_id, round(r.score, 5)) for r in got) == want


def test_stages_and_run_match_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for (_, stage), kept in zip(corpus_pipeline.STAGES, plain_stages([(d, t) for d, t, *_ in ROWS])):
        docs = corpus_pipeline.written(stage(spark, docs, folder), "tested")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(kept, key=str)
    names = {d for d, _ in kept}
    assert {0, 1, 303, 307, None} <= names and not names & {300, 301, 302, 306, 100, 101}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    pieces = [tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, folder).collect()]
    brute.check_packing(pieces, kept, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2])


def test_stages_on_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_without_labels_or_items_nothing_is_dropped(spark, tmp_path):
    rows = [(1, "one text", None, None), (2, None, None, None), (None, "three", None, None)]
    folder = write(spark, tmp_path, rows, [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (corpus_pipeline.judge_quality, corpus_pipeline.drop_contaminated):
        assert stage(spark, docs, folder).count() == 3


def test_rows_without_an_id_or_with_a_shared_one_are_judged_by_themselves(spark, tmp_path):
    bad, dirty, clean = "### %% @@ " * 30, f"{say(30)} {PASSAGE} {say(30)}", [say(80) + "." for _ in range(3)]
    rows = [*((i, t) for i, t, *_ in ROWS[:120]), (None, clean[0]), (None, clean[0]), (None, bad), (None, dirty), (None, GOOD[0]), (400, clean[1]), (400, bad), (401, clean[2]), (401, dirty)]
    folder = write(spark, tmp_path, [(i, t, "en", "a") for i, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    new = lambda df: sorted(((r.doc_id, r.text) for r in df.collect() if r.doc_id is None or r.doc_id >= 400), key=str)
    order = lambda pairs: sorted(pairs, key=str)
    own = rows[120:]
    assert new(corpus_pipeline.judge_quality(spark, docs, folder)) == order(r for r in own if r[1] != bad)
    assert new(corpus_pipeline.drop_contaminated(spark, docs, folder)) == order(r for r in own if r[1] != dirty)
    left = new(corpus_pipeline.drop_near_duplicates(spark, docs, folder))
    # The others copy documents with an id: 0, one of BAD, and 401.
    assert [t for i, t in left if i is None] == [clean[0]]
