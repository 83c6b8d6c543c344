"""Each operator on null ids, null and empty texts, ties, repeated rows, and extra columns with the names it uses itself."""

import public_tokenizers
import pytest
from tidewire.llm import decontaminate, near_dedup, pack, pii, quality, queries, token_counts, url_filter, vector_search, warc

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ROWS = [(1, TEXT), (1, TEXT), (None, TEXT), (None, None), (2, None), (3, ""), (4, TEXT), (5, "mail a@b.cd now")]
#: Names that the operators give to columns of their own.
CLASHES = "rank int, text_key string, spans string, token string, n_words string, length string, worker string, rep string, bucket string, stats string, score string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = (7,) + ("x",) * (len(CLASHES.split(",")) - 1)
    return spark.createDataFrame([r + extra for r in ROWS], f"doc_id long, text string, {CLASHES}").repartition(2)


def ids(rows):
    return sorted((r[0] for r in rows), key=str)


WANT = ids(ROWS)


def test_contamination(spark, docs):
    items = spark.createDataFrame([(9, TEXT), (None, TEXT), (8, None)], "item_id long, text string")
    rows = decontaminate.contamination(docs, items).select("doc_id", "contaminated", "items").collect()
    assert ids(rows) == WANT
    assert sorted(str(r.doc_id) for r in rows if r.contaminated) == ["1", "1", "4", "None"]
    assert all(r["items"] == ["9"] for r in rows if r.contaminated)


def test_packing(docs):
    rows = pack.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "length", "sequence_id", "offset").collect()
    assert ids(rows) == WANT and sum(r.length == 1 for r in rows) == 3
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_near_duplicates(docs):
    rows = near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()
    assert ids(rows) == WANT
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in rows))) == sorted(
        map(str, [(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False), (5, 5, True), (None, None, True), (None, None, True)])
    )


def test_pii(docs):
    rows = pii.find_pii(docs).collect()
    assert ids(rows) == WANT and [(r.doc_id, r.text) for r in rows if r.spans] == [(5, "mail [EMAIL] now")]
    again = pii.redact(docs)
    assert again.columns == docs.columns and again.where("text is null").count() == 2


def test_quality_with_one_class_or_repeated_and_null_labels(spark, docs):
    for labels in ([], [(1, 1), (1, 1), (None, 0), (4, None), (5, 7)]):
        rows = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert ids(rows) == WANT and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)


def test_token_counts(docs):
    rows = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens").collect()
    assert ids(rows) == WANT and sum(r.n_tokens == 0 for r in rows) == 3
    assert len({r.n_tokens for r in rows if r.doc_id in (1, 4)}) == 1


def test_urls(spark):
    rows = [(1, "http://A.net/"), (1, "http://A.net/"), (None, "http://b.org/fr/x"), (2, None), (3, ""), (4, "http://" + "h" * 5000 + "/" + "p" * 5000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, score string")
    rules = [("net", "/", "block"), ("org", "/fr/", "allow")]
    found = url_filter.judge_urls(pages, rules).collect()
    assert sorted((str(r.page_id), r.rule) for r in found if r.rule) == [("1", "net/"), ("1", "net/"), ("None", "org/fr/")]
    assert len(found) == 6 and all(r.verdict in ("allow", "block") for r in found)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_verdicts_do_not_follow_the_parent_domain(spark):
    clean = ["https://ththan.{}/en/7944", "http://www.ththst.{}/en/1837/", "https://news.{}/2022/07/harbour-report", "https://essay.{}/en/91"]
    junk = ["https://casino-win.{}/free-spins", "https://ads.{}/click?id=9", "https://cheap-pills.{}/buy-now", "https://shop.{}/cart"]
    urls = [(want, u.format(parent)) for want, own in (("allow", clean), ("block", junk)) for u in own for parent in ("example.com", "example.org", "example.net")]
    pages = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(urls)], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge_urls(pages, []).collect()}
    assert [(u, round(found[i].score, 2)) for i, (want, u) in enumerate(urls) if found[i].verdict != want] == []


def test_captures(spark):
    rows = [(1, "http://a.b/", "x"), (1, "http://a.b/", "x"), (None, None, "x"), (2, "", None), (3, "http://a.b/", "")]
    found = warc.capture_history(spark.createDataFrame([(*r, "k", "d") for r in rows], "page_id long, url string, html string, url_key string, payload_digest string")).collect()
    assert len(found) == 5
    kinds = {(r.page_id, r.record_type) for r in found}
    assert ("2", "response") in kinds and ("3", "revisit") in kinds


def test_top_k_with_ties_and_repeated_rows(spark):
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.5]), (None, [9.0, 9.0]), (4, None), (5, [float("inf"), 0.0])]
    found = vector_search.top_k(spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, rank int"), every=100).collect()
    best = [(r.rank, r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0 and r.vec_id is not None]
    assert [v for _, v, _ in best] == [1, 2, 3]
    assert [s for *_, s in best] == [3 * 1024 * 1024, 3 * 1024 * 1024, 1024 * 1024]


def test_top_k_lists_k_distinct_ids_of_repeated_rows(spark):
    import random

    random.seed(4)
    rows = [(i % 60, [float(random.randint(-9, 9)) for _ in range(24)]) for i in range(120)]
    for own, blocks in ((rows[:60] * 2, {}), (rows, {}), (rows * 3, {"candidate_block": 40, "query_block": 2})):
        scores = {}
        for q, x in own:
            for c, y in own:
                if q % 20 == 0 and c != q:
                    scores[q, c] = max(scores.get((q, c), -(10**9)), int(sum(a * b for a, b in zip(x, y))) * 1024**2)
        want = {(q, n, c, -s) for q in (0, 20, 40) for n, (s, c) in enumerate(sorted((-s, c) for (p, c), s in scores.items() if p == q)[:10], 1)}
        df = spark.createDataFrame(own, "vec_id long, embedding array<float>")
        found = vector_search.top_k(df, every=20, step=8, **blocks).collect()
        assert len(found) == 30 and {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == want


def test_op7_counts_every_row(spark, tmp_path):
    import random

    random.seed(5)
    rows = [(i, [float(random.randint(-9, 9)) for _ in range(20)]) for i in range(90)] + [(90, None), (91, [1.0, None]), (92, [float("inf")])]
    rows += [(i, list(v)) for i, v in rows[1:60]] + [(i, [float(random.randint(-9, 9)) for _ in range(20)]) for i in (7, 7, 100)] + [(None, list(rows[3][1])), (None, [9.0] * 20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ok, want = [r for r in rows if r[1] is not None and all(x is not None and abs(x) < float("inf") for x in r[1])], []
    for n, (q, x) in enumerate(ok):
        if q is not None and q % 100 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(x, y))) * 1024**2, c is None, c or 0) for m, (c, y) in enumerate(ok) if m != n)[:10]
            want += [(q, i, None if none else c, -s) for i, (s, none, c) in enumerate(scores, 1)]
    found = queries.op7_top_k(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((r.query_id, r.rank, r.vec_id, r.score) for r in found))) == sorted(map(str, want))
