"""The corpus operators against brute force on a small table with nulls, empty and long texts, ties, copies and extra columns."""

import hashlib
import random

import numpy as np
import pytest

import brute
import public_tokenizers
from tidewire.llm import decontaminate, near_dedup, pack, pii, quality, substring_dedup, token_counts, url_filter, vector_search, warc

random.seed(3)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "Mi", "né", "tu") for b in ("ra", "ß", "so", "ti", "x1")]
say = lambda n: " ".join(random.choices(WORDS, k=n))
BASE = [say(random.randint(20, 80)) for _ in range(12)]
PASSAGE = say(15)
TEXTS = [
    None, "", " ", "one", "two words", *BASE, BASE[0], BASE[0], BASE[1] + " tail", BASE[2].replace(WORDS[0], "changed", 1), say(10) + " " + PASSAGE + " " + say(5),
    PASSAGE.upper(), "mail ann.b@host.example.org, card 4539 1488 0343 6467, ip 10.20.30.40.5.6.7.8 and +1 (555) 010-9999 password=ab12cd34ef", "a@b@c.d 1.2.3 999.1.1.1",
    "\n\n  spaced   out ▁ text \t", say(4000), "İstanbul <|endoftext|> 中文 é é", "x" * 500,
]
DOCS = list(enumerate(TEXTS))
ITEMS = [(1, PASSAGE), (2, "two words"), (3, None), (4, ""), (None, BASE[3]), (5, BASE[3])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, t, d) for d, t in DOCS], "doc_id long, text string, words string, rank int").repartition(3)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_contamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (200_000, 10):
        found = decontaminate.contamination(docs, items, block=block).collect()
        rows = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found)
        assert rows == sorted(brute.contamination(DOCS, ITEMS))


def test_near_duplicates(docs):
    for block in (512, 2):
        found = near_dedup.near_duplicates(docs, shingle=3, percent=85, block=block)
        assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(DOCS))


def test_groups_of_near_copies(spark):
    base = [say(1) for _ in range(120)]
    copies = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 6):
            words[random.randrange(120)] = f"new{random.randrange(1000)}"
        copies.append((i, " ".join(words)))
    found = near_dedup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), shingle=3, percent=85, block=8)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(copies))


def test_buckets_of_unlike_members(spark):
    # A template that all share, too little for a link; every fifth text is an edited copy of the one before.
    template, rows = [say(1) + str(i) for i in range(90)], []
    for i in range(60):
        words = rows[-1][1].split() if i % 5 == 4 else template + [f"own{i}x{j}" for j in range(14)]
        rows.append((i, " ".join(words[:-2] + ["tail", f"edit{i}"] if i % 5 == 4 else words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.near_duplicates(rows))
    assert len({r[2] for r in want}) == 48
    for block in (512, 3):
        found = near_dedup.near_duplicates(df, shingle=3, percent=85, block=block)
        assert got(found, "doc_id", "n_shingles", "component_id", "kept") == want
    full = near_dedup._full_sets(df, df.select("doc_id"), 3)
    live = df.select(df.doc_id.alias("rep"), df.doc_id.alias("component"))
    pairs = set(got(near_dedup._rare_shingle_pairs(live, full, 85), "a", "b"))
    assert {(i - 1, i) for i in range(4, 60, 5)} <= pairs and len(pairs) < 60


def test_rare_shingle_pairs_leave_nothing_out(spark):
    random.seed(8)
    sets = {i: sorted(random.sample(range(40), random.randint(1, 30))) for i in range(50)}
    sets |= {50 + i: sorted(set(sets[i]) ^ {random.randrange(40)}) or [1] for i in range(50)}
    sets |= {100 + i: sets[i] for i in range(10)}
    full = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "doc_id long, full binary")
    live = full.select(full.doc_id.alias("rep"), full.doc_id.alias("component"))
    for percent in (50, 80, 85, 100):
        near = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= percent * len(set(sets[a]) | set(sets[b]))}
        assert near and near <= set(got(near_dedup._rare_shingle_pairs(live, full, percent), "a", "b"))


def test_repeated_substrings(docs):
    rows = substring_dedup.repeated_substrings(docs).collect()
    found = sorted((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert found == sorted(brute.repeated(DOCS))


def test_repeated_substrings_with_repeated_and_null_ids(spark):
    rows = [(1, BASE[0]), (1, BASE[0] + "!"), (None, BASE[0]), (2, BASE[0])]
    found = substring_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, bool(r.spans)) for r in found) == [(1, False), (1, False), (2, True), (99, True)]


def test_pii(docs):
    for r in pii.find_pii(docs).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r.spans if s["kind"] in brute.PATTERNS]
        assert base == brute.base_spans(TEXTS[r.doc_id])
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[0] is None
    assert any("[EMAIL]" in (t or "") and "ab12cd34ef" not in t for t in redacted.values())
    assert redacted[3] == "one"


def test_token_counts(docs):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    want = sorted((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in DOCS)
    for head in (250_000, 3):
        assert got(token_counts.token_counts(docs, path, head=head), "doc_id", "n_bytes", "n_tokens") == want


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for capacity, least in ((4096, 64), (128, 16), (100, 7)):
        pieces = got(pack.pack(docs, path, capacity=capacity, least=least), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        brute.check_packing(pieces, DOCS, lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2], capacity)


def test_captures(spark):
    pages = [(5, "http://a.b/x", "same"), (3, "https://A.b/y?q#z", "same"), (9, None, None), (4, "no url", "line\r\n\r\nline"), (8, "http://c/", "")]
    index = warc.capture_history(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = sorted((int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in index)
    assert found == sorted(brute.captures([(p, h) for p, _, h in pages]))
    assert [r.url_key for r in index] == sorted(r.url_key for r in index)


def test_loser_tree():
    for k in range(9):
        runs = [sorted((random.randrange(50),) for _ in range(random.randrange(20))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 24), (302, [None] * 24)]
    rows[7] = (7, rows[6][1])
    found = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, candidate_block=40, query_block=6, step=8)
    floats = [(i, None if v is None or v[0] is None else [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(found, "query_id", "rank", "vec_id", "score") == sorted(brute.top(floats, 20))


def test_quality(spark):
    good = [(i, say(60) + ".", 1) for i in range(200)]
    bad = [(i, "w " * random.randint(30, 90) if i % 2 else "%%% ### " * random.randint(5, 40), 0) for i in range(200, 400)]
    df = spark.createDataFrame([(d, t) for d, t, _ in good + bad] + [(1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    held = [(d, q) for d, _, q in good + bad if rows[d].held_out]
    assert all(rows[d].held_out == brute.crc_held_out(d) for d in rows)
    assert np.mean([rows[d].predicted == q for d, q in held]) > 0.95
    assert 0 <= rows[1000].score <= 1


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow")]
    urls = [(1, "http://Sub.Example.net/en/x?y"), (2, "https://example.net/de"), (3, None), (4, "nothing"), (5, "ftp://othernet/en/"), (6, "http://a.net")]
    rows = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert (rows[2].rule, rows[2].verdict) == ("net/", "block")
    assert (rows[3].host, rows[3].path, rows[3].rule) == ("", "", None)
    assert rows[5].rule is None and rows[6].rule is None
    held = [("https://news.example.org/2022/07/harbour-report", 0), ("https://ads.example.com/click?id=9", 1), ("https://essay.example.org/en/91", 0), ("https://shop.example.com/cart", 1)]
    scores = {r.page_id: r.score for r in url_filter.judge_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string"), []).collect()}
    assert all((scores[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(held))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert decontaminate.contamination(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.repeated_substrings(none).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert pack.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert pii.find_pii(none).count() == 0
    assert quality.quality_scores(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert vector_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
