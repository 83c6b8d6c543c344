"""The corpus queries that SQL can express, against their SQL on the small tables."""

import duckdb
import pytest

from tidewire.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(str(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(str(r[want.columns.index(c)]) for c in order) for r in want.fetchall())


LEADING = {
    "op1": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op2": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3": ["page_id", "host", "path", "rule", "verdict"], "op4": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op6": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7": ["query_id", "rank", "vec_id", "score"], "op8": ["doc_id", "held_out", "score", "predicted"], "op9": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.split("_")[0] in LEADING and n.split("_")[0] not in ("op4", "op9")])
def test_leading_columns(spark, name):
    want = LEADING[name.split("_")[0]]
    assert queries.queries()[name](spark, DATA).columns[: len(want)] == want
