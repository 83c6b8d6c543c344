"""The corpus operators' queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import decontaminate, hard_negatives, lexical_search, near_dedup, pack, pii, quality, secret_scan, substring_dedup, token_counts, url_filter, vector_search, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack.pack(_table(spark, folder, "documents"), _path("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), shingle=3, percent=85)


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_table(spark, folder, "documents"))
    base = ("email", "ip", "card", "phone")
    counts = [pii.count("spans", kind).alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(pii.digest("spans", base).cast("binary"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    back = pages.schema["page_id"].dataType
    index = warc.capture_history(pages)
    return index.select(
        F.nullif("page_id", F.lit("")).cast(back).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(back).alias("refers_to")
    )


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_k(_table(spark, folder, "embeddings"), every=100, by_row=True)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.repeated_substrings(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, folder, "documents"), _path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = secret_scan.find_secrets(_table(spark, folder, "documents"), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counts = [pii.count("spans", kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    base = F.sha2(pii.digest("spans", secret_scan.BASE).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.digest("spans").alias("spans"))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, folder, "embeddings").select("vec_id", "embedding", label.alias("label")))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(13, len(w)) AS size FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS g
        FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM iw)),
sizes AS (SELECT DISTINCT size FROM win),
starts AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
grams AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS g FROM starts),
hits AS (SELECT doc_id, s, size, item_id FROM grams JOIN win USING (size, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM s l JOIN s r ON l.g = r.g AND l.doc_id < r.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS doc_id, a AS root FROM ends UNION SELECT ends.b, root FROM reach JOIN ends ON reach.doc_id = ends.a),
m AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Upper-case base32 of the 40 hex digits in x.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 10 * (i // 8) + 1, 10)
  AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '')"""

OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

OP7_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM ok),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM dims q JOIN dims c ON q.d = c.d
           WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 49, 0))) AS s FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, s FROM w JOIN f USING (g) WHERE m < doc_id),
o AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM o),
j AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, k),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM j),
t AS (SELECT p.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
      FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

OP12_SQL = rf"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT row, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) GROUP BY 1, 2),
tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2, 3, 4),
df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t),
impact AS (SELECT row, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))) AS x FROM tf JOIN df USING (t), total),
scored AS (SELECT item_id, row, doc_id, CAST(sum(x * times) AS BIGINT) AS score FROM impact JOIN asked USING (t) GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

OP13_SQL = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, min({'label': label, 'v': v}) AS r FROM ok GROUP BY 1),
dims AS (SELECT vec_id, r.label AS label, unnest(r.v) AS x, unnest(range(len(r.v))) AS d FROM one),
scored AS (SELECT a.vec_id AS anchor, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score FROM dims a JOIN dims c ON a.d = c.d
           WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id GROUP BY 1, 2, 3),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
negative AS (SELECT p.anchor, p.vec_id AS positive, p.score AS positive_score, n.vec_id, n.score, row_number() OVER (PARTITION BY p.anchor, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
             FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM negative WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_decontaminate, op2_pack, op3_url_filter, op4_near_dedup, op5_pii, op6_warc, op7_top_k, op8_quality, op9_substring_dedup, op10_token_counts,
        op11_secrets, op12_search, op13_hard_negatives,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_decontaminate": OP1_SQL, "op4_near_dedup": OP4_SQL, "op6_warc": OP6_SQL, "op7_top_k": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op12_search": OP12_SQL, "op13_hard_negatives": OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
