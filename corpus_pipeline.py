"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it again for the next. All but the last return the columns of documents.

Quality and contamination are judged by row: rows that share a doc_id, or have none, stay or go by their own texts. As
near-duplicates, rows that repeat a doc_id are one document, and each row without one is a document of its own, after all
that have one. Null texts are judged as empty and stay null up to packing. Without labels or benchmark items nothing is dropped by them. Empty
documents give no rows. Other columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, near_dedup, pack, pii, quality
from tidewire.llm.common import text_key, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose ids and texts are in kept (doc_id, text_key)."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key")), "left_semi").select(*COLUMNS)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scores = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keyed=True)
    return _only(docs, scores.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id; five-word shingles at 0.8.

    Rows without an id are numbered from the largest id on; ids that leave no room for that make the run fail.
    """
    rows = docs.select(*COLUMNS, F.col("doc_id").alias("_row"))
    nameless = docs.where("doc_id is null")
    if not nameless.isEmpty():
        top = docs.agg(F.max("doc_id")).first()[0] or 0
        number = F.lit(top).cast("long") + F.lit(1).cast("long") + F.monotonically_increasing_id()
        nameless = written(nameless.select(*COLUMNS, number.alias("_row")), "nameless")  # numbers must not change from scan to scan
        rows = rows.where("doc_id is not null").unionByName(nameless)
    kept = near_dedup.near_duplicates(rows, id_col="_row").where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark passage covers a twentieth."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keyed=True)
    return _only(docs, found.where("not contaminated"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", judge_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer decide the rows: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
