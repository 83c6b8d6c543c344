"""Token counts from distinct pre-tokens.

The model's pieces never hold a space after another character, so a text's tokens are those of its pre-tokens, each a run
of spaces with the characters that follow. Pieces are counted once for each distinct pre-token of the corpus; documents
keep their pre-token frequencies, join the counts, and sum. Ids are never kept.

Pre-tokens follow a steep frequency law: the `head` most frequent ones, a fixed number, are broadcast and summed where
the document is read. All others join by shuffle, so that no frequent pre-token gathers its rows in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_documents, release, written

_SPACES = re.compile("▁+[^▁]*")
_HEAD_BYTES = 64


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, without the first of their spaces; the library puts one before each text it encodes."""
    if not text:
        return []
    if "▁" in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:].replace("▁", " ") for x in _SPACES.findall("▁" + text.replace(" ", "▁"))]
    return text.split(" ")


def piece_counter(path: str):
    """Counts of pieces for pre-tokens, from a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def count(tokens: list[str]) -> list[int]:
        return [len(ids) if token else 1 for token, ids in zip(tokens, model.encode(tokens, num_threads=1), strict=True)]

    return count


def token_counts(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = 250_000,
) -> DataFrame:
    """Per row of docs: doc_id, n_bytes and n_tokens, as sentencepiece encodes the whole text without begin or end ids.

    Null or empty texts have no bytes and no tokens. Repeated rows and null doc_ids are kept, one result for each row.
    An empty table gives no rows. Other columns are ignored. head bounds the pre-tokens that are broadcast, of at most 64
    bytes each; it moves work, not results.
    """
    spark = docs.sparkSession
    docs = as_documents(docs, id_col, text_col)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(pre_tokens(text or ""))
                if len(total) > 400_000:
                    yield out()
                    total.clear()
        yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model_path)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(tokens), pa.int64()), batch.column(1)], ["token", "pieces", "n"])

    distinct = docs.select("text").mapInArrow(frequencies, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = written(distinct.mapInArrow(counted, "token string, pieces long, n long"), "pre-tokens")

    # Frequencies in steps of an eighth of a power of two: a few hundred rows, from which the head's least one follows.
    step = F.floor(F.log2("n") * 8)
    short = table.where(F.octet_length("token") <= _HEAD_BYTES)
    least, taken = None, 0
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        if taken + r.n > head:
            break
        least, taken = r.step, taken + r.n
    frequent = [] if least is None else short.where(step >= least).select("token", "pieces").collect()
    known = spark.sparkContext.broadcast({r.token: r.pieces for r in frequent})

    release(spark)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        rest_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))
        row = TaskContext.get().partitionId() << 40  # numbers rows, in a table that is read twice
        for batch in batches:
            sizes, sums, rests = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                tokens = pre_tokens(text)
                own = [pieces.get(x) for x in tokens]
                sums.append(sum(x for x in own if x is not None))
                rest = Counter(t for t, x in zip(tokens, own, strict=True) if x is None)
                rests.append([{"token": t, "n": n} for t, n in rest.items()])
            rows = pa.array(range(row, row + len(sizes)), pa.int64())
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rests, rest_type)],
                ["row", "doc_id", "n_bytes", "frequent_tokens", "rest"],
            )

    per_doc = written(
        docs.mapInArrow(summed, "row long, doc_id long, n_bytes long, frequent_tokens long, rest array<struct<token:string,n:long>>"),
        "pre-token-frequencies",
    )
    rare = table if least is None else table.where((step < least) | (F.octet_length("token") > _HEAD_BYTES))
    rest = (
        per_doc.select("row", F.explode("rest").alias("r"))
        .select("row", "r.*")
        .join(rare.select("token", "pieces"), "token")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("rest_tokens"))
    )
    n_tokens = F.col("frequent_tokens") + F.coalesce("rest_tokens", F.lit(0))
    return per_doc.select("row", "doc_id", "n_bytes", "frequent_tokens").join(rest, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"))
