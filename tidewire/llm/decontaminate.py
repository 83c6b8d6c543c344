"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows (runs of `window` words; the whole item if it is shorter) are sets of word shingles, ordered by
how rare they are among the windows. Containment requires all of a window's shingles, so its rarest one alone is its prefix:
neighbouring windows tend to share it, and prefixes are about a fifth of all shingles. A scan of the documents looks for
prefixes only and sends each one found with the words around it, as far as a window can reach. Those join the windows of
that prefix; its position and the window's length bound where a match can lie, and each is confirmed word by word over a
slice as long as the window.

Prefixes are broadcast in blocks of a fixed number, one scan of the documents for each block, so that what a scan broadcasts
has a bound at any size of benchmark. Joins on prefixes and windows are salted by document: a passage that a third of all
documents hold is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_bytes, as_documents, text_key, written

#: Digits, a-z and bytes over 127 stay, A-Z become a-z, the rest separates words.
WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_SALTS = 16
FOUND = "array<struct<token:string,at:int,before:int,words:string>>"
_FOUND_TYPE = pa.list_(pa.struct([("token", pa.string()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _members(items: DataFrame, window: int) -> DataFrame:
    """(window, item): the windows of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[i : i + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(ids, pa.string())], ["window", "item"])

    return items.mapInArrow(cut, "window string, item string").distinct()


def _prefixes(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, window, size, and the window's rarest shingle: token and its offset `at`."""
    k = F.least("size", F.lit(shingle))
    words = F.split("window", " ")
    tokens = F.transform(F.sequence(F.lit(0), F.col("size") - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))
    grams = windows.select("wid", "window", "size", F.posexplode(tokens).alias("at", "token"))
    counts = grams.groupBy("token").agg(F.count("*").alias("n"))
    order = F.struct("n", F.xxhash64("token").alias("h"), "token", "at")
    rarest = grams.join(counts, "token").groupBy("wid").agg(F.min(order).alias("r"), F.first("window").alias("window"), F.first("size").alias("size"))
    return rarest.select("wid", "window", "size", "r.token", "r.at")


def _scan(docs: DataFrame, tokens: frozenset[tuple[bytes, ...]], window: int) -> DataFrame:
    """Each document's word count, and where these prefixes stand in it, with the words that their windows can cover."""
    known = docs.sparkSession.sparkContext.broadcast(tokens)
    sizes = sorted({len(t) for t in tokens})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in batches:
            counts, found = [], []
            for text in as_bytes(batch.column(2)):
                words = words_of(text)
                own = []
                for k in sizes:
                    for i, gram in enumerate(zip(*(words[j:] for j in range(k)))):
                        if gram in wanted:
                            first = max(0, i - window + k)
                            around = b" ".join(words[first : i + window]).decode(errors="replace")
                            own.append({"token": b" ".join(gram).decode(errors="replace"), "at": i, "before": i - first, "words": around})
                counts.append(len(words))
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, _FOUND_TYPE)], ["doc_id", "text_key", "n_words", "found"]
            )

    return docs.mapInArrow(scan, f"doc_id long, text_key long, n_words long, found {FOUND}")


def _dealt(small: DataFrame) -> DataFrame:
    """A copy of each row for each salt."""
    return small.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))


def _with_totals(hits: DataFrame) -> DataFrame:
    """hits (doc_id, text_key, spans: any order, overlapping) with merged spans and the number of words in them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, merged = [], []
            for spans in batch.column(2).to_pylist():
                own: list[dict] = []
                for s, e in sorted((x["s"], x["e"]) for x in spans):
                    if own and s <= own[-1]["e"]:
                        own[-1]["e"] = max(own[-1]["e"], e)
                    else:
                        own.append({"s": s, "e": e})
                merged.append(own)
                totals.append(sum(x["e"] - x["s"] for x in own))
            spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(merged, spans_type)], ["hit_id", "hit_key", "n_hit", "spans"]
            )

    return hits.mapInArrow(merge, "hit_id long, hit_key long, n_hit long, spans array<struct<s:int,e:int>>")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 5,
    one_in: int = 20,
    block: int = 200_000,
    keyed: bool = False,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted as strings), spans (word start, end) and contaminated.

    keyed: text_key too, which tells rows of one id apart.

    Words are runs of digits, letters a-z after lower-casing A-Z, and all characters beyond ASCII. A word is hit if any
    occurrence of a window covers it; a document is contaminated if it has a hit and one_in * n_hit >= n_words.

    Null or empty texts have no words and no hits; items without words have no windows; a null item id counts for hits
    but is not listed. Rows that repeat a doc_id are judged by their own texts, equal rows alike; a null doc_id is kept.
    An empty docs gives no rows, an empty items no hits. Texts are read whole. Other columns are ignored.

    block: prefixes that one scan of docs broadcasts, at most; more take more scans.
    """
    docs = as_documents(docs, id_col, text_col).select("doc_id", text_key().alias("text_key"), "text")
    items = items.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    members = written(_members(items, window), "window-items")
    windows = members.select("window").distinct().select(F.monotonically_increasing_id().alias("wid"), "window", F.size(F.split("window", " ")).alias("size"))
    windows = written(windows, "windows")  # numbers must not change from scan to scan
    prefixes = written(_prefixes(windows, shingle), "prefixes")
    tokens = written(prefixes.select("token").distinct(), "tokens")

    # Tokens are dealt by hash; parts double until the largest fits.
    parts = max(1, -(-tokens.count() // block))
    part = lambda: F.pmod(F.xxhash64("token"), F.lit(parts))
    while parts > 1 and tokens.groupBy(part().alias("p")).count().agg(F.max("count")).first()[0] > block:
        parts *= 2
    scans = []
    for i in range(parts):
        own = frozenset(tuple(r.token.encode().split(b" ")) for r in tokens.where(part() == i).toLocalIterator())
        scans.append(written(_scan(docs, own, window), "scan"))

    found = scans[0]
    for scan in scans[1:]:
        found = found.unionByName(scan)
    found = found.where(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*").distinct()
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(_SALTS)).cast("int")
    first = F.col("before") - F.col("offset")  # of the window, among the words around
    around = F.split("words", " ")
    hits = (
        found.withColumn("salt", salt)
        .join(_dealt(prefixes.withColumnRenamed("at", "offset")), ["token", "salt"])
        .where((first >= 0) & (first + F.col("size") <= F.size(around)))
        .where(F.array_join(F.slice(around, F.greatest(first + 1, F.lit(1)), F.col("size")), " ") == F.col("window"))
        .select("doc_id", "text_key", (F.col("at") - F.col("offset")).cast("int").alias("s"), (F.col("at") - F.col("offset") + F.col("size")).cast("int").alias("e"), "wid")
    )
    hits = written(hits, "hits")
    spans = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    named = hits.select("doc_id", "text_key", "wid").distinct().withColumn("salt", salt)
    of = windows.join(members.where("item is not null"), "window").select("wid", "item")
    named = named.join(_dealt(of), ["wid", "salt"]).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select(F.col("doc_id").alias("item_doc"), F.col("text_key").alias("item_key"), "items")
    base = scans[0].select("doc_id", "text_key", "n_words")
    return (
        base.join(_with_totals(spans), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
        .join(named, F.col("doc_id").eqNullSafe(F.col("item_doc")) & (F.col("text_key") == F.col("item_key")), "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .select(
            "doc_id",
            *(["text_key"] if keyed else []),
            "n_words",
            "n_hit",
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
            ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )
