"""Ranked lexical search by sort-based accumulation.

A first scan of the documents counts what the weights need and keeps each document's frequencies of the items' terms. A
second scan turns them into impacts. It repeats each impact for every item that holds the term, packs (item, document) into
one 64-bit key, sorts the keys by radix, and sums the runs of equal keys. Documents stay where they are read, so a task's keys
are a range of their own and no impact is shuffled. Each task keeps a heap of the k best documents for each item; heaps are
dealt by ranges of (item, score) and cut again, so that one item's candidates never meet in one task before they are few.

Items go through in blocks with a bound on their terms, which bounds what a scan broadcasts. All sums are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import as_bytes, as_documents, shared_folder, written

#: Digits, a-z and bytes over 127 stay, A-Z become a-z, the rest separates terms.
TERM_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Impacts that one radix sort takes, unless a single document has more.
_AT_ONCE = 1 << 21


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit keys, by 16 bits a pass; passes over equal digits are left out."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, top.bit_length(), 16):
        digits = ((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digits, kind="stable")]
    return order


def accumulated(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its impacts."""
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(impacts[order], first)


class Heaps:
    """The k best (score, id) of each item: high scores first, then small ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(items)]
        self.floors = np.ones(items, np.int64)  # a score must reach this
        self.k = k

    def add(self, items: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """items ascending; rows index ids."""
        keep = scores >= self.floors[items]
        items, rows, scores = items[keep], rows[keep], scores[keep]
        if not len(items):
            return
        firsts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
        for a, b in zip(firsts, np.r_[firsts[1:], len(items)], strict=True):
            own, item = scores[a:b], items[a]
            here = np.arange(a, b)
            if b - a > self.k:
                here = here[own >= np.partition(own, -self.k)[-self.k]]
            heap = self.heaps[item]
            for i in here.tolist():
                own_id = ids[rows[i]]
                entry = (int(scores[i]), own_id is not None, -own_id if own_id is not None else 0)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floors[item] = max(1, heap[0][0])

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(i, -n if known else None, s) for i, heap in enumerate(self.heaps) for s, known, n in heap]


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the document), known (numbers of the block's terms in it) and tf (how often each)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            n, known, tf = [], [], []
            for text in as_bytes(batch.column(1)):
                words = terms_of(text)
                own = [(numbers[t], c) for t, c in Counter(words).items() if t in numbers]
                n.append(len(words))
                known.append([i for i, _ in own])
                tf.append([c for _, c in own])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "known", "tf"])

    return docs.mapInArrow(scan, "doc_id long, n long, known array<int>, tf array<long>").where("n > 0")


def _frequencies(postings: DataFrame, size: int) -> list[int]:
    """df of each of the block's terms: summed by task, then by Spark; one number a term comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], ["term", "df"])

    found = postings.select("known").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = [0] * size
    for r in found:
        df[r.term] = r.df
    return df


def _scored(postings: DataFrame, weights: np.ndarray, holders: list[list[tuple[int, int]]], items: int, stats: tuple[int, int], k: int) -> DataFrame:
    """Each task's k best documents for each item: item, doc_id, score."""
    starts = np.cumsum([0, *map(len, holders)])
    flat = np.array([h for held in holders for h in held], np.int64).reshape(-1, 2)
    shared = postings.sparkSession.sparkContext.broadcast((weights, starts, flat[:, 0].copy(), flat[:, 1].copy()))
    documents, length = stats

    def chunk(ids: list, n: np.ndarray, sizes: np.ndarray, known: np.ndarray, tf: np.ndarray, heaps: Heaps) -> None:
        weights, starts, of_item, times = shared.value
        row = np.repeat(np.arange(len(n)), sizes)
        m = (100 - 25 + (25 * n * documents) // length)[row]
        impact = weights[known] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        fan = starts[known + 1] - starts[known]
        total = int(fan.sum())
        if not total:
            return
        at = np.arange(total) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(starts[known], fan)
        keys = (of_item[at].astype(np.uint64) << np.uint64(32)) | np.repeat(row, fan).astype(np.uint64)
        keys, scores = accumulated(keys, np.repeat(impact, fan) * times[at])
        heaps.add((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), scores, ids)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, _, _ = shared.value
        heaps = Heaps(items, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            known, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            edges = np.r_[0, np.cumsum(sizes)]
            work = np.r_[0, np.cumsum(starts[known + 1] - starts[known])][edges]  # impacts before each document
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(work, work[a] + _AT_ONCE, "right")) - 1)
                chunk(ids[a:b], n[a:b], sizes[a:b], known[edges[a] : edges[b]], tf[edges[a] : edges[b]], heaps)
                a = b
        rows = heaps.rows()
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return postings.mapInArrow(score, "item int, doc_id long, score long")


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score: each item's k best of all heaps, cut in ranges of the order first, then for each item."""
    order = ["item", F.desc("score"), F.asc_nulls_last("doc_id")]

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            keep = []
            for item in batch.column(0).to_pylist():
                last, seen = item, seen + 1 if item == last else 1
                keep.append(seen <= k)
            yield batch.filter(pa.array(keep, pa.bool_()))

    cut = heaps.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(leading, heaps.schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order[1:])).cast("int")
    return cut.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 20,
    block: int = 500_000,
) -> DataFrame:
    """Rows item_id, rank (from 1), doc_id and score: each item's k best documents with a score above 0.

    Terms are maximal runs of digits, letters (A-Z as a-z) and characters beyond ASCII. With N documents that have terms,
    L terms in them, n terms in one document, df documents that hold a term and tf its occurrences in one, its weight is
    floor(1000 * ln((2N+2) / (2df+1))), the document's m is 100 - 25 + (25 n N) div L, and the score sums
    weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with repeats. Equal scores go by ascending doc_id.

    Null texts have no terms. Documents are rows: those that repeat a doc_id each count and each may be listed; those
    without one count, and are listed with a null doc_id, last among equal scores. Rows that repeat an item_id are one
    item with the terms of its distinct texts; items without an id or without terms are not listed. An empty table gives
    no rows. Texts are read whole. Other columns are ignored.

    block: terms with repeats that the items of one scan hold, unless a single item holds more; more take more scans.
    """
    spark = docs.sparkSession
    docs = as_documents(docs, id_col, text_col)
    asked = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.where("item_id is not null and text is not null").distinct()

    def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t)) for t in as_bytes(batch.column(1))]
            ids = [i for i, own in zip(batch.column(0).to_pylist(), found, strict=True) for _ in own]
            terms = [t for own in found for t in own]
            counts = pa.array([n for own in found for n in own.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.binary()), counts], ["item_id", "term", "n"])

    held = asked.mapInArrow(term_rows, "item_id string, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    held = written(held, "item-terms")
    kind = items.schema[item_id_col].dataType
    path = f"{shared_folder(spark)}/tables/best-{uuid.uuid4().hex}"

    # Items are dealt by hash; parts double until the largest fits or items cannot be told apart any further.
    sizes = held.groupBy("item_id").agg(F.count("*").alias("n"))
    parts = max(1, -(-held.count() // block))
    part = lambda: F.pmod(F.xxhash64("item_id"), F.lit(parts))
    while parts > 1 and parts < 1 << 20 and not sizes.groupBy(part().alias("p")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).where((F.col("n") > block) & (F.col("c") > 1)).isEmpty():
        parts *= 2

    first = True
    for p in range(parts):
        numbers: dict[bytes, int] = {}
        names: dict[str, int] = {}
        holders: list[list[tuple[int, int]]] = []
        for r in held.where(part() == p).toLocalIterator():
            t = numbers.setdefault(bytes(r.term), len(numbers))
            if t == len(holders):
                holders.append([])
            holders[t].append((names.setdefault(r.item_id, len(names)), r.n))
        if not names and not (first and p == parts - 1):
            continue
        postings = written(_postings(docs, list(numbers)), "postings")
        total = postings.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        df = _frequencies(postings, len(numbers)) if numbers else []
        weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * x + 1))) for x in df], np.int64)
        best = _scored(postings, weights, holders, len(names), (total.n, total.terms or 1), k)
        best = _merged(written(best, "heaps"), k)
        named = spark.createDataFrame(list(names.items()), "item_id string, item int")
        best = best.join(F.broadcast(named), "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        best.write.mode("append").parquet(path)
        first = False
    return spark.read.schema(best.schema).parquet(path)
