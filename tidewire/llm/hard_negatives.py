"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, which brings all of them to the same norm, so that the order of inner products with an
anchor is that of Euclidean distances. Each belongs to its nearest pivot, and the table is stored sorted by (pivot,
distance): the index. By the triangle inequality, rows within a radius of an anchor have keys within that radius of the
anchor's own distance to the pivot. A search scans these key intervals, and then only the annuli by which they grow, until the
radius reaches what certifies its k best: no row outside can score as much. The parquet scan skips keys that no search needs.

Anchors go through in blocks with a bound on their number, each broadcast to a scan of the index. Scores are integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import shared_folder, written

_NONE, _ALL = -(1 << 62), 1 << 62
_TOGETHER = 128  # searches whose scores one task holds at once


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A row of doubles for each list, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _augmented(rows: np.ndarray, most: float) -> np.ndarray:
    """rows with a last component that brings each to the squared norm `most`."""
    return np.c_[rows, np.sqrt(np.maximum(most - (rows**2).sum(axis=1), 0))]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, for rows whose differences are not worth a cube."""
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def pivots_of(sample: np.ndarray, count: int, turns: int = 8) -> np.ndarray:
    """Centres of the sample, started from rows that lie far apart."""
    centres = sample[:1]
    gap = _distances(sample, centres)[:, 0]
    while len(centres) < min(count, len(sample)) and gap.max() > 0:
        centres = np.r_[centres, sample[[gap.argmax()]]]
        gap = np.minimum(gap, _distances(sample, centres[-1:])[:, 0])
    for _ in range(turns):
        nearest = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
    return centres


@dataclass
class Index:
    """rows: vec_id, label, v, pivot, distance, sorted by the last two within files; most: the largest squared norm."""

    rows: DataFrame
    pivots: np.ndarray
    most: float
    dims: int
    #: Error of computed distances, against which radii and bounds are widened.
    slack: float


def build_index(rows: DataFrame, pivots: int, sample: int) -> Index:
    """The index of rows (vec_id, label, v). Pivots come from the `sample` rows with the smallest hashes of their ids."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    totals = rows.agg(F.max(norm).alias("most"), F.max(F.size("v")).alias("dims")).first()
    most, dims = float(totals.most or 0), int(totals.dims or 0)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks() if dims else pa.array([[]], pa.list_(pa.float64()))
    slack = 1e-6 * (1 + most**0.5)
    centres = spark.sparkContext.broadcast(pivots_of(_augmented(_matrix(taken, dims), most), pivots))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_augmented(_matrix(batch.column(2), dims), most), centres.value)
                nearest = away.argmin(axis=1)
                columns = [pa.array(nearest, pa.int32()), pa.array(away[np.arange(len(away)), nearest], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["vec_id", "label", "v", "pivot", "distance"])

    found = written(rows.select("vec_id", "label", "v").mapInArrow(keyed, "vec_id long, label long, v array<double>, pivot int, distance double"), "keys")
    # vec_id is part of the range, so that very many rows with one key still spread over files
    ordered = found.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance")
    return Index(written(ordered, "index"), centres.value, most, dims, slack)


@dataclass
class Searches:
    """One entry for each search: its vector, its anchor's id and label, and what it still needs.

    same: whether rows of the anchor's label are wanted, or of others; low, high: scores that count; floor, floor_id: the
    k-th best so far, if there is one; done, reach: the radii that earlier scans and the next one cover.
    """

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    floor_id: np.ndarray
    done: np.ndarray
    reach: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray) -> Searches:
        n = len(ids)
        return Searches(vectors, ids, labels, same, low, high, np.full(n, _NONE), np.full(n, _ALL), np.full(n, -1.0), np.full(n, -1.0))


def _radius(index: Index, vectors: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The distance, rounded up, within which all rows with at least these scores lie."""
    square = (vectors**2).sum(axis=1) + index.most - 2.0 * scores
    return np.sqrt(np.maximum(square, 0)) + index.slack


def _ids_and_scores(best: dict[str, list], n: int, s: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k best of each search among those kept so far and new ones: high scores first, then small ids."""
    s, ids, scores = (np.concatenate([best[c], x]) for c, x in (("s", s), ("ids", ids), ("scores", scores)))
    order = np.lexsort((ids, -scores, s))
    s, ids, scores = s[order], ids[order], scores[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    keep = place < k
    return {"s": s[keep], "ids": ids[keep], "scores": scores[keep]}


def _scan(index: Index, searches: Searches, active: np.ndarray, k: int) -> DataFrame:
    """search, vec_id, score: each task's k best rows of the annuli between done and reach, for the active searches."""
    q = Searches(*(x[active] if isinstance(x, np.ndarray) else x for x in vars(searches).values()))
    own = _distances(_augmented_anchor(q.vectors), index.pivots)
    shared = index.rows.sparkSession.sparkContext.broadcast((q, own, active))
    # The hull of the key intervals of each pivot, which the scan of the files can skip by.
    keys = F.lit(False)
    for p in range(len(index.pivots)):
        lo, hi = float((own[:, p] - q.reach).min()) - index.slack, float((own[:, p] + q.reach).max()) + index.slack
        keys = keys | ((F.col("pivot") == p) & F.col("distance").between(lo, hi))
    dims = index.dims

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, numbers = shared.value
        best = {c: np.empty(0, np.int64) for c in ("s", "ids", "scores")}
        floor, floor_id = q.floor.copy(), q.floor_id.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")  # ties go by position
            ids, labels = batch.column(0).to_numpy()[order], batch.column(1).to_numpy()[order]
            pivot, away = batch.column(3).to_numpy()[order], batch.column(4).to_numpy()[order]
            rows = _matrix(batch.column(2), dims)[order]
            for p in np.unique(pivot):
                here = np.flatnonzero(pivot == p)
                key = away[here]
                gap = np.maximum(np.maximum(key.min() - own[:, p], own[:, p] - key.max()), 0)
                inside = np.maximum(np.abs(key.min() - own[:, p]), np.abs(key.max() - own[:, p]))
                wanted = np.flatnonzero((gap <= q.reach) & (inside > q.done))
                for a in range(0, len(wanted), _TOGETHER):
                    w = wanted[a : a + _TOGETHER]
                    scores = (q.vectors[w] @ rows[here].T).astype(np.int64)
                    ring = np.abs(key - own[w, p][:, None])
                    good = (ring > q.done[w][:, None]) & (ring <= q.reach[w][:, None])
                    good &= (labels[here] == q.labels[w][:, None]) == q.same
                    good &= (ids[here] != q.ids[w][:, None]) & (scores >= q.low[w][:, None]) & (scores <= q.high[w][:, None])
                    good &= (scores > floor[w][:, None]) | ((scores == floor[w][:, None]) & (ids[here] < floor_id[w][:, None]))
                    if len(here) > k:  # of equal scores those at the front, which have the smallest ids
                        ranked = np.where(good, scores * len(here) + np.arange(len(here) - 1, -1, -1), _NONE)
                        good &= ranked >= np.partition(ranked, -k, axis=1)[:, -k][:, None]
                    s, c = np.nonzero(good)
                    if len(s):
                        best = _ids_and_scores(best, len(q.ids), w[s], ids[here][c], scores[s, c], k)
                        full = np.flatnonzero(np.bincount(best["s"], minlength=len(floor)) == k)
                        last = np.searchsorted(best["s"], full, "right") - 1
                        floor[full], floor_id[full] = best["scores"][last], best["ids"][last]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best["s"]], pa.int64()), pa.array(best["ids"]), pa.array(best["scores"])], ["search", "vec_id", "score"])

    return index.rows.where(keys).mapInArrow(scan, "search long, vec_id long, score long")


def _augmented_anchor(vectors: np.ndarray) -> np.ndarray:
    """Anchors have no last component: their distances to rows then follow from inner products alone."""
    return np.c_[vectors, np.zeros(len(vectors))]


def _searched(index: Index, searches: Searches, k: int, start: np.ndarray) -> DataFrame:
    """search, vec_id, score, rank: each search's k best; start: radii of the first scan."""
    farthest = _radius(index, searches.vectors, np.minimum(-((searches.vectors**2).sum(axis=1) * index.most) ** 0.5, 0)) + index.slack
    enough = np.minimum(farthest, np.where(searches.low > _NONE, _radius(index, searches.vectors, np.maximum(searches.low, -(2.0**60))), farthest))
    searches.reach = np.minimum(start, enough)
    active = np.arange(len(searches.ids))
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    spread = Window.partitionBy("search", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(F.desc("score"), "vec_id")
    found = None
    while found is None or len(active):
        here = _scan(index, searches, active, k)
        if found is not None:
            here = here.unionByName(found.drop("rank"))
        here = here.withColumn("rank", F.row_number().over(spread)).where(F.col("rank") <= k)
        here = here.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        found = written(here, "found")
        for r in found.where(F.col("rank") == k).collect():  # one row a search of the block
            searches.floor[r.search], searches.floor_id[r.search] = r.score, r.vec_id
        searches.done[active] = searches.reach[active]
        need = np.where(searches.floor > _NONE, _radius(index, searches.vectors, np.maximum(searches.floor, -(2.0**60))), np.inf)
        need = np.minimum(need, enough)
        active = np.flatnonzero(searches.done < need)
        known = searches.floor > _NONE
        wider = np.maximum(2 * searches.done, searches.done + index.most**0.5 / 8 + index.slack)
        searches.reach = np.where(known, need, np.minimum(enough, wider))
    return found


def hard_negatives(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    pivots: int = 32,
    sample: int = 4096,
    block: int = 8192,
) -> DataFrame:
    """Rows anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are floor(scale * x), x as double; scores are integer inner products with the anchor; order is by falling
    score, then id. Anchors are rows whose id is divisible by `every`; an anchor's positives are its first `positives`
    other rows of its label. For each positive, its first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score are listed.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Rows that repeat an id
    count once, as the one with the smallest label, then vector. Shorter vectors count as if zeros followed. Anchors
    without positives, and positives without negatives, are not listed; an empty table gives no rows. Other columns are
    ignored. Scores stay exact as long as squared norms of the integers stay below 2^49.

    pivots, sample: pivots are fitted on that many rows at most; they move work, not results, since every row is indexed
    and every search goes on until it is certified. block: anchors that one scan broadcasts.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    return mined(build_index(written(rows, "vectors"), pivots, sample), every, positives, negatives, low, high, block)


def mined(index: Index, every: int, positives: int, negatives: int, low: int, high: int, block: int) -> DataFrame:
    """hard_negatives over an index, block by block of anchors."""
    spark: SparkSession = index.rows.sparkSession
    path = f"{shared_folder(spark)}/tables/negatives-{uuid.uuid4().hex}"
    anchors = index.rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-anchors.count() // block))
    part = lambda: F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    while parts > 1 and anchors.groupBy(part().alias("p")).count().agg(F.max("count")).first()[0] > block:
        parts *= 2
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], out).write.parquet(path)
    for p in range(parts):
        taken = anchors.where(part() == p).select("vec_id", "label", "v").toArrow()
        ids, labels = taken["vec_id"].to_numpy(), taken["label"].to_numpy()
        if not len(ids):
            continue
        vectors = _matrix(taken["v"].combine_chunks(), index.dims)
        nothing = np.full(len(ids), _NONE)
        near = _distances(_augmented_anchor(vectors), index.pivots).min(axis=1)
        # A first radius that takes in the anchor's own pivot: its cluster, where there are clusters.
        wanted = Searches.of(vectors, ids, labels, True, nothing, np.full(len(ids), _ALL))
        rows = _searched(index, wanted, positives, near).where("score >= 0").collect()  # negative scores have no share of them below them
        if not rows:
            continue
        of, scores = np.array([r.search for r in rows]), np.array([r.score for r in rows])
        least, greatest = -(-low * scores // 100), high * scores // 100
        wanted = Searches.of(vectors[of], ids[of], labels[of], False, least, greatest)
        start = _radius(index, vectors[of], (least + greatest) / 2)
        found = _searched(index, wanted, negatives, start)
        pairs = [(i, int(ids[r.search]), r.vec_id, r.score) for i, r in enumerate(rows)]
        named = spark.createDataFrame(pairs, "search long, anchor_id long, positive_id long, positive_score long")
        found.join(F.broadcast(named), "search").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)
