"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Documents with the same shingle set form a class with its smallest id as representative. Representatives get SuperMinHash
signatures: each element visits the slots in its own random order, the i-th visit with a value in [i, i+1), so that a
document stops as soon as no slot can fall any further. Bands of the signature give buckets. In two rounds, every bucket
compares a few pivots with its other members, leaves out pairs that are already connected or too unlike in size, and
drops its pivots, which have met all others. Of the buckets that still hold several components, those of bounded size are
compared each in one task, which returns the links that join components; the members of larger ones meet by their rarest
shingles, which finds every pair that may agree without listing the pairs of a bucket. So a bucket of copies costs one
comparison per member, and yet no pair is passed over unless its ends are known to be connected or too unlike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import GOLDEN, LOWER, as_bytes, as_documents, batches_of, mix, release, written
from tidewire.llm.components import connected_components

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; of all its words, if they are fewer than size."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    total = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total = mix(total * ODD[i % len(ODD)] + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A row of slots for each set, none empty; the visit's number stands in the upper 32 bits, its value below."""
    n = len(sets)
    signature = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order: np.ndarray | None = None
    for visit in range(slots):
        random = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (2 * visit + 1) % 2**64))
        pick = visit + (((random & _LOW) * np.uint64(slots - visit)) >> _32).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, visit]
        np.minimum.at(signature, owner * slots + slot, (random >> _32) | (np.uint64(visit) << _32))
        # A document is done when all slots are below what the next visit can bring.
        open_ = signature.reshape(n, slots).max(axis=1) >= (np.uint64(visit + 1) << _32)
        still = open_[owner]
        if not still.any():
            break
        if order is None:
            elements, owner, pick = elements[still], owner[still], pick[still]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), pick] = 0
        elif still.mean() < 0.7:
            elements, owner, order = elements[still], owner[still], order[still]
    return signature.reshape(n, slots)


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    slots = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for group in batches_of(list(range(len(texts))), [len(t) for t in texts], 1_500_000):
                sets = [shingle_hashes(texts[i], size) for i in group]
                full = [i for i, s in enumerate(sets) if len(s)]
                prints: list = [None] * len(group)
                bits: list = [None] * len(group)
                keys: list = [None] * len(group)
                if full:
                    signature = superminhash([sets[i] for i in full], slots)
                    hashes = np.full((len(full), bands), 0, np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        hashes = mix(hashes * GOLDEN + signature[:, r::rows])
                    short = signature.astype("<u2")
                    for i, s, h in zip(full, short, hashes.view(np.int64).tolist(), strict=True):
                        prints[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        bits[i], keys[i] = s.tobytes(), h
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(group)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(bits, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_print", "signature", "bands"],
                )

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_print binary, signature binary, bands array<long>")


def _resembling(pairs: DataFrame, sketches: DataFrame, slots: int, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in `least` of their slots."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, slots) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sketches.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _full_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """doc_id and its sorted shingle hashes, for the representatives alone."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [shingle_hashes(t, size).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.binary())], ["doc_id", "full"])

    # Representatives grow with the corpus: never broadcast.
    return docs.hint("merge").join(reps, "doc_id").select("doc_id", "text").mapInArrow(sets, "doc_id long, full binary")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = full.select(F.col("doc_id").alias("a"), F.col("full").alias("fa"))
    right = full.select(F.col("doc_id").alias("b"), F.col("full").alias("fb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "fa", "fb").mapInArrow(confirm, "a long, b long")


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, from their incidence matrix in strips of columns."""
    shingle, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = count[at] > 1  # a shingle of one set alone is common to none
    rank = np.cumsum(count > 1) - 1
    owner, at = owner[twice], rank[at[twice]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((count > 1).sum()), columns):
        lo, hi = np.searchsorted(at, [first, first + columns])
        strip = np.zeros((len(sets), columns), np.float32)
        strip[owner[lo:hi], at[lo:hi] - first] = 1
        total += strip @ strip.T
    return np.rint(total).astype(np.int64)


def _bucket_links(live: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components among the members of each bucket (bucket, rep, component), a bucket to a task.

    Only for buckets of bounded size; tasks return links that join components, no pairs.
    """

    def compare(group: pa.Table) -> pa.Table:
        reps, of = group["rep"].to_numpy(), group["component"].to_numpy()
        found: list[tuple[int, int]] = []
        if len(set(of)) > 1:
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in group["full"]]
            common = common_counts(sets)
            sizes = np.array([len(s) for s in sets])
            near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
            name = {c: c for c in of.tolist()}

            def root(c: int) -> int:
                while name[c] != c:
                    name[c] = c = name[name[c]]
                return c

            for i, j in zip(*np.nonzero(np.triu(near & (of[:, None] != of[None, :])))):
                x, y = root(int(of[i])), root(int(of[j]))
                if x != y:
                    name[max(x, y)] = min(x, y)
                    found.append((int(reps[i]), int(reps[j])))
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sets = full.withColumnRenamed("doc_id", "rep")
    return live.select("bucket", "rep", "component").join(sets, "rep").groupBy("bucket").applyInArrow(compare, "a long, b long")


def _rare_shingle_pairs(live: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of live (rep, component), of different components, that may agree to percent: none that does is left out.

    Shingles are ordered by how many of these documents hold them, rarest first. Two sets that agree share a shingle among the
    first of both, and what follows it in each must suffice for the intersection: at their first common shingle the bound
    on what is left holds, so pairs that fail it at every shingle cannot agree. Shingles of one document alone come first in
    the order and are only counted, so text that all members of a bucket share brings none of them together.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(value.as_buffer(), np.int64)
                for first in range(0, len(tokens), 100_000):
                    part = tokens[first : first + 100_000]
                    columns = [np.full(len(part), rep), np.full(len(part), len(tokens)), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "n", "token"])

    sets = full.withColumnRenamed("doc_id", "rep").join(live.select("rep"), "rep", "left_semi").select("rep", "full")
    tokens = written(sets.mapInArrow(listed, "rep long, n long, token long"), "dense-shingles")
    counts = tokens.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    shared = tokens.join(counts, "token").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("holders", "token")))
    shared = shared.withColumn("place", F.col("n") - F.count("*").over(Window.partitionBy("rep")) + F.col("place") - 1)
    # Of the larger set, n - place >= percent of n; of the smaller one, more: its share of the intersection.
    prefix = written(shared.where(f"100 * (n - place) >= {percent} * n").select("rep", "n", "token", "place").join(live, "rep"), "dense-prefixes")
    small = prefix.where(f"(100 + {percent}) * (n - place) >= 2 * {percent} * n")
    x, y = (side.select("token", *(F.col(c).alias(f"{p}_{c}") for c in ("rep", "n", "place", "component"))) for p, side in (("x", small), ("y", prefix)))
    meet = (
        "x_component <> y_component and struct(x_n, x_rep) < struct(y_n, y_rep) "
        f"and 100 * x_n >= {percent} * y_n and (100 + {percent}) * least(x_n - x_place, y_n - y_place) >= {percent} * (x_n + y_n)"
    )
    return x.join(y, "token").where(meet).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 4,
    block: int = 512,
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept.

    Texts are lower-cased in A-Z and split at space, tab, newline, vertical tab, form feed and carriage return. Two
    documents are linked if 100 * intersection >= percent * union of their sets of `shingle`-word shingles; fewer words
    make one shingle. Links are confirmed on full sets of 64-bit shingle hashes.

    Null or empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id are one document as far
    as links go, each with its own n_shingles. A null doc_id is its own component, null, and kept. An empty table gives
    no rows. Other columns are ignored.

    A pair at 85 % misses all of 24 bands of 4 with a chance of 2e-8, at 80 % with 3e-6. Pairs whose 96 slots agree by
    less than percent - 25 points are not compared in full; a pair at the limit falls so low with a chance below 1e-9.
    What two rounds of pivots leave of a bucket is compared in one task up to `block` members and 5000 * block shingles,
    and beyond that by rare shingles: both examine every pair. Very long texts are read whole.
    """
    docs = as_documents(docs, id_col, text_col)
    sketches = written(_sketches(docs, shingle, bands, rows), "sketches")
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    one = F.min_by(F.struct("n_shingles", "signature", "bands"), "doc_id").alias("one")
    reps = named.groupBy("set_print").agg(F.min("doc_id").alias("rep"), one).select("set_print", "rep", "one.*")
    reps = written(reps, "representatives")
    same_set = named.select("doc_id", "set_print").join(reps.select("set_print", "rep"), "set_print").where("doc_id <> rep")
    links = same_set.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    entries = reps.select(F.explode("bands").alias("bucket"), "rep")
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count("*").alias("members"))
    entries = written(entries.join(shared.where("x < y").select("bucket", "members"), "bucket"), "buckets")
    release(docs.sparkSession)
    # Members of large buckets tend to be close to many: they are compared first.
    nodes = (
        reps.groupBy("rep")
        .agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
        .join(entries.groupBy("rep").agg(F.sum("members").alias("central")), "rep")
        .select("rep", F.col("rep").alias("component"), "central", "least", "most")
    )
    nodes = written(nodes, "nodes")
    full = written(_full_sets(docs, nodes.select(F.col("rep").alias("doc_id")), shingle), "shingle-sets")
    release(docs.sparkSession)
    signatures = reps.select(F.col("rep").alias("doc_id"), "signature")

    entries = entries.select("bucket", "rep").distinct()
    fits = f"rep <> pivot and component <> p_component and 100 * most >= {percent} * p_least and 100 * p_most >= {percent} * least"

    def united(found: DataFrame, nodes: DataFrame) -> DataFrame:
        """nodes with the components that these links join."""
        of = nodes.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
        to = nodes.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
        joined = found.join(of, "a").join(to, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moved = connected_components(joined).select(F.col("node").alias("component"), "label")
        nodes = nodes.join(moved, "component", "left").withColumn("component", F.coalesce("label", "component")).drop("label")
        return written(nodes, "nodes")

    for cells in (1, 8):
        if entries.isEmpty():
            break
        live = entries.join(nodes, "rep")
        order = F.struct((-F.col("central")).alias("o"), F.xxhash64("rep").alias("h"), "rep", "component", "least", "most")
        cell = F.pmod(F.shiftright(F.xxhash64("rep"), 8), F.lit(cells))
        pivots = live.groupBy("bucket", cell.alias("cell")).agg(F.min(order).alias("p"))
        pivots = written(pivots.select("bucket", F.col("p.rep").alias("pivot"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("component", "least", "most"))), "pivots")
        met = live.join(pivots, "bucket").where(fits).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
        pairs = written(_resembling(met, signatures, bands * rows, percent / 100 - 0.25).distinct(), "pairs")
        if not pairs.isEmpty():
            found = written(_confirmed(pairs, full, percent), "links")
            if not found.isEmpty():
                links = links.unionByName(found)
                nodes = united(found, nodes)
        rest = entries.join(pivots.select("bucket", F.col("pivot").alias("rep")), ["bucket", "rep"], "left_anti")
        mixed = rest.join(nodes, "rep").groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        entries = written(rest.join(mixed.select("bucket"), "bucket"), "buckets")
        release(docs.sparkSession)
    if not entries.isEmpty():
        live = entries.join(nodes.select("rep", "component", "most"), "rep")
        sizes = live.groupBy("bucket").agg(((F.count("*") > block) | (F.sum("most") > block * 5000)).alias("dense"))
        live = written(live.join(sizes, "bucket"), "rest")
        links = links.unionByName(written(_bucket_links(live.where("not dense"), full, percent), "bucket-links"))
        dense = live.where("dense").select("rep", "component").distinct()
        if not dense.isEmpty():
            pairs = _rare_shingle_pairs(dense, full, percent)
            pairs = written(_resembling(pairs, signatures, bands * rows, percent / 100 - 0.25), "pairs")
            links = links.unionByName(written(_confirmed(pairs, full, percent), "links"))

    labels = connected_components(links)
    same = F.col("doc_id") == F.col("node")
    component_id = F.coalesce("label", F.when(F.col("n_shingles") >= 0, F.col("doc_id")))
    return (
        sketches.select("doc_id", "n_shingles")
        .join(labels, same, "left")
        .select("doc_id", "n_shingles", component_id.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
