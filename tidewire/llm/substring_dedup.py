"""Repeated byte strings across documents, by prefix doubling over sampled suffixes.

Every window of `length` bytes selects, among the 16-byte grams inside, the one with the smallest hash; equal windows
select the same gram at the same place. So the positions that any window selects stand for all suffixes, at about an
eighteenth of their number. A selected position's context is the stretch that its windows cover.

Spark sorts the positions by pairs of ranks at growing offsets, and only positions that are still tied go on:

1. (8 bytes at 0, 8 bytes at 8): a position whose 16 bytes occur in one document only is unique; it and its windows drop out.
2. (16 bytes at 0, the context around them, past the threshold): in a class of equal contexts all documents but the
   smallest lose every window of theirs; the smallest goes on if other contexts share its 16 bytes.
3. The windows of what is left are ranked against each other: within the sorted run of their 16 bytes, or, where a run is
   too large for that, by one more sort of all its windows.

Ranks are the bytes themselves, so equality is exact at each step; hashes only choose positions and partitions. Copies of
whole texts, told by SHA-256, leave after the first sort. Rows known to be tied or settled before a sort (by others of their batch) are not sorted but dealt out at random, and a gram with more
than 1/2000 of all positions is dealt out by contexts, so that no key fills a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import GOLDEN, as_bytes, as_documents, batches_of, mix, release, text_key, written

GRAM = 16
_PLACE = np.uint64(0xFFFFFF)
_NONE = 2**63 - 1


def values_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    x = data.astype(np.uint16)
    x = ((x[:-1] << 8) | x[1:]).astype(np.uint32)
    x = ((x[:-2] << np.uint32(16)) | x[2:]).astype(np.uint64)
    return (x[:-4] << np.uint64(32)) | x[4:]


def sampled(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Selected positions in texts laid end to end: values at 0 and 8, hash, first window, anchor - first, last - first.

    ends: for each byte, where its text ends.
    """
    at = values_of(data)
    high, low = at[:-8], at[8:]
    print_ = mix(high * GOLDEN + mix(low))
    key = (print_ & ~_PLACE) | np.arange(len(print_), dtype=np.uint64)
    slots, width = length - GRAM + 1, 1
    while width * 2 <= slots:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if rest := slots - width:
        key = np.minimum(key[:-rest], key[rest:])
    start = np.flatnonzero(np.arange(length, len(key) + length, dtype=ends.dtype) <= ends[: len(key)])
    place = (key[start] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    first, last, place = start[head], start[np.r_[head[1:], len(start)] - 1] if len(head) else start[head], place[head]
    return high[place], low[place], print_[place], first, place - first, last - first


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, where each begins, and for each byte where its text ends."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(parts), np.uint8), ends - sizes, np.repeat(ends, sizes)


def _binary(rows: np.ndarray) -> pa.Array:
    """An array of binary values, one for each row of bytes."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _codes(rows: np.ndarray) -> np.ndarray:
    """A number for each row of bytes, equal for equal rows."""
    return _binary(rows).dictionary_encode().indices.to_numpy()


def _later(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same code."""
    order = np.lexsort((doc, code))
    head = np.r_[True, code[order][1:] != code[order][:-1]]
    least = np.empty(len(doc), doc.dtype)
    least[order] = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    return doc > least


def _objects(lists: pa.Array) -> np.ndarray:
    """Lists, nearly all null, as an array of objects."""
    out = np.full(len(lists), None, object)
    if lists.null_count < len(lists):
        for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
            out[i] = lists[i].as_py()
    return out


def _windows(contexts: np.ndarray, extent: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of contexts (rows of bytes): row of each, its place in the context, its bytes."""
    of = np.repeat(np.arange(len(extent)), extent + 1)
    place = np.arange(len(of)) - np.repeat(np.cumsum(extent + 1) - extent - 1, extent + 1)
    flat = np.lib.stride_tricks.sliding_window_view(contexts.reshape(-1), length)
    return of, place, flat[of * contexts.shape[1] + place]


def _runs(of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive places of one row: row, first place, last place."""
    if not len(of):
        return of, place, place
    head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)])
    return of[head], place[head], place[np.r_[head[1:], len(of)] - 1]


def repeated_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    slice_bytes: int = 1 << 19,
    often: int = 1000,
    hot_share: int = 2000,
    most_in_run: int = 20_000,
) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (start, end of the removed bytes) and kept, the other bytes.

    A byte is removed if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id.
    Strings are judged on the input; matches stay within documents, over the UTF-8 bytes of whole texts.

    Null texts are empty and keep no bytes. Rows that repeat a doc_id do not remove each other's strings; a null doc_id
    counts as larger than all others. An empty table gives no rows. Other columns are ignored. length is from 24 to 70.
    Very long texts are worked on in overlapping slices of slice_bytes bytes.

    A gram is dealt out by contexts if it has at least `often` positions and one in hot_share of all. A task compares at
    most most_in_run contexts of one gram; where there are more, all their windows are sorted.
    """
    if not 24 <= length <= 70:
        raise ValueError("length must be from 24 to 70")
    spark = docs.sparkSession
    docs = as_documents(docs, id_col, text_col)
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    ids = docs.select("doc_id")
    unique = ids.distinct().count() == ids.count() and not ids.where("doc_id is null").take(1)
    # One number tells rows apart unless ids repeat; then the text's hash does, besides.
    keys = ["doc_id"] if unique else ["doc_id", "text_key"]
    key_type = ", ".join(f"{k} long" for k in keys)
    # Copies of a whole text lose all, or are too short to lose anything: they take no part beyond the first sort.
    prints = docs.select(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), text_key().alias("text_key"), F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("print"))
    prints = written(prints.where("n > 0"), "prints")
    first = prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    # A text may have any number of copies: they are dealt to several tasks, each with a row of its own for that text.
    salts = 16
    first = first.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)).cast("int"))
    copies = written(salted.join(first, ["print", "salt"]).where("doc_id > least").select(*keys, "n"), "copies")
    wide = 2 * length - GRAM  # the longest context
    shifts = pa.list_(pa.int64())

    def own(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(0).fill_null(_NONE).to_numpy(), batch.column(1).to_numpy()][: len(keys)]

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Selected positions with the number of rows that each stands for in the sort; 0: tied already."""
        for batch in batches:
            who = own(batch)
            pieces = [
                (i, base, data[base : base + slice_bytes + length - 1])
                for i, data in enumerate(as_bytes(batch.column(2)))
                for base in range(0, max(0, len(data) - length + 1), slice_bytes)
            ]
            for group in batches_of(pieces, [len(p[2]) for p in pieces], slice_bytes + length):
                data, starts, ends = _joined([p[2] for p in group])
                high, low, print_, first, lead, extent = sampled(data, ends, length)
                piece = np.searchsorted(starts, first, "right") - 1
                row = np.array([p[0] for p in group])[piece]
                at = first - starts[piece] + np.array([p[1] for p in group])[piece]
                doc = who[0][row]
                # Of grams that several documents of this group have, the smallest and the largest go on for all.
                order = np.lexsort((doc, print_))
                head = np.flatnonzero(np.r_[True, print_[order][1:] != print_[order][:-1]])
                size = np.diff(np.r_[head, len(order)])
                tied = (size > 2) & (doc[order[head]] < doc[order[head + size - 1]])
                n = np.ones(len(order), np.int64)
                n[order[np.repeat(tied, size)]] = 0
                n[order[head[tied]]] = 1
                n[order[(head + size - 1)[tied]]] = size[tied] - 1
                packed = (at << 12) | (lead << 6) | extent
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (high.view(np.int64), low.view(np.int64), *(w[row] for w in who), packed, n)],
                    ["high", "low", *keys, "at", "n"],
                )

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions whose gram several documents have; and a row (high, low, n) for grams with many of them."""
        held: list[np.ndarray] | None = None

        def out(rows: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
            k, m = len(rows[0]), len(marks[0])
            full = [pa.concat_arrays([pa.array(c), pa.nulls(m, pa.int64())]) for c in rows]
            mark = [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(c)]) for c in marks]
            return pa.RecordBatch.from_arrays(full + mark, [*keys, "at", "high", "low", "n"])

        def step(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray] | None, pa.RecordBatch]:
            high, low, doc, n, done = cols[0], cols[1], cols[2], cols[-2], cols[-1]
            head = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            size = np.diff(np.r_[head, len(high)])
            tie = doc[head] < doc[head + size - 1]
            emit = (np.repeat(tie, size) | (n == 0)) & (done == 0)
            total = np.add.reduceat(n, head)
            cut, rest = len(head), None
            if not last:
                cut -= 1
                rest = [c[head[-1] :] for c in cols]
                rest[-1] = rest[-1] | emit[head[-1] :]
                if tie[-1]:  # its rows are out; two stand for them
                    rest = [c[[0, -1]] for c in rest]
                    rest[-2] = np.array([max(1, total[-1] - 1), 1])
            many = np.flatnonzero(total[:cut] >= often)
            return rest, out([c[emit] for c in cols[2:-2]], [high[head[many]], low[head[many]], total[many]])

        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
                cols.append(np.zeros(batch.num_rows, np.int64))
                if held is not None:
                    cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
                held, found = step(cols, False)
                yield found
        if held is not None:
            yield step(held, True)[1]

    found = keyed.mapInArrow(positions, f"high long, low long, {key_type}, at long, n long")
    apart = F.when(F.col("n") == 0, F.col("at")).otherwise(F.lit(0))
    found = found.repartition("high", "low", apart).sortWithinPartitions("high", "low", "doc_id")
    found = written(found.mapInArrow(tied, f"{key_type}, at long, high long, low long, n long"), "tied-positions")
    release(spark)
    total = found.where("at is not null").count()
    hot = found.where(f"n >= {max(often, total // hot_share)}").select("high", "low").collect()  # at most hot_share rows
    high, low = (np.array([r[i] for r in hot], np.int64).view(np.uint64) for i in (0, 1))
    hot_prints = np.sort(mix(high * GOLDEN + mix(low)))

    def with_rows(df: DataFrame, name: str, how: str) -> DataFrame:
        """docs with df's rows for them, gathered."""
        named = df.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        same = F.coalesce("doc_id", F.lit(_NONE)) == F.col("_doc_id")
        return keyed.join(named, same if unique else same & (F.col("text_key") == F.col("_text_key")), how)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rank: gram, its place in the context, extent and context, all padded; empty if settled. Salt: 0, or how to deal."""
        for batch in batches:
            who = own(batch)
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            flat, begin = lists.flatten().to_numpy(), np.cumsum(counts) - counts
            texts = as_bytes(batch.column(2))
            for group in batches_of(list(range(len(texts))), [len(t) for t in texts], 2 * slice_bytes):
                data = np.frombuffer(b"".join([texts[i] for i in group]) + bytes(wide), np.uint8)
                base = np.cumsum([0, *(len(texts[i]) for i in group[:-1])])
                all_at = np.concatenate([flat[begin[i] : begin[i] + counts[i]] for i in group])
                all_of = np.repeat(np.arange(len(group)), counts[group])
                for cut in range(0, len(all_at), 50_000):
                    at, of = all_at[cut : cut + 50_000], all_of[cut : cut + 50_000]
                    first, lead, extent = base[of] + (at >> 12), (at >> 6) & 63, at & 63
                    rows = np.zeros((len(at), GRAM + 2 + wide), np.uint8)
                    rows[:, :GRAM] = np.lib.stride_tricks.sliding_window_view(data, GRAM)[first + lead]
                    rows[:, GRAM], rows[:, GRAM + 1] = lead, extent
                    rows[:, GRAM + 2 :] = np.lib.stride_tricks.sliding_window_view(data, wide)[first]
                    rows[:, GRAM + 2 :][np.arange(wide) >= (length + extent)[:, None]] = 0
                    row = np.array(group)[of]
                    code = _codes(rows)
                    # Repeats of a context within a text share the fate of the first; it keeps how far they lie behind it.
                    order = np.lexsort((np.arange(len(at)), row, code))
                    fresh = np.r_[True, (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1])]
                    more: list = [None] * int(fresh.sum())
                    if len(more) < len(at):
                        head = np.flatnonzero(fresh)
                        place = at[order] >> 12
                        for i, (b, e) in enumerate(zip(head.tolist(), [*head[1:].tolist(), len(at)], strict=True)):
                            if e - b > 1:
                                more[i] = place[b + 1 : e] - place[b]
                    pick = order[fresh]
                    rows, at, row, code = rows[pick], at[pick], row[pick], code[pick]
                    doc = who[0][row]
                    settled = _later(code, doc)
                    gram = np.ascontiguousarray(rows[:, :GRAM]).view(">u8").astype(np.uint64)
                    print_ = mix(gram[:, 0] * GOLDEN + mix(gram[:, 1]))
                    salt = np.zeros(len(at), np.int64)
                    if len(hot_prints):
                        popular = hot_prints[np.minimum(np.searchsorted(hot_prints, print_), len(hot_prints) - 1)] == print_
                        if popular.any():
                            salt[popular] = [zlib.crc32(r.tobytes()) | 1 for r in rows[popular]]
                    salt[settled] = (mix(doc[settled].astype(np.uint64) * GOLDEN + at[settled].astype(np.uint64)) | np.uint64(1)).view(np.int64)
                    ranks = _binary(rows).to_pylist() if settled.any() else None
                    rank = pa.array([b"" if s else r for r, s in zip(ranks, settled.tolist(), strict=True)], pa.binary()) if ranks else _binary(rows)
                    yield pa.RecordBatch.from_arrays(
                        [rank, pa.array(salt), *(pa.array(w[row]) for w in who), pa.array(at), pa.array(more, shifts)], ["rank", "salt", *keys, "at", "more"]
                    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Removed stretches (start, end), and contexts whose windows are still to be ranked (context not null)."""
        n_keys = len(keys)

        def out(who: list[np.ndarray], start: np.ndarray, end: np.ndarray, context: np.ndarray | None = None) -> pa.RecordBatch:
            last = pa.nulls(len(start), pa.binary()) if context is None else _binary(context)
            own = [*(pa.array(w) for w in who[:-1]), pa.array(start), pa.array(end), pa.array(who[-1].tolist(), shifts), last]
            return pa.RecordBatch.from_arrays(own, [*keys, "start", "end", "more", "context"])

        def compare(rows: np.ndarray, who: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Windows of whole runs of grams that a smaller document has too."""
            gram = np.ascontiguousarray(rows[:, :GRAM]).view(f"V{GRAM}")[:, 0]
            same = gram[1:] == gram[:-1]
            some = np.flatnonzero(np.r_[False, same] | np.r_[same, False])  # the others have their gram alone
            for group in batches_of(some.tolist(), ((at[some] & 63) + 1).tolist(), 4_000_000):
                pick = np.array(group)
                of, place, windows = _windows(np.ascontiguousarray(rows[pick, GRAM + 2 :]), at[pick] & 63, length)
                late = _later(_codes(windows), who[0][pick][of])
                of, start, end = _runs(of[late], place[late])
                start, end = start + (at[pick[of]] >> 12), end + (at[pick[of]] >> 12) + length
                yield out([w[pick[of]] for w in who], start, end)

        held: list = []  # unsettled rows of whole runs, and of the run that goes on
        count, spilled = 0, None  # spilled: the gram of a run that outgrew a task
        last: tuple[bytes, int] | None = None  # the rank of the latest row, and its smallest document
        for batch in batches:
            if not batch.num_rows:
                continue
            salt, at = batch.column(1).to_numpy(), batch.column(2 + n_keys).to_numpy()
            who = [batch.column(2 + i).to_numpy() for i in range(n_keys)]
            who.append(_objects(batch.column(3 + n_keys)))
            ranks = batch.column(0)
            full = np.diff(np.frombuffer(ranks.buffers()[1], np.int32)[ranks.offset : ranks.offset + len(ranks) + 1]) > 0
            settled = ~full
            some = np.flatnonzero(full)
            rows = np.frombuffer(b"".join(ranks.take(pa.array(some)).to_pylist()), np.uint8).reshape(-1, GRAM + 2 + wide)
            if len(some):
                doc = who[0][some]
                whole = rows.view(f"V{rows.shape[1]}")[:, 0]
                differs = np.r_[last is None or rows[0].tobytes() != last[0], whole[1:] != whole[:-1]]
                head = np.flatnonzero(differs)
                least = np.full(len(some), last[1] if last and not differs[0] else doc[0])
                if len(head):
                    least[head[0] :] = np.repeat(doc[head], np.diff(np.r_[head, len(some)]))
                last = rows[-1].tobytes(), int(least[-1])
                settled[some] = doc > least
                fresh = doc <= least
                apart = fresh & (salt[some] != 0)
                pick = some[apart]
                yield out([w[pick] for w in who], at[pick] >> 12, (at[pick] >> 12) + (at[pick] & 63), rows[apart][:, GRAM + 2 :])
                rows, pick = rows[fresh & ~apart], some[fresh & ~apart]
                held.append((rows, [w[pick] for w in who], at[pick]))
                count += len(rows)
            gone = np.flatnonzero(settled)
            yield out([w[gone] for w in who], at[gone] >> 12, (at[gone] >> 12) + (at[gone] & 63) + length)
            if count >= most_in_run:
                rows = np.concatenate([h[0] for h in held])
                whos, ats = [np.concatenate([h[1][i] for h in held]) for i in range(n_keys + 1)], np.concatenate([h[2] for h in held])
                gram = np.ascontiguousarray(rows[:, :GRAM]).view(f"V{GRAM}")[:, 0]
                going = int(np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])[-1])
                begin = 0
                if spilled is not None:  # the rest of that run follows it
                    other = np.flatnonzero(gram != spilled)
                    begin = int(other[0]) if len(other) else len(rows)
                    yield out([w[:begin] for w in whos], ats[:begin] >> 12, (ats[:begin] >> 12) + (ats[:begin] & 63), rows[:begin, GRAM + 2 :])
                    if begin < len(rows):
                        spilled = None
                if begin < going:
                    yield from compare(rows[begin:going], [w[begin:going] for w in whos], ats[begin:going])
                going = max(begin, going)
                if len(rows) - going >= most_in_run:
                    spilled = gram[-1]
                    yield out([w[going:] for w in whos], ats[going:] >> 12, (ats[going:] >> 12) + (ats[going:] & 63), rows[going:, GRAM + 2 :])
                    going = len(rows)
                held = [(rows[going:], [w[going:] for w in whos], ats[going:])]
                count = len(rows) - going
        if held:
            rows = np.concatenate([h[0] for h in held])
            whos, ats = [np.concatenate([h[1][i] for h in held]) for i in range(n_keys + 1)], np.concatenate([h[2] for h in held])
            begin = 0
            if spilled is not None and len(rows):
                gram = np.ascontiguousarray(rows[:, :GRAM]).view(f"V{GRAM}")[:, 0]
                other = np.flatnonzero(gram != spilled)
                begin = int(other[0]) if len(other) else len(rows)
                yield out([w[:begin] for w in whos], ats[:begin] >> 12, (ats[:begin] >> 12) + (ats[:begin] & 63), rows[:begin, GRAM + 2 :])
            if begin < len(rows):
                yield from compare(rows[begin:], [w[begin:] for w in whos], ats[begin:])

    gathered = found.where("at is not null").groupBy(*keys).agg(F.collect_list("at").alias("positions"))
    gathered = gathered.join(copies, keys, "left_anti")
    ranked = with_rows(gathered, "positions", "inner").select("doc_id", "text_key", "text", "positions")
    ranked = ranked.mapInArrow(contexts, f"rank binary, salt long, {key_type}, at long, more array<long>")
    by_gram: Column = F.substring("rank", 1, GRAM)
    ranked = ranked.repartition(by_gram, "salt").sortWithinPartitions("rank", "doc_id")
    spans = written(ranked.mapInArrow(judged, f"{key_type}, start long, end long, more array<long>, context binary"), "judged")
    release(spark)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of contexts; those that a smaller document of the batch has too are settled, and empty."""
        for batch in batches:
            n, at = batch.num_rows, len(keys)
            if not n:
                continue
            first, last = batch.column(at).to_numpy(), batch.column(at + 1).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(at + 3).to_pylist()), np.uint8).reshape(n, wide)
            of, place, windows = _windows(rows, last - first, length)
            who = [batch.column(i).to_numpy()[of] for i in range(at)]
            more = pa.array(_objects(batch.column(at + 2))[of].tolist(), shifts)
            late = _later(_codes(windows), who[0])
            values = [b"" if x else v for v, x in zip(_binary(windows).to_pylist(), late.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.binary()), *(pa.array(w) for w in who), pa.array(first[of] + place), more], ["window", *keys, "start", "more"]
            )

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, least = None, 0
        for batch in batches:
            late = []
            for value, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value and value != window:
                    window, least = value, doc
                late.append(not value or doc > least)
            found = batch.filter(pa.array(late, pa.bool_()))
            start = found.column(1 + len(keys))
            end = pa.array(start.to_numpy() + length)
            yield pa.RecordBatch.from_arrays([*found.columns[1:-1], end, found.columns[-1]], [*keys, "start", "end", "more"])

    open_ = spans.where("context is not null")
    spans_type = f"{key_type}, start long, end long, more array<long>"
    removed = spans.where("context is null").select(*keys, "start", "end", "more")
    if not open_.isEmpty():
        windows = open_.mapInArrow(exploded, f"window binary, {key_type}, start long, more array<long>")
        apart = F.when(F.length("window") == 0, F.xxhash64("doc_id", "start"))
        windows = windows.repartition("window", apart).sortWithinPartitions("window", "doc_id")
        removed = removed.unionByName(written(windows.mapInArrow(repeated, spans_type), "windows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for i, data in enumerate(as_bytes(batch.column(1))):
                sizes.append(len(data))
                starts, ends = (batch.column(c)[i].values for c in (2, 3))
                if starts is None or not len(starts):
                    spans.append([])
                    kept.append(data)
                    continue
                order = np.argsort(starts.to_numpy())
                starts, ends = starts.to_numpy()[order], np.maximum.accumulate(ends.to_numpy()[order])
                head = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
                starts, ends = starts[head].tolist(), ends[np.r_[head[1:], len(ends)] - 1].tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(starts, ends, strict=True)])
                kept.append(b"".join([data[s:e] for s, e in zip([0, *ends], [*starts, len(data)], strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    shifted = removed.where("more is not null").withColumn("shift", F.explode("more"))
    removed = removed.drop("more").unionByName(shifted.select(*keys, (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end")))
    whole = copies.where(f"n >= {length}").select(*keys, F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    removed = removed.unionByName(whole)
    per_document = removed.groupBy(*keys).agg(F.struct(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")).alias("marks"))
    return (
        with_rows(per_document, "marks", "left")
        .select("doc_id", "text", "marks.starts", "marks.ends")
        .mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    )
