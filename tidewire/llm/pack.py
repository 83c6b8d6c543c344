"""Packing documents into fixed-length sequences by harmonic classes.

A piece of L tokens belongs to the class with reciprocal capacity k = capacity // L, the lengths in
(capacity / (k + 1), capacity / k], and a bin of that class takes exactly k pieces. Each worker fills bins of its own, class
by class, as its documents come. A document is cut so that classes fill their bins well: into whole sequences, then pieces of
capacity // k for the smallest k that fits, down to `least` tokens, then one shorter tail, of whose class each bin is short
by less than capacity / (k + 1). At its end a worker lays what its unfilled bins hold into shared bins, longest pieces first.

Workers need nothing of each other but how many bins the earlier ones have, which numbers the sequences without gaps.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import as_documents, batches_of, written

#: Characters beyond these take the library's own path: here lower-casing, NFC and white space are plain.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")
#: The words kept between batches, at most.
_CACHED = 500_000
_STOPS = ".,!?;:"
#: No plain text has it.
_MARK = "\x01"
#: What a tokenizer file must do before its merges for words to be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_words(path: str) -> bool:
    """Whether the tokenizer file lower-cases, splits at white space, and splits runs of letters from all else."""
    parts = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = [parts[c] or {} for c in ("normalizer", "pre_tokenizer")]
    first = (steps[1].get("pretokenizers") or [{}])[0]
    return steps[0].get("normalizers") == _NORMALIZERS and first.get("pattern") == {"Regex": _SPLIT} and first.get("invert") is True and parts["model"]["type"] == "BPE"


@lru_cache(maxsize=1)  # tasks of a worker follow each other and share what it has learned
def word_encoder(path: str, end_id: int | None) -> Callable[[list[str]], Iterator[bytes]]:
    """Token ids of texts, little-endian unsigned 32-bit, as the tokenizer file gives them; end_id follows each text.

    If the file splits words as word_bpe_49k.json does, the ids of a text are those of its words, and words that were
    seen before need no second encoding. Texts with special strings or unusual characters go whole, and so do all texts
    with any other file.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    known: dict[str, bytes] = {}
    one = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
    mark = one(_MARK)
    by_words = len(mark) == 1 and splits_words(path)
    model = tokenizer.model

    def learn(words: list[str]) -> dict[str, bytes]:
        """Ids of words: of plain letters, by the merges alone; others side by side, a mark between them that is a token."""
        letters = [w for w in words if w.isascii() and w.isalpha()]
        found = {w: np.array([t.id for t in model.tokenize(w)], "<u4").tobytes() for w in letters}
        others = [w for w in words if w not in found]
        for i in range(0, len(others), 20_000):
            some = others[i : i + 20_000]
            ids = one(f" {_MARK} ".join(some))
            ends = np.flatnonzero(ids == mark[0])
            data, at = ids.tobytes(), 0
            for w, end in zip(some, [*(4 * ends).tolist(), len(data)], strict=True):
                found[w] = data[at:end]
                at = end + 4
        return found

    def encode(texts: list[str]) -> Iterator[bytes]:
        for group in batches_of(texts, [len(t) for t in texts], 8_000_000):
            plain = [by_words and bool(_PLAIN.fullmatch(t)) and not any(s in t for s in special) for t in group]
            split = [unicodedata.normalize("NFC", t).lower().split() if p else [] for t, p in zip(group, plain, strict=True)]
            new = list(set().union(*split) - known.keys())
            # A word with stops behind it is the word and one token run of stops: fewer words to learn.
            stems = [w.rstrip(_STOPS) for w in new]
            stems = [m if m and m[-1].isalnum() else w for m, w in zip(stems, new, strict=True)]
            tails = [w[len(m) :] for m, w in zip(stems, new, strict=True)]
            now = learn(list({*stems, *tails} - known.keys() - {""}))
            now[""] = b""
            known.update(now)
            for w, m, t in zip(new, stems, tails, strict=True):
                known[w] = known[m] + known[t]
            for text, p, words in zip(group, plain, split, strict=True):
                yield (b"".join([known[w] for w in words]) if p else one(text).tobytes()) + end
            if len(known) > _CACHED:  # the earliest are the most frequent, by and large
                for w in list(known)[_CACHED:]:
                    del known[w]

    return encode


def pieces_of(n: int, capacity: int, least: int) -> list[int]:
    """Lengths into which n tokens are cut: whole sequences, then the largest capacity // k that fits, then a tail of `least` at most."""
    lengths = [capacity] * (n // capacity)
    n %= capacity
    while n > max(least, 1):
        lengths.append(capacity // -(-capacity // n))
        n -= lengths[-1]
    return lengths + [n] * (n > 0)


class Bins:
    """One worker's bins: of each class, one that is open; full ones leave with a number."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.full, self.open = capacity, 0, {}

    def put(self, length: int, row: tuple) -> list[tuple]:
        """The rows (row, bin, offset) of the bin that this piece fills; none while it is open."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((length, row))
        if len(held) < k:
            return []
        del self.open[k]
        return self._close(held)

    def _close(self, held: list[tuple]) -> list[tuple]:
        at, out = 0, []
        for length, row in held:
            out.append((row, self.full, at))
            at += length
        self.full += 1
        return out

    def rest(self) -> list[tuple]:
        """What open bins hold, at most k pieces of class k: each piece into the first shared bin with room, longest first."""
        left = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[0])
        room, shared = np.full(len(self.open) + 1, self.capacity), [[] for _ in range(len(self.open) + 1)]
        for length, row in left:
            i = int(np.argmax(room >= length))
            room[i] -= length
            shared[i].append((length, row))
        self.open = {}
        return [x for held in shared if held for x in self._close(held)]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    least: int = 256,
    end_id: int | None = 2,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of a document, its end id included, lies in exactly one piece; the pieces of a sequence lie side by side
    from offset 0. A null or empty text has its end id alone. Repeated rows are packed each for itself; null doc_ids are
    kept. An empty table gives no rows. Texts are read whole; other columns are ignored.

    A full bin of class k is short by less than capacity / (k + 1); only tails, whose k is capacity / least or more, are
    short by more than k - 1 tokens. Of each worker's shared bins all but the last few are as good as full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path, end_id)
        worker, bins = TaskContext.get().partitionId(), Bins(capacity)

        def out(placed: list[tuple]) -> pa.RecordBatch:
            columns = zip(*((*row, bin_, at) for row, bin_, at in placed), strict=True) if placed else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array([worker] * len(placed), pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset", "worker"]
            )

        for batch in batches:
            placed: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                start, n = 0, len(ids) // 4
                for length in pieces_of(n, capacity, least):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    placed += bins.put(length, (doc, start, length, crc, n))
                    start += length
            yield out(placed)
        yield out(bins.rest())

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long, worker long"
    pieces = written(as_documents(docs, id_col, text_col).mapInArrow(cut, schema), "pieces")
    # A row for each task of the step above, two numbers each: no more than the driver keeps of a task anyway.
    before = Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    bins = pieces.groupBy("worker").agg((F.max("bin") + 1).alias("n"))
    bins = bins.select("worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(bins), "worker").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("bin")).alias("sequence_id"), "offset"
    )
