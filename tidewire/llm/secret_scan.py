"""Secrets by patterns and by token efficiency.

A vocabulary learned from ordinary text spends few tokens on what people write and many on random strings. Runs of key
characters whose characters per token fall below a limit are reported, unless they are digests or identifiers by their
shape. Three exact patterns (assigned values, access key ids, hexadecimal runs) are always reported.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_documents

#: In this order kinds are listed at one start; the first three are exact patterns, the last comes from token efficiency.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
_RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")  # the runs of 16 and more among the matches of [0-9a-f]+
_RUN = re.compile("[A-Za-z0-9+/_=-]+")
_PART = re.compile("[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Za-z]|[0-9]+")

#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST = re.compile("(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I | re.A)
_LABELLED = re.compile("(?:md5|sha(?:1|224|256|384|512))[-=/_].*", re.I | re.A)
_BASE32 = re.compile("[A-Z2-7]{32}")
_UUID = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
_PIECE = 256


@functools.cache
def _encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks: one for each worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_digest(run: str) -> bool:
    """Whether the run has the shape of a digest or a universal identifier."""
    return any(p.fullmatch(run) for p in (_DIGEST, _BASE32, _UUID, _LABELLED))


def is_identifier(run: str, per_token) -> bool:
    """Whether the run is put together from words: at least half its letters lie in parts of three or more that encode well.

    Parts are split at case changes, digits and separators. Runs without both letters and digits, or of one case's
    letters with separators alone, are words or numbers.
    """
    letters, digits = sum(c.isalpha() for c in run), any(c.isdigit() for c in run)
    if not letters or (not digits and (run == run.lower() or run == run.upper())):
        return True
    words = [p for p in _PART.findall(run) if len(p) >= 3 and p.isalpha()]
    return 2 * sum(len(w) for w in words if per_token(w) >= 2.5) >= letters


def spans_of(text: str, per_token, least: int, limit: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as listed."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    known = sorted((s, e) for _, s, e in spans)
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if end - start < least:
            continue
        while at < len(known) and known[at][1] <= start:
            at += 1
        if any(e > start for _, e in takewhile(lambda k: k[0] < end, islice(known, at, None))):
            continue
        run = m[0]
        if not is_digest(run) and not is_identifier(run, per_token) and per_token(run) < limit:
            spans.append(("random", start, end))
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]]))


def find_secrets(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, limit: float = 2.0
) -> DataFrame:
    """Per row of docs: doc_id and spans (kind, start, end) by start, then kind: assign, access, hex, random.

    An assign span is the whole match, its value at least 12 characters; access spans have 18 and more, hex spans 16 and
    more. Matches of one kind are leftmost and do not overlap; those that fail are dropped and not tried again. A random
    span is a maximal run of letters, digits and +/_=- with at least `least` characters and fewer than `limit` characters
    a token, which overlaps no span of the patterns and is neither digest nor identifier. Runs are encoded in pieces of
    256 characters, so that their cost grows with their length.

    Null texts are empty and have no spans. Repeated rows and null doc_ids are kept, each with its own result. An empty
    table gives no rows. Texts are read whole; other columns are ignored. ranks_path, pattern: a tiktoken vocabulary and
    the pattern that splits text before its merges.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)

        @functools.lru_cache(50_000)
        def per_token(run: str) -> float:
            return len(run) / sum(len(encoding.encode_ordinary(run[i : i + _PIECE])) for i in range(0, len(run), _PIECE))

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [spans_of(t or "", per_token, least, limit) for t in batch.column(1).to_pylist()]
            listed = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], ["doc_id", "spans"])

    return as_documents(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
