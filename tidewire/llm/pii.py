"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, a plus before a digit, digits around a dot, digits, URL schemes and
cues of accounts. From each anchor a deterministic parser expands to the left and right and validates what it finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_documents

#: In this order spans are listed; the first four are exact patterns, the rest comes from schemes and cues.
KINDS = ("email", "ip", "card", "phone", "url", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'\\^`{|}]+")
_VALUE = re.compile(r"[ \t]{0,3}(?:[:=#]|is\b|no\.?|number\b)?[ \t]{0,3}([A-Za-z0-9][A-Za-z0-9_+/=-]{5,})")

#: Schemes whose addresses name a person's page or mailbox only if they carry user data.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
#: Words after which an identifier of an account or a secret follows; letter case does not matter.
CUES = ("password", "passwd", "api_key", "apikey", "api-key", "secret", "token", "iban", "account", "ssn", "passport", "username", "user_id")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for a in "0123456789":
        found.add_word("+" + a, ("phone", 2))
        found.add_word(a, ("digits", 1))
    for s in SCHEMES:
        found.add_word(s, ("url", len(s)))
    for c in CUES:
        found.add_word(c, ("account", len(c)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as listed and start.

    Of each base kind, matches are the leftmost that do not overlap, as its pattern gives them; those that fail a check
    are dropped, and their characters are not tried again for that kind.
    """
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    if len(low) != len(text):  # a capital I with a dot becomes two characters
        low = "".join([c.lower() if c < "\x80" else c for c in text])
    end = dict.fromkeys((*KINDS, "digits"), 0)
    for last, (kind, size) in automaton.iter(low):
        start = last - size + 1
        if kind == "email":
            left = start
            while left > end["email"] and text[left - 1] in _LOCAL_CHARS:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, start + 1)):
                spans.append(("email", left, m.end()))
                end["email"] = m.end()
        elif kind == "phone":
            if start >= end["phone"] and (m := _PHONE.match(text, start + 2)):
                end["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in text[start : m.end()] if c < "\x80") <= 15:
                    spans.append(("phone", start, m.end()))
        elif kind == "digits":
            if start >= end["card"]:
                m = _DIGITS.match(text, start)
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", start, m.end()))
            if start >= end["digits"]:
                m = _DOTTED.match(text, start)
                end["digits"] = m.end()
                if m[0].count(".") >= 3:
                    at, parts = start, m[0].split(".")
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        stop = at + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                            spans.append(("ip", at, stop))
                        at = stop + 1
        elif kind == "url":
            if start >= end["url"] and (m := _URL.match(text, last + 1)):
                stop = m.end()
                while stop > last + 1 and text[stop - 1] in ".,;:!?)]":
                    stop -= 1
                end["url"] = m.end()
                if "@" in text[start:stop] or text[start:stop].lower().startswith("tel:"):
                    spans.append(("url", start, stop))
        elif start >= end["account"] and not (start and (low[start - 1].isalnum() or low[start - 1] == "_")):
            if (m := _VALUE.match(text, last + 1)) and re.search("[0-9]", m[1]):
                spans.append(("account", m.start(1), m.end(1)))
                end["account"] = m.end(1)
    return sorted(spans, key=lambda s: (_RANK[s[0]], s[1]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch covered by spans replaced by the kind of the first span in it."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, spans (kind, start, end) and the text with its spans replaced by [KIND].

    Null texts are empty: no spans, an empty text. Repeated rows and null doc_ids are kept, each with its own result. An
    empty table gives no rows. Texts are read whole; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [spans_of(t, automaton) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind),
                    pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()),
                ],
                ["doc_id", "spans", "text"],
            )

    return as_documents(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>, text string")


def count(spans: str, kind: str):
    """A column: how many spans of this kind there are."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: str, kinds: tuple[str, ...] | None = None):
    """A column: kind:start:end of the spans of these kinds, comma-joined."""
    listed = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs as they are, with the spans of the text column replaced by [KIND]; a null text stays null."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, spans_of(t, automaton)) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(replace, docs.schema)
