"""Brute-force versions of the corpus queries' results, over lists of rows: plain, quadratic, on whole texts."""

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=13):
    wanted = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            wanted[tuple(words[i : i + size])].add(item)
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[w]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(docs, size=3, percent=85):
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least[root(i)], d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs)]


def luhn(s):
    digits = [int(c) for c in reversed(s)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]
            if fits():
                out.append((kind, m.start(), m.end()))
    return out


def repeated(docs, length=50):
    """(doc, bytes, removed, spans, sha256 of the rest); docs with distinct ids."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, x in sorted(data):
        for i in range(len(x) - length + 1):
            first.setdefault(x[i : i + length], d)
    out = []
    for d, x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def captures(pages):
    first = {}
    for page, html in pages:
        x = (html or "").encode()
        first[x] = min(first.get(x, page), page)
    out = []
    for page, html in pages:
        x = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(x).digest()).decode()
        out.append((page, len(x), digest, "response" if first[x] == page else "revisit", None if first[x] == page else first[x]))
    return out


def top(vectors, every, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted(((-int(q @ c), j) for j, c in ok if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def check_packing(pieces, docs, ids_of, capacity=4096):
    """Pieces (doc, start, length, crc, doc tokens, sequence, offset) hold each id once; sequences have no gaps. Padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
    for doc, text in docs:
        ids = np.array(ids_of(text), "<u4")
        at = 0
        for _, start, length, crc, n, _, _ in sorted(by_doc.pop(doc), key=lambda p: p[1]):
            assert start == at and length > 0 and n == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding


def crc_held_out(doc, folds=5):
    return zlib.crc32(str(doc).encode()) % folds == 0
