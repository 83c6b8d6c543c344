"""Text and URL columns: HTML to text, clean URLs, hosts, normal forms, tokens, sentences, dates of pages."""

from __future__ import annotations

import contextlib
import functools
import json
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import catalog, lexicons

#: A word boundary between ASCII word characters and all else, wherever the text is not ASCII too.
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def pattern(source: str) -> str:
    """A pattern of the lexicons for rlike: any letter case, ASCII word boundaries."""
    return "(?iu)" + source.replace(r"\b", _BOUNDARY)


def needed(source: str) -> tuple[str, ...] | None:
    """Strings one of which every match of a lexicon's pattern contains, in lower case; None where that cannot be told."""
    branches, depth, start = [], 0, 0
    for i, c in enumerate(source):
        if c == "|" and depth == 0:
            branches.append(source[start:i])
            start = i + 1
        elif c in "()" and source[i - 1 : i] != "\\":
            depth += 1 if c == "(" else -1
    found = []
    for branch in [*branches, source[start:]]:
        runs, run, i = [], "", 0
        while i < len(branch):
            c = branch[i]
            if c in "([":  # what stands in brackets may be absent or vary
                close, depth = {"(": ")", "[": "]"}[c], 0
                while i < len(branch):
                    depth += (branch[i] == c) - (branch[i] == close)
                    if depth == 0:
                        break
                    i += 1
                runs, run = [*runs, run], ""
            elif c == "\\":
                runs, run = [*runs, run], ""
                i += 1
            elif c in "?*{":
                runs, run = [*runs, run[:-1]], ""
                i = branch.find("}", i) if c == "{" else i
            elif c in ".+^$|":
                runs, run = [*runs, run], ""
            else:
                run += c
            i += 1
        best = max([*runs, run], key=len)
        if len(best) < 2:
            return None
        found.append(best.lower())
    return tuple(dict.fromkeys(found))


#: At most so many strings are spelled out for a stretch of a pattern.
_SPELLINGS = 64


def _spelled(source: str) -> tuple[set[str] | None, set[str] | None]:
    """(all, some) of a pattern's text: every string that it matches where those are few, and strings one of which every match
    contains; None where that cannot be told."""
    branches, depth, start = [], 0, 0
    for i, c in enumerate(source):
        escaped = (len(source[:i]) - len(source[:i].rstrip("\\"))) % 2
        if c == "|" and depth == 0:
            branches.append(source[start:i])
            start = i + 1
        elif c in "()" and not escaped:
            depth += 1 if c == "(" else -1
    found = [_spelled_branch(b) for b in [*branches, source[start:]]]
    whole = None if any(w is None for w, _ in found) else set().union(*(w for w, _ in found))
    some = None if any(x is None for _, x in found) else set().union(*(x for _, x in found))
    return (whole if whole is None or len(whole) <= _SPELLINGS else None), some


def _spelled_branch(branch: str) -> tuple[set[str] | None, set[str] | None]:
    some: list[set[str]] = []
    run, finite, i = {""}, True, 0
    while i < len(branch):
        c, inner = branch[i], None
        if c == "(":
            depth, j = 0, i
            while True:
                depth += (branch[j] == "(") - (branch[j] == ")") if branch[j - 1] != "\\" else 0
                if depth == 0:
                    break
                j += 1
            body = branch[i + 1 : j]
            own, inner = ({""}, None) if body.startswith(("?=", "?!", "?<")) else _spelled(body.removeprefix("?:"))
            i = j + 1
        elif c == "[":
            own, i = None, branch.index("]", i + 1) + 1
        elif c == "\\":
            own = {""} if branch[i + 1] == "b" else None if branch[i + 1].isalnum() else {branch[i + 1]}
            i += 2
        else:
            own, i = None if c in ".^$" else {c}, i + 1
        optional = False
        if i < len(branch) and branch[i] in "?*+{":
            least = re.match(r"\{(\d+)", branch[i:])
            optional = branch[i] in "?*" or (least is not None and least[1] == "0")
            own = own | {""} if own is not None and branch[i] == "?" else None
            i = branch.index("}", i) + 1 if branch[i] == "{" else i + 1
        if inner is not None and not optional:
            some.append(inner)
        if own is None or len(run) * len(own) > _SPELLINGS:
            some.append(run)
            run, finite = (set(own), False) if own is not None else ({""}, False)
        else:
            run = {a + b for a in run for b in own}
    some.append(run)
    least = lambda strings: min((len(x) * (1 if x.isascii() else 2) for x in strings), default=0)
    best = max(some, key=least)
    return (run if finite else None), (best if least(best) >= 2 else None)


@functools.cache
def required(source: str) -> tuple[str, ...] | None:
    """needed(), and where that cannot be told, what the alternatives in brackets and optional letters of the pattern spell out."""
    found = needed(source)
    if found is None and (some := _spelled(source)[1]) is not None:
        low = {x.lower() for x in some}
        found = tuple(sorted(x for x in low if not any(y != x and y in x for y in low)))
    return found


#: Letters that patterns in any case take for s, i and k.
_ALIKE = (("ſ", "s"), ("İ", "i"), ("ı", "i"), ("\u212a", "k"))


def _fold(text: str) -> str:
    """folded(), in a worker."""
    if not text.isascii():
        for a, b in _ALIKE:
            text = text.replace(a, b)
    return text.lower()


def folded(text: Column) -> Column:
    """Lower case, with the letters that patterns in any case take for s, i and k."""
    return F.lower(F.translate(text, "ſİıK", "siik"))


def folded_pattern(source: str) -> str:
    """A lexicon's pattern for folded() text: letters in lower case, and boundaries that look to the one side that matters.

    A boundary before a word needs no word character before it, one behind a word none behind it; others look both ways.
    """
    out, i = "", 0
    word = lambda c: c.isascii() and c.isalnum()
    while i < len(source):
        if source[i] != "\\":
            out += source[i].lower()
            i += 1
            continue
        if source[i + 1] == "b":
            before, after = source[i - 1 : i] if i else "", source[i + 2 : i + 3]
            behind = before != "" and (word(before) or before in ")]?")
            ahead = after != "" and (word(after) or after in "([")
            if ahead and not behind and word(after) and source[i + 3 : i + 4] not in ("?", "*", "{"):
                out += f"{after.lower()}(?<![a-z0-9_]{after.lower()})"  # the letter first: it is what texts are searched for
                i += 3
                continue
            out += r"(?![a-z0-9_])" if behind and not (after and word(after)) else r"(?<![a-z0-9_])" if ahead and not behind else _BOUNDARY
        else:
            out += source[i : i + 2]
        i += 2
    return out


class _Finder:
    """Lexicons' patterns for folded texts. One pass finds the strings that patterns need; only those that got theirs are tried."""

    def __init__(self, *lexicons_: tuple[tuple[str, str], ...]):
        both = [(k, label, p) for k, lexicon in enumerate(lexicons_) for label, p in lexicon]
        self.size, self.of, self.labels = len(lexicons_), [k for k, _, _ in both], [label for _, label, _ in both]
        self.patterns = [re.compile(folded_pattern(p), re.ASCII) for _, _, p in both]
        self.always = {i for i, (_, _, p) in enumerate(both) if required(p) is None}
        owners: dict[str, set[int]] = {}
        for i, (_, _, p) in enumerate(both):
            for s in required(p) or ():
                owners.setdefault(s, set()).add(i)
        self.strings = ahocorasick.Automaton()
        for s, own in owners.items():
            self.strings.add_word(s, own)
        self.strings.make_automaton()
        self.has_strings = bool(owners)

    def tried(self, text: str) -> list[int]:
        found = set(self.always)
        if self.has_strings:
            found.update(*(own for _, own in self.strings.iter(text)))
        return sorted(found)

    def matches(self, text: str) -> list[tuple[int, re.Match]]:
        """The patterns that match, in order, by number over all lexicons."""
        return [(i, m) for i in self.tried(text) if (m := self.patterns[i].search(text))] if text else []

    def all(self, text: str | None) -> list[str]:
        return [self.labels[i] for i, _ in self.matches(text or "")]

    def first(self, text: str | None) -> str | None:
        places = [(m.start(), i) for i, m in self.matches(text or "")]
        return self.labels[min(places)[1]] if places else None


@functools.cache
def _finder(*lexicons_: tuple[tuple[str, str], ...]) -> _Finder:
    """The finder of lexicons: built once in each worker process."""
    return _Finder(*lexicons_)


def hits(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """Labels of the lexicon that occur in the text, in the lexicon's order; none for null.

    Texts go through in batches: some 160 patterns as columns would make plans that take longer to compile than to run, and each
    of them would pass over the text on its own. Few patterns are columns, so that no Python worker has to run for them.
    """
    own = tuple(map(tuple, lexicon))
    strings = {s for _, p in own for s in required(p) or ("",)}
    if "" not in strings and len(strings) <= _FEW:
        return _few_hits(text, own)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def labels(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _finder(own).all(_fold(x)) if x else [])

    return labels(text)


#: Lexicons with so many strings at most are few patterns, which Spark tries itself.
_FEW = 16


def _few_hits(text: Column, lexicon: tuple[tuple[str, str], ...]) -> Column:
    """hits() without Python: few strings tell which texts a pattern is tried on at all. (?d): lines end at line feeds only, as in Python."""
    spelled = lambda low, p: functools.reduce(operator.or_, (F.contains(low, F.lit(s)) for s in required(p)))
    found = lambda low: [F.when(spelled(low, p) & low.rlike("(?d)" + folded_pattern(p)), label) for label, p in lexicon]
    odd = lambda x: functools.reduce(operator.or_, (F.contains(x, F.lit(a)) for a, _ in _ALIKE))
    low = bound(text, lambda x: F.when(odd(x), folded(x)).otherwise(F.lower(x)))  # few texts need the slower way
    return bound(low, lambda low: F.filter(F.array(*found(low)), lambda x: x.isNotNull()))


def occurring(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of these terms, which are in lower case, the text has in any case; none for null."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: len({t for _, t in _terms(terms).iter(x.lower())}) if x else 0).astype("int32")

    return count(text) if terms else F.lit(0)


@functools.cache
def _terms(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    found.make_automaton()
    return found


#: Named character references and what they stand for; others become a space.
_NAMED = [
    (r"&(?:nbsp|ensp|emsp);", " "), (r"&amp;", "&"), (r"&quot;", '"'), (r"&apos;", "'"), (r"&(?:hellip|mldr);", "…"),
    (r"&(?:ldquo|rdquo);", "“"), (r"&(?:lsquo|rsquo);", "’"), (r"&(?:mdash|ndash);", "—"), (r"&[a-z][a-z0-9]+;", " "),
]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, however often f refers to it: a plan holds a column as often as it is named."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _referred(text: Column, digits: str, base: int) -> Column:
    """The text with the characters that its numeric references stand for, one at a time between the pieces of text."""
    pieces, codes = F.split(text, digits, -1), F.regexp_extract_all(text, F.lit(digits), F.lit(1))
    number = lambda c: F.conv(c, base, 10).cast("int")
    letter = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    chars = F.transform(codes, lambda c: bound(number(c), letter))
    joined = F.zip_with(pieces, F.concat(chars, F.array(F.lit(""))), lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return F.when(F.contains(text, F.lit("&#")), F.array_join(joined, "")).otherwise(text)


def strip_html(html: Column) -> Column:
    """The text of HTML: without comments, navigation, styles, scripts and tags; null is empty.

    What begins with < or & is looked for only in texts that have one.
    """
    blocks = "nav|header|footer|aside|form|svg|noscript"
    removed = [r"<!--[\s\S]*?-->", rf"(?i)<(?:{blocks})\b[\s\S]*?</(?:{blocks})>", r"(?i)<style[\s\S]*?</style>", r"(?i)<script[\s\S]*?</script>", r"<[^>]+>"]

    def untagged(text: Column) -> Column:
        out = text
        for p in removed:
            out = F.regexp_replace(out, p, " ")
        return F.when(F.contains(text, F.lit("<")), out).otherwise(text)

    def named(text: Column) -> Column:
        out = text
        for digits, base in ((r"&#[xX]([0-9a-fA-F]{1,6});", 16), (r"&#([0-9]{1,7});", 10)):
            out = bound(out, lambda t: _referred(t, digits, base))  # noqa: B023
        for p, value in _NAMED:
            out = F.regexp_replace(out, "(?i)" + p, value)
        return F.when(F.contains(text, F.lit("&")), out).otherwise(text)

    text = bound(bound(F.coalesce(html, F.lit("")), untagged), named)
    # Runs of white space, control and replacement characters become a space; most texts have line ends and no more of them.
    gap = r"\x00-\x1F\x7F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFFFD"  # white space is as in (?U)\s
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    text = bound(lines, lambda t: F.when(t.rlike(f"[{gap}]|  "), F.regexp_replace(t, f"[{gap} ]+", " ")).otherwise(t))
    doubled = lambda t: functools.reduce(operator.or_, (F.contains(t, F.lit(c + c)) for c in "\"'“”‘’"))
    text = bound(text, lambda t: F.when(doubled(t), F.regexp_replace(t, "([\"'“”‘’])\\1+", "$1")).otherwise(t))
    return F.trim(text)


def clean_url(url: Column) -> Column:
    """Without fragment, tracking parameters and one last slash; what is no URL is trimmed."""
    bare = F.substring_index(url, "#", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(?:utm_[^=]*|ref|source|rss)(?:=|$)") & (p != ""))
    base = F.substring_index(bare, "?", 1)
    parts = F.concat(F.lower(F.regexp_extract(base, "^([^:]+://[^/]*)", 1)), F.regexp_extract(base, "^[^:]+://[^/]*(.*)$", 1))
    whole = F.when(F.size(kept) > 0, F.concat(parts, F.lit("?"), F.array_join(kept, "&"))).otherwise(parts)
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.regexp_replace(whole, "/$", "")).otherwise(F.trim(url))


def hostname(url: Column) -> Column:
    """The host in lower case, without www and a last dot; unknown-source for what is no URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), r"\.$", "")
    return F.when(F.coalesce(host, F.lit("")) == "", "unknown-source").otherwise(host)


def of_host(host: Column, known: list[str]) -> Column:
    """Whether the host is one of these or a subdomain of one."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(suffixes, F.array(*map(F.lit, known)))


#: Anything but characters that stay as they are in compatibility normal form, and that nothing here composes with.
_UNSETTLED = r"[^\x00-\x7F\u00C0-\u00FF\u2013\u2014\u2018\u2019\u201C\u201D\u3001\u3002\u4E00-\u9FFF]"


def nfkc(text: Column) -> Column:
    """Compatibility normal form, in lower case; Spark has no function for it, so texts that it may change go through Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(_UNSETTLED), text)), F.lower(text))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x.lower()))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Compatibility normal form with letters as they are."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal_title(title: Column) -> Column:
    """For equality of titles: lower case, normal form, without punctuation, symbols and white space."""
    return F.regexp_replace(nfkc(F.coalesce(title, F.lit(""))), r"(?U)[\p{P}\p{S}\s]+", "")


def _han_bigrams(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"([\p{IsHan}]+)"), F.lit(1))
    # Characters first: a substring counts its way from the start of the text, which makes long runs quadratic.
    joined = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1)))
    pairs = lambda r: bound(F.split(r, ""), lambda c: F.when(F.size(c) < 2, c).otherwise(joined(c)))
    return F.flatten(F.transform(runs, pairs))


#: The marks that count as Han characters, and their class, by which they go before or behind other marks.
_HAN_MARKS, _HAN_CLASS = "\U00016ff0\U00016ff1", 6


@functools.cache
def _token_tables() -> tuple[str, str, dict[str, str], list[tuple[str, str, str]], dict[str, int]]:
    """What normal form has to do with tokens: characters that become another one and those, characters that become several,
    for each class of marks with which letters compose, patterns of the other marks, of those marks, and of a letter with one
    that it composes with, and the class of each mark.

    Of the marks behind a letter, the first of each class composes with it or bars the others of its class.
    """
    marks = {c: k for c in map(chr, range(0x300, 0x20000)) if (k := unicodedata.combining(c))}
    plain = lambda c: c in marks or "a" <= c <= "z" or "0" <= c <= "9" or unicodedata.name(c, "").startswith(("CJK", "IDEOGRAPHIC"))
    forms = {c: n for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if (n := unicodedata.normalize("NFKC", c)) != c and any(map(plain, n))}
    one = {c: n for c, n in forms.items() if len(n) == 1}
    composed_ = []
    for k in sorted(set(marks.values())):
        own = [c for c in marks if marks[c] == k]
        fits = {x: fit for x in "abcdefghijklmnopqrstuvwxyz0123456789" if (fit := "".join(c for c in own if len(unicodedata.normalize("NFC", x + c)) == 1))}
        if fits:
            both = "|".join(f"{x}[{_ranges(fit)}]" for x, fit in fits.items())
            composed_.append((f"[{_ranges(''.join(c for c in marks if marks[c] != k))}]", f"[{_ranges(''.join(own))}]", both))
    return "".join(one), "".join(one.values()), {c: n for c, n in forms.items() if len(n) > 1}, composed_, marks


def _ranges(characters: str) -> str:
    """The inside of a pattern's brackets for these characters."""
    codes = sorted(map(ord, characters))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


def _plain_letters(text: Column) -> Column:
    """A text that has the tokens of nfkc(), and other characters between them, without Python."""
    before, after, several, marked, marks = _token_tables()
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{n}" for c, n in several.items())), F.lit("\x01"), F.lit("\x02"))
    kind = f"[{_ranges(''.join(several))}]"
    letters = lambda t: F.transform(F.split(t, ""), lambda c: F.when(c.rlike(kind), F.try_element_at(table, c)).otherwise(c))
    spelled = lambda t: F.when(t.rlike(kind), F.array_join(letters(t), "")).otherwise(t)
    early, late = (_ranges("".join(c for c in marks if f(marks[c]))) for f in (lambda k: k < _HAN_CLASS, lambda k: k > _HAN_CLASS))

    def in_order(run: Column) -> Column:
        return F.concat(F.regexp_replace(run, f"[^{early}]", ""), F.regexp_replace(run, f"[{early}{late}]", ""), F.regexp_replace(run, f"[^{late}]", ""))

    def sorted_(t: Column) -> Column:
        runs = f"([{_ranges(''.join(marks))}]+)"
        return F.array_join(F.zip_with(F.split(t, runs, -1), F.regexp_extract_all(t, F.lit(runs), F.lit(1)), lambda x, run: F.concat(x, F.coalesce(in_order(run), F.lit("")))), "")

    ordered = lambda t: F.when(t.rlike(f"[{_HAN_MARKS}]"), sorted_(t)).otherwise(t)

    def composed_letters(t: Column) -> Column:
        for others, own, both in marked:  # the first mark of the class goes to its letter, where there are others before it
            t = F.regexp_replace(F.regexp_replace(t, f"([a-z0-9])(?={others}+({own}))", "$1$2"), both, "\u00E9")
        return t

    unmarked = lambda t: F.when(t.rlike(r"[a-z0-9][^\x00-\x7F]"), composed_letters(t)).otherwise(t)
    normal = lambda low: bound(bound(bound(F.translate(low, before, after), spelled), ordered), unmarked)
    return bound(F.lower(text), lambda low: F.when(low.rlike(_UNSETTLED), normal(low)).otherwise(low))


def title_tokens(title: Column) -> Column:
    """Distinct runs of a-z and digits, and pairs of Han characters, of the compatibility normal form in lower case."""
    tokens = lambda text: F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1)), _han_bigrams(text)))
    return bound(_plain_letters(F.coalesce(title, F.lit(""))), tokens)


def text_tokens(text: Column, stop_words: list[str]) -> Column:
    """Like title_tokens, with dots and dashes inside, two characters at least, and no stop words."""
    stops = frozenset(stop_words)

    @F.pandas_udf("words array<string>, han string")
    def words(texts: pd.Series) -> pd.DataFrame:
        """Words in their order; and the normal text where it may have Han characters, all of which lie behind the alphabets."""
        normal = [unicodedata.normalize("NFKC", x.lower()) if x else "" for x in texts]
        found = [[w for w in dict.fromkeys(_WORD.findall(x)) if w not in stops] for x in normal]
        return pd.DataFrame({"words": pd.Series(found, dtype=object), "han": pd.Series([x if not x.isascii() and max(x) >= "\u2e80" else None for x in normal], dtype=object)})

    return bound(words(text), lambda w: F.when(w["han"].isNull(), w["words"]).otherwise(F.array_distinct(F.concat(w["words"], _han_bigrams(w["han"])))))


_WORD = re.compile("[a-z0-9][a-z0-9.-]+")


def shorten(text: Column, most: int = 180) -> Column:
    """At most so many characters, an ellipsis at the end of what is cut."""
    return bound(text, lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…"))).otherwise(t))


def han_share(text: Column) -> Column:
    """Share of Han characters among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{IsHan}]", "")) / letters).otherwise(0.0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _dates_in_json(blocks: pd.Series) -> pd.Series:
    """What datePublished says in JSON texts, at any depth: of each object its own before those of its values, in order."""

    def walk(value: object) -> Iterator[str]:
        stack = [value]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if isinstance(x.get("datePublished"), str):
                    yield x["datePublished"]
                stack.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                stack.extend(reversed(x))

    def all_of(texts: list[str] | None) -> list[str]:
        found = []
        for text in [] if texts is None else texts:
            with contextlib.suppress(ValueError, RecursionError):
                found += walk(json.loads(text))
        return found

    return blocks.map(all_of)


def published_in(html: Column) -> Column:
    """When a page says it was published: its JSON-LD at any depth, its meta elements, its time elements, the first that is valid."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?i)<script\b[^>]*type\s*=\s*(["'])application/ld\+json\1[^>]*>([\s\S]*?)</script>"""), F.lit(2))
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
    form = lambda name: rf"""(?i)(?<![:\w-]){name}\s*=\s*(["'])([\s\S]*?)\1"""
    value = lambda tag, name: F.when(tag.rlike(form(name)), F.trim(F.regexp_extract(tag, form(name), 2)))
    key = lambda tag: F.lower(F.coalesce(value(tag, "property"), value(tag, "name")))
    metas = F.transform(tags("meta"), lambda tag: F.when(key(tag).isin("article:published_time", "datepublished"), value(tag, "content")))
    times = F.transform(tags("time"), lambda tag: value(tag, "datetime"))
    stated = F.transform(F.concat(_dates_in_json(blocks), metas, times), lambda v: F.try_to_timestamp(v))
    return F.try_element_at(F.filter(stated, lambda v: v.isNotNull()), F.lit(1))


def key_numbers(text: Column) -> Column:
    """Amounts of money and quantities with units, in one spelling each."""
    form = (
        r"(?i)([$€£¥￥]\s?\d[\d,.]*(?:\s?(?:trillion|billion|million|tn|bn|mn))?"
        r"|\d+(?:\.\d+)?\s?(?:%|percent|percentage points?|basis points?|bps|trillion|billion|million|亿元|亿美元|万亿元|万亿|万吨|gw|mw))"
    )
    found = F.regexp_extract_all(text, F.lit(form), F.lit(1))

    def spelled(value: Column) -> Column:
        return bound(F.trim(F.replace(F.regexp_replace(F.lower(value), r"\s+", " "), F.lit(","), F.lit(""))), spelling)

    def spelling(v: Column) -> Column:
        plain = lambda n: F.regexp_replace(n.cast("string"), r"\.0$", "")
        hundred = F.regexp_extract(v, r"^(\d+(?:\.\d+)?)亿美元$", 1)
        dollars = F.regexp_extract(v, r"^\$\s?(\d+(?:\.\d+)?)\s?(?:trillion|billion|million|tn|bn|mn)?$", 1)
        unit = F.regexp_extract(v, r"([a-z]+)$", 1)
        short = F.when(F.startswith(unit, F.lit("t")), "t").when(F.startswith(unit, F.lit("m")), "m").when(unit != "", "b").otherwise("")
        return (
            F.when(hundred != "", F.concat(F.lit("usd:"), plain(F.try_divide(hundred.try_cast("double"), F.lit(10.0))), F.lit("b")))
            .when(dollars != "", F.concat(F.lit("usd:"), plain(dollars.try_cast("double")), short))
            .otherwise(F.regexp_replace(F.regexp_replace(v, "percent", "%"), "basis points?", "bps"))
        )

    return F.array_distinct(F.transform(found, spelled))


@functools.cache
def _name_rules() -> tuple[re.Pattern, re.Pattern]:
    """Where names are, and what is none: names are ASCII, so letter case and boundaries are ASCII's."""
    return re.compile(catalog.NAME, re.ASCII), re.compile(f"{catalog.NAME_VERBS}|{catalog.GENERIC_NAME_TERMS}", re.ASCII | re.IGNORECASE)


@functools.lru_cache(200_000)
def _plain_name(name: str) -> str | None:
    """A name in lower case without dots; None for an alias, and for what is written like a name but is none."""
    plain = name.lower().replace(".", "").strip(" ")
    if plain in catalog.GENERIC_NAMES or _name_rules()[1].search(name) or _finder(tuple(map(tuple, lexicons.ENTITIES))).all(name.lower()):
        return None
    return plain


def _names_in(text: str, aliased: list[str]) -> list[str]:
    """Aliased entities and the other names of a text, each once."""
    found = (_plain_name(n) for n in dict.fromkeys(_name_rules()[0].findall(text)))
    return list(dict.fromkeys([*aliased, *(n for n in found if n is not None)]))


def named_entities(text: Column) -> Column:
    """Aliased entities, then other capitalised names of one to three words, in the order they occur.

    Texts go through in batches, like those of hits(): each name is judged once a worker, not once for every text that has it.
    """
    own = tuple(map(tuple, lexicons.ENTITIES))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def names(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _names_in(x, _finder(own).all(_fold(x))) if x else [])

    return names(text)


_LISTS = {"objects": "OBJECTS", "aliased": "ENTITIES", "locations": "LOCATIONS", "named": "ACTIONS"}
_FOUND = T.StructType([*(T.StructField(c, T.ArrayType(T.StringType())) for c in (*_LISTS, "entities")), T.StructField("first", T.StringType())])


@F.pandas_udf(_FOUND)
def found_in(texts: pd.Series) -> pd.DataFrame:
    """What the lexicons find in a text, in one pass: objects, aliased entities, locations, actions named in so many words, entities
    (named_entities()) and first (first_entity()); nothing for null."""
    finder = _finder(*(tuple(map(tuple, getattr(lexicons, v))) for v in _LISTS.values()))
    entity, rows = list(_LISTS).index("aliased"), []
    for text in texts:
        lists: list[list[str]] = [[] for _ in _LISTS]
        first = None
        for i, m in finder.matches(_fold(text)) if text else ():
            k = finder.of[i]
            lists[k].append(finder.labels[i])
            if k == entity:
                first = min(first or (m.start(), i), (m.start(), i))
        rows.append((*lists, _names_in(text, lists[entity]) if text else [], finder.labels[first[1]] if first else None))
    return pd.DataFrame(rows, columns=_FOUND.names, dtype=object)


def implied_or(named: Column, objects: Column) -> Column:
    """Named actions; where there are none, those that objects imply."""
    implied = F.array_distinct(F.filter(F.array(*(F.when(F.array_contains(objects, o), F.lit(a)) for o, a in catalog.INFERRED.items())), lambda x: x.isNotNull()))
    return F.when(F.size(named) > 0, named).otherwise(implied)


def actions_of(text: Column, objects: Column) -> Column:
    """Actions that the text names; where it names none, those that its objects imply."""
    return implied_or(hits(text, lexicons.ACTIONS), objects)


def dates_in(text: Column) -> Column:
    """Dates as they are written, in lower case: ISO, then English, then Chinese ones."""
    # What a date begins with comes before the look behind it, and only texts with a month's sign are searched for Chinese dates.
    heads = (r"(?=2)(?<![A-Za-z0-9_])", r"(?=[JFMASONDjfmasond])(?<![A-Za-z0-9_])", "")
    forms = [p.replace(r"\b", head, 1).replace(r"\b", _BOUNDARY) if head else p for p, head in zip(catalog.DATES, heads, strict=True)]
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in forms]
    found[2] = F.when(F.contains(text, F.lit("月")), found[2]).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(*found), lambda v: F.trim(F.lower(v))))


def number_tokens(text: Column) -> Column:
    """Numbers without thousands separators, a percent sign kept."""
    found = F.regexp_extract_all(text, F.lit(r"(\d[\d,.]*(?:\.\d+)?%?)"), F.lit(1))
    return F.transform(found, lambda v: F.lower(F.replace(v, F.lit(","), F.lit(""))))


def number_label(value: Column) -> Column:
    """A key number as queries spell it: usd:1.5b is $1.5 billion."""
    form = r"^usd:(\d+(?:\.\d+)?)([btm]?)$"
    unit = F.regexp_extract(value, form, 2)
    word = F.when(unit == "t", " trillion").when(unit == "b", " billion").when(unit == "m", " million").otherwise("")
    return F.when(value.rlike(form), F.concat(F.lit("$"), F.regexp_extract(value, form, 1), word)).otherwise(value)


def tags_of(text: Column, domain: catalog.Domain) -> Column:
    """The first three tags of the domain that the text calls for, or its default."""
    found = hits(text, list(domain.tags))
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit(domain.default_tag)))


def first_entity(text: Column) -> Column:
    """The aliased entity that is named first; the lexicon's order breaks ties; null without one."""
    own = tuple(map(tuple, lexicons.ENTITIES))

    @F.pandas_udf(T.StringType())
    def label(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _finder(own).first(_fold(x)) if x else None)

    return label(text)


def fingerprint(text: Column) -> Column:
    """Sixteen hex digits that equal texts share, whatever their case, punctuation and spaces."""
    return F.substring(F.sha1(normal_title(text).cast("binary")), 1, 16)
