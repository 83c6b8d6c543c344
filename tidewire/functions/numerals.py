"""Numeric expressions in texts: what counts as one, cutting them out, and mending what is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric expressions, and what is broken or left over where one was cut out.
NUMERIC_EXPRESSION = (
    r"(?:[$€£¥￥]\s*)?\d[\d,.]*(?:\.\d+)?(?:\s*[–-]\s*\d[\d,.]*(?:\.\d+)?)?\s*"
    r"(?:%|percent|percentage points?|basis points?|bps|trillion|billion|million|tn|bn|mn|亿美元|亿元|万亿元|万亿|万吨|gw|mw|级|人|家|所|年|月|日)?"
)
NUMBER_TOKEN = r"\d[\d,.]*(?:\.\d+)?%?"
BROKEN_QUANTIFIER = (
    r"(?:减少|增加|达到|高达|造成约?|约|近|超过)\s*(?:万?(?:人|名)|亿?欧元|亿美元|亿元|万亿元|经济损失)(?=[，。；]|$)"
    r"|(?<![\d数十百千])(?:万|亿)(?:美元|欧元|元)(?![\d])|[，；]\s*[。！？]"
)
LEFT_OVER = (
    (r"(?:约|超过|近|逾|达到|增至|升至|降至|为)\s*(?=[，。；、]|$)", ""),
    (r"(筹集|募集|融资|投资)\s*(?=建设|扩建|扩产|推进|用于)", "$1资金并"),
    (r"(?:预计[^，。；]{0,24})?(?:减少|增加|达到|高达|造成约?|约|近|超过)\s*(?:万?人|亿?欧元|亿美元|亿元|万亿元|经济损失)(?=[，。；]|$)", ""),
    (r"增长\s*(?=[，。；]|$)", "出现增长"),
    (r"下降\s*(?=[，。；]|$)", "出现下降"),
    (r"\(\s*\)|（\s*）", ""),
    (r"\s+([，。；！？])", "$1"),
    (r"\s{2,}", " "),
    (r"[，；、]{2,}", "，"),
)
RAW_LABEL = (
    r"(?:[$€£¥￥]\s*)?\d[\d,.]*(?:\.\d+)?\s*(?:%|percent|percentage points?|basis points?|bps|trillion|billion|million|tn|bn|mn|亿元|亿美元|万亿元|万吨|gw|mw)?"
)
RAW_LABEL_UNIT = r"[%$€£¥￥]|(?<![a-z0-9_])(?:trillion|billion|million|tn|bn|mn|gw|mw)(?![a-z0-9_])"


def numeric_expressions(text: Column) -> Column:
    """The numeric expressions of a text as they stand, in order, with the white space behind each."""
    return F.regexp_extract_all(text, F.lit("(?iu)" + NUMERIC_EXPRESSION), F.lit(0))


def has_numbers(text: Column) -> Column:
    return text.rlike("[0-9]")


def without_expressions(text: Column, cut: Column) -> Column:
    """The text without the numeric expressions at these places (from 0, in the order of numeric_expressions).

    What stands between the expressions, and white space behind them, stays as it is.
    """
    pieces, found = F.split(text, "(?iu)" + NUMERIC_EXPRESSION, -1), numeric_expressions(text)
    space = lambda m: F.regexp_extract(m, r"(\s*)$", 1)
    kept = F.transform(found, lambda m, i: F.when(F.array_contains(cut, i), space(m)).otherwise(m))
    # one piece more than expressions: the last is followed by nothing
    stitched = F.array_join(F.zip_with(pieces, F.concat(kept, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    return F.when(F.size(found) > 0, stitched).otherwise(text)


def mended(text: Column) -> Column:
    """The text without words, brackets and marks that stood around numbers which are gone."""
    for p, value in LEFT_OVER:
        text = F.regexp_replace(text, p, value)
    return F.trim(text)


def number_sentences(text: Column) -> Column:
    """The sentences whose numbers are judged one by one: cut behind full stops, question marks, exclamation marks and semicolons."""
    return F.filter(F.split(text, r"(?<=[。！？!?；;])\s*"), lambda s: s != "")


def says_enough(text: Column, least: int = 6) -> Column:
    """Whether so many characters are left without white space, punctuation and symbols."""
    return F.length(F.regexp_replace(text, r"(?U)[\s\p{P}\p{S}]", "")) >= least


def has_broken_quantifier(text: Column) -> Column:
    """Whether a unit, a quantity word or a mark hangs without its number."""
    return text.rlike(BROKEN_QUANTIFIER)


def raw_number_labels(text: Column) -> Column:
    """Numbers with a currency or a unit as they stand, each once."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + RAW_LABEL), F.lit(0))
    plain = F.transform(found, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.array_distinct(F.filter(plain, lambda v: v.rlike("(?i)" + RAW_LABEL_UNIT)))
