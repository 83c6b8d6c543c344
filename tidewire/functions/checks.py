"""Flags, extracts and repairs of texts: artifacts, fragments, placeholders, sentences, secrets, bodies of pages."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import _BOUNDARY, bound, han_share, hits, hostname, nfkc, of_host, pattern, strip_html

# The patterns of what no published text may hold.
HTML_ARTIFACT = r"</?[a-z][^>]*>|&(?:#\d+|#x[\da-f]+|[a-z][a-z0-9]+);|(?:^|\s)#{2,}\s|\b(?:javascript:void|document\.cookie)\b"
ENGLISH_RUN = r"(?:\b[a-z]{2,}\b[\s,;:'\"()\-]*){7,}"
DATE_STAMP = r"\b(?:fri|mon|tue|wed|thu|sat|sun),?\s+\d{1,2}/\d{1,2}/\d{4}\s+-"
PAYWALL = "subscribe to continue|sign in to continue|enable javascript to continue|metered paywall"
LEGAL = [r"\b(?:copyright|all rights reserved|privacy policy|terms of use)\b[^。！？!?]*", r"(?:版权所有|保留所有权利|隐私政策|使用条款)[^。！？!?]*"]
LEGAL_WORDS = ["copyright", "all rights reserved", "privacy policy", "terms of use", "版权所有", "保留所有权利", "隐私政策", "使用条款"]
NAVIGATION = r"^(?:home|menu|search|sign in|subscribe|read more|share|related|advertisement)\b"
ARCHIVE_TITLE = r"^(?:news\s+)?archives?$|新闻归档"
GENERIC_TITLE = r"^(?:news|latest news(?:\s+\d+)?(?:\s+un news)?|press releases?|index|category|tag|blog)(?:\s*[|·-].*)?$|新闻中心|资讯中心|文章列表"
LISTING_FOLDER = r"(?:^|/)(?:archive|archives|index|category|categories|tag|tags)(?:/|$)"
LISTING_PAGE = r"/(?:news|press-releases?|blog)$"
PLACEHOLDER_SUMMARY = [
    r"来源材料(?:发布|披露|提供)了?与当前(?:主题|事件)相关的(?:新)?信息",
    r"这里仅保留(?:原文可以直接支持的)?(?:定性事实|定性结论)",
    r"具体细节以来源(?:页面|材料|原文)为准",
    r"未获来源明确确认的细节不作推断",
    r"现有来源材料明确记录了?这一具体动作",
    r"(?:来源|原文)(?:已|明确)?(?:确认|记录|支持)(?:了)?(?:上述|这一|该)(?:动作|事件|说法)",
    r"围绕.{1,36}(?:发布|扩建|威胁|强化|实施新规)[；，].{0,12}参与或受影响的主体还包括",
]
PLACEHOLDER_TITLE = [
    r"^press release(?: details?)?$",
    r"(?:来源|公司|机构|[\w.-]+\.com|[\w.-]+\.org|[\w.-]+\.gov|[\w.-]+\.edu|blog|news|cnbc|bbc|dw|techcrunch).{0,24}(?:发布|披露|提供).{0,18}(?:相关)?(?:更新|信息)$",
    r"^.{2,40}(?:发布|披露|提供)(?:了)?(?:与)?(?:当前)?[^：:，。]{1,24}(?:相关)?(?:更新|信息)$",
    r"(?:发布|披露|提供)(?:了)?(?:与)?(?:当前)?(?:主题|事件|领域).{0,12}(?:相关)?(?:更新|信息)$",
    r"(?:强化模型|警告新产品|发现学习方法|威胁身份泄露|实施新规新产品)$",
]
WIRES = [
    ("wire:reuters", r"\breuters\b|路透(?:社)?", "reuters"),
    ("wire:ap", r"\bassociated press\b|\bAP News\b|美联社", "apnews"),
    ("wire:afp", r"\bagence france-presse\b|\bAFP\b|法新社", None),
    ("wire:xinhua", r"\bxinhua\b|新华社|新华网", None),
    ("wire:pr-newswire", r"\bpr newswire\b|美通社", None),
    ("wire:business-wire", r"\bbusiness wire\b", None),
]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def has_html_artifact(text: Column) -> Column:
    """Whether tags, character references, heading marks or script names are left in the text."""
    parts = functools.reduce(operator.or_, (F.contains(text, F.lit(x)) for x in ("<", "&", "##")))
    names = bound(F.lower(text), lambda low: F.contains(low, F.lit(":vo")) | F.contains(low, F.lit("document.coo")))
    return (parts | names) & text.rlike(pattern(HTML_ARTIFACT))  # one of these is in whatever the pattern matches


def has_english_fragment(text: Column) -> Column:
    """Whether seven or more lower-case English words follow each other, or a date stamp hangs in the text."""
    # Exactly seven find the same texts as seven and more, but the matcher descends once for each repeat of a group: on
    # a run of a thousand words the open form exhausts the stack of its thread.
    seven = ENGLISH_RUN.replace("{7,}", "{7}")
    return bound(strip_html(text), lambda plain: plain.rlike(seven.replace(r"\b", _BOUNDARY)) | plain.rlike(pattern(DATE_STAMP)))


def is_placeholder_summary(text: Column) -> Column:
    """Whether a summary is empty, or only says that its source says something."""
    return bound(strip_html(text), lambda plain: (plain == "") | plain.rlike(pattern("|".join(PLACEHOLDER_SUMMARY))))


def is_placeholder_title(text: Column) -> Column:
    """Whether a title is empty, or only says that somebody published something."""
    return bound(strip_html(text), lambda plain: (plain == "") | plain.rlike(pattern("|".join(PLACEHOLDER_TITLE))))


def enough_chinese(text: Column, least: float = 0.35) -> Column:
    """Whether Han characters are at least this share of the letters."""
    some = text.rlike(r"\p{IsHan}")  # few texts have any: only theirs are counted
    return some & (han_share(text) >= least) if least > 0 else han_share(text) >= least


def han_ratio(text: Column) -> Column:
    """Share of Han characters in what is neither white space, punctuation, symbol nor digit; 0 without any."""
    bare = F.regexp_replace(text, r"(?U)[\s\p{P}\p{S}]|[0-9]", "")
    return F.when(F.length(bare) > 0, F.length(F.regexp_replace(bare, r"[^\p{IsHan}]", "")) / F.length(bare)).otherwise(0.0)


def _without_notes(plain: Column) -> Column:
    """The text without legal notes; only texts that hold a note's words, which few do, are searched for whole notes."""
    noted = bound(F.lower(plain), lambda low: functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in LEGAL_WORDS)))
    noted = functools.reduce(operator.or_, (F.contains(plain, F.lit(c)) for c in "ſİı"), noted)  # letters that the patterns take for others
    rest = plain
    for p in LEGAL:
        rest = F.regexp_replace(rest, pattern(p), " ")
    return F.when(noted, rest).otherwise(plain)


def sentences(text: Column) -> Column:
    """The sentences of an HTML text, without legal notes, bullets, navigation and what has under 12 characters."""
    plain = bound(strip_html(text), _without_notes)
    # The space comes first: it is rarer than what stands before it is looked at. All white space is a space by now.
    cut = F.split(plain, r"\s(?<=[。！？!?]\s)\s*|\s(?<=\.\s)\s*(?=[A-Z\p{IsHan}])")
    single = lambda s: F.when(F.contains(s, F.lit("  ")), F.regexp_replace(s, " +", " ")).otherwise(s)
    bare = F.transform(cut, lambda s: single(F.btrim(s, F.lit(" \t\n\x0b\f\r|>-–—•·"))))
    return F.filter(bare, lambda s: (F.length(s) >= 12) & ~s.rlike(pattern(NAVIGATION)))


def fact_sentences(text: Column) -> Column:
    """Sentences of 8 to 320 characters that hold a digit."""
    cut = F.split(text, r"(?<=[。！？.!?;；])\s*")
    bare = F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.filter(bare, lambda s: F.length(s).between(8, 320) & s.rlike("[0-9]"))


def article_body(html: Column, least: int = 280) -> Column:
    """The text of a page: paragraphs of 40 characters or more of its article, a line for each.

    Null for pages behind a paywall and for less than `least` characters. Bodies are whole.
    """
    article = F.regexp_extract(html, r"(?i)<article\b[^>]*>([\s\S]*?)</article>", 1)
    within = F.when(html.rlike(r"(?i)<article\b[^>]*>[\s\S]*?</article>"), article).otherwise(html)
    paragraphs = F.transform(F.regexp_extract_all(within, F.lit(r"(?i)<p\b[^>]*>([\s\S]*?)</p>"), F.lit(1)), strip_html)
    text = F.array_join(F.filter(paragraphs, lambda p: F.length(p) >= 40), "\n")
    return F.when(~html.rlike(f"(?i){PAYWALL}") & (F.length(text) >= least), text)


def redact_secrets(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """The text without bearer tokens, key-shaped tokens and these secrets of six characters or more."""
    out = F.regexp_replace(text, r"(?i)Bearer\s+[^\s\"']+", "Bearer [REDACTED]")
    out = F.regexp_replace(out, r"\b(?:tvly|sk)-[A-Za-z0-9_-]{8,}\b".replace(r"\b", _BOUNDARY), "[REDACTED]")
    for s in secrets:
        if len(s) >= 6:
            out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return out


def number_words(text: Column) -> Column:
    """Zero to ten as digits, all in one pass: no digit makes another word."""
    form = r"(?iu)(?<![A-Za-z0-9_])(" + "|".join(NUMBER_WORDS) + r")(?![A-Za-z0-9_])"
    listed = F.array(*map(F.lit, NUMBER_WORDS))
    # The letters that patterns in any case take for s and i.
    digit = lambda w: (F.array_position(listed, F.lower(F.translate(w, "ſİı", "sii"))) - 1).cast("string")

    def replaced(t: Column) -> Column:
        digits = F.concat(F.transform(F.regexp_extract_all(t, F.lit(form), F.lit(1)), digit), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, form, -1), digits, lambda x, y: F.concat(x, y)), "")

    return bound(text, replaced)


def json_in(text: Column) -> Column:
    """The JSON of an answer, fenced or bare; null if it is none."""
    fenced = F.regexp_extract(text, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)
    found = F.regexp_replace(F.when(fenced != "", fenced).otherwise(text), r"^\s+|\s+$", "")
    return F.when(F.try_parse_json(found).isNotNull(), found)


def official_hosts_in(query: Column, known: list[str]) -> Column:
    """Official hosts that a query asks for with site:, sorted."""
    asked = F.regexp_extract_all(query, F.lit(r"(?i)(?<![A-Za-z0-9_])site:([a-z0-9.-]+)"), F.lit(1))
    hosts = F.transform(asked, lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"^www\d*\.", ""), r"\.$", ""))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: of_host(h, known))))


def is_non_article(title: Column, url: Column, specific: Column) -> Column:
    """Whether a page lists articles: by a generic title, or by its path if title and text have no specific event."""
    words = F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(title, F.lit(""))), r"[\p{P}\p{S}]+", " "), r"(?U)\s+", " "))
    path = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/?#]*([^?#]*)", 1)), "/+$", "")
    generic = words.rlike(f"(?i){ARCHIVE_TITLE}") | words.rlike(f"(?i){GENERIC_TITLE}")
    return generic | ((path.rlike(LISTING_FOLDER) | path.rlike(LISTING_PAGE)) & ~specific)


def wire_key(title: Column, description: Column, source_id: Column) -> Column:
    """The first news agency that a report names or comes from; null without one."""
    named = hits(F.concat_ws(" ", title, description), [(key, p) for key, p, _ in WIRES])
    own = {key: source_id.contains(host) if host else F.lit(False) for key, _, host in WIRES}
    return F.coalesce(*(F.when(F.array_contains(named, key) | own[key], F.lit(key)) for key, _, _ in WIRES))


def independence_key(title: Column, description: Column, source_id: Column, own: Column | None = None) -> Column:
    """What tells independent reports apart: the agency, else the report's own key, else its publisher."""
    return F.coalesce(wire_key(title, description, source_id), F.lit(None).cast("string") if own is None else own, F.concat(F.lit("publisher:"), source_id))


def host_of(url: Column) -> Column:
    """The host of a page, as sources are named by it."""
    return hostname(url)
