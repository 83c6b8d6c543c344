"""What the queries share: candidates from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.functions import lexicons
from tidewire.functions.checks import WIRES
from tidewire.operators import candidates as C
from tidewire.sources import news

NOW = "2026-08-16 07:30:00"
IMPACT = ["launch", "rate", "attack", "ban", "earnings"]
HEADLINES = [
    "OpenAI launches new model for schools", "Federal Reserve holds rates steady at 4.5%", "Nvidia raises $3 billion for AI factory", "Japan and China reach security agreement",
    "UNESCO updates AI literacy curriculum", "Iran reportedly threatens strait of Hormuz shipping", "OpenAI unveils new model for schools", "SEC charges firm with $20 million fraud",
    "Microsoft acquires chip software company", "Ukraine reports missile attacks near Black Sea",
]
HOSTS = ["openai.com", "reuters.com", "techcrunch.com", "example.org", "federalreserve.gov", "bbc.com", "news.example.net"]


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return news.pages_as_candidates(_pages(spark, folder), HEADLINES, HOSTS)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return C.ranked(C.with_score(_candidates(spark, folder), NOW, IMPACT), "domain")


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _hits_sql(text: str, lexicon: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{label}' END" for label, p in lexicon)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def _wires_sql(text: str) -> str:
    cases = (f"WHEN regexp_matches({text}, '(?i){p}')" + (f" OR contains(source_id, '{host}')" if host else "") + f" THEN '{key}'" for key, p, host in WIRES)
    return "CASE " + " ".join(cases) + " END"


def _strip_sql(html: str) -> str:
    steps = [
        (r"<!--[\s\S]*?-->", " ", "g"), (r"<(?:nav|header|footer|aside|form|svg|noscript)\b[\s\S]*?</(?:nav|header|footer|aside|form|svg|noscript)>", " ", "gi"),
        (r"<style[\s\S]*?</style>", " ", "gi"), (r"<script[\s\S]*?</script>", " ", "gi"), (r"<[^>]+>", " ", "g"), (r"&(?:nbsp|ensp|emsp);", " ", "gi"),
        ("&amp;", "&", "gi"), ("&quot;", '"', "gi"), ("&apos;", "''", "gi"), ("&(?:hellip|mldr);", "…", "gi"), ("&(?:ldquo|rdquo);", "“", "gi"),
        ("&(?:lsquo|rsquo);", "’", "gi"), ("&(?:mdash|ndash);", "—", "gi"), ("&[a-z][a-z0-9]+;", " ", "gi"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ", "g"), ("�+", " ", "g"),
        *((c + "{2,}", c, "g") for c in ('"', "''", "“", "”", "‘", "’")), (r"[\s\p{Z}]+", " ", "g"),
    ]
    out = f"coalesce({html}, '')"
    for p, v, flags in steps:
        out = f"regexp_replace({out}, '{p}', '{v}', '{flags}')"
    return f"trim({out})"


_HOST_SQL = f"{_listed(HOSTS)}[CAST(floor(page_id / 3) AS BIGINT) % {len(HOSTS)} + 1]"
CANDIDATES_SQL = rf"""
base AS (SELECT CAST(page_id AS VARCHAR) AS id, {_listed(list(news.DOMAINS))}[page_id % 4 + 1] AS domain,
  {_listed(HEADLINES)}[page_id % {len(HEADLINES)} + 1] || ' ' || regexp_extract(html, '<title>(\S*)', 1) AS title,
  {_strip_sql("html")} AS description,
  'https://www.' || {_HOST_SQL} || '/item/' || CAST(CAST(floor(page_id / 2) AS BIGINT) AS VARCHAR) AS url,
  CASE WHEN page_id % 13 <> 0 THEN TIMESTAMP '2026-08-16 00:00:00' - to_hours((page_id % 11) * 9) END AS published_at,
  {_HOST_SQL} AS source_id FROM pages WHERE page_id IS NOT NULL),
tiered AS (SELECT *, CASE
  WHEN list_bool_or(list_transform({_listed(lexicons.OFFICIAL_HOSTS)}, lambda h: source_id = h OR ends_with(source_id, '.' || h))) THEN 'primary'
  WHEN list_bool_or(list_transform({_listed(lexicons.TIER_ONE_HOSTS)}, lambda h: source_id = h OR ends_with(source_id, '.' || h))) THEN 'tier-1'
  WHEN list_bool_or(list_transform({_listed(lexicons.TIER_TWO_HOSTS)}, lambda h: source_id = h OR ends_with(source_id, '.' || h))) THEN 'tier-2'
  ELSE 'other' END AS reliability FROM base),
cand AS (SELECT *, CASE reliability WHEN 'primary' THEN 42.0 WHEN 'tier-1' THEN 36.0 WHEN 'tier-2' THEN 31.0 ELSE 24.0 END AS weight FROM tiered),
scored AS (SELECT *, CAST(weight AS DOUBLE) + coalesce(greatest(0.0, 36.0 - greatest(0.0, (epoch(TIMESTAMP '{NOW}') - epoch(published_at)) / 3600.0) / 4), 0.0)
  + least({" + ".join(f"CASE WHEN contains(lower(title || ' ' || description), '{t}') THEN 2.5 ELSE 0.0 END" for t in IMPACT)}, 18.0)
  + least(8.0, length(title || ' ' || description) / 220) - CASE WHEN published_at IS NULL THEN 20.0 ELSE 0.0 END AS score FROM cand),
ranked AS (SELECT *, round(score, 6) AS score6, row_number() OVER (PARTITION BY domain ORDER BY score DESC, published_at IS NULL,
  coalesce(published_at, TIMESTAMP '1970-01-01') DESC, url, domain, title, id) AS rank FROM scored)
"""
