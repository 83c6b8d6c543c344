"""Whether events fit their domain before any is selected: over reports made of whole documents (plans/news.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import catalog, checks, lexicons
from tidewire.operators import candidates as C
from tidewire.operators import events as E
from tidewire.operators import relevance
from tidewire.operators.selection import BOOST, FIT, by_level
from tidewire.operators.tables import durable
from tidewire.plans.base import _listed, _wires_sql
from tidewire.plans.news import _LISTING, FEATURES_SQL, _match_sql, _q, _reports


_GATED = (
    "event_id", "domain", "title", "description", "source_id", "reliability", "independence_key", "published_at", "listing", "entities", "actions", "objects", "numbers",
)


def event_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one domain's reports: how well they fit it, what their evidence adds to a score, and the first reason against them."""
    rows = C.with_features(_reports(spark, folder)).withColumn("event_id", F.concat_ws(":", "domain", "event_id"))
    rows = rows.withColumn("listing", checks.is_non_article(F.col("title"), F.col("url"), C.specific()))
    rows = rows.withColumn("independence_key", checks.independence_key(F.col("title"), F.col("description"), F.col("source_id")))
    rows = durable(rows.select(*_GATED))  # the words of texts are not among them
    levels, out = E.evidence(rows).select("event_id", "level"), None
    for d in catalog.DOMAINS:
        fits = relevance.event_fit(relevance.with_signals(rows.where(F.col("domain") == d.name), d), levels)
        found = relevance.assessed(fits, markets=d is catalog.MARKETS)
        out = found if out is None else out.unionByName(found)
    graded = out.join(levels, "event_id")
    return graded.select("event_id", "level", F.round("fit", 6).alias("fit"), by_level(F.col("level"), BOOST).cast("long").alias("boost"), "reason")


QUERIES = (event_gate,)

_AMOUNT = (
    r"([$€£¥￥]\s?\d[\d,.]*(?:\s?(?:trillion|billion|million|tn|bn|mn))?"
    r"|\d+(?:\.\d+)?\s?(?:%|percent|percentage points?|basis points?|bps|trillion|billion|million|亿元|亿美元|万亿元|万亿|万吨|gw|mw))"
)
_DOLLARS = r"^\$\s?(\d+(?:\.\d+)?)\s?(?:trillion|billion|million|tn|bn|mn)?$"
#: Key numbers of a text in one spelling each: amounts of dollars as a number with the first letter of its unit (b for other letters).
_SPELLED = rf"""list_transform(list_transform(regexp_extract_all(x, '(?i){_AMOUNT}', 1), lambda v: trim(replace(regexp_replace(lower(v), '\s+', ' ', 'g'), ',', ''))),
  lambda v: CASE WHEN regexp_matches(v, '^\d+(?:\.\d+)?亿美元$') THEN CAST(CAST(regexp_extract(v, '^([\d.]+)', 1) AS DOUBLE) / 10 AS VARCHAR) || 'b'
    WHEN regexp_matches(v, '{_DOLLARS}') THEN CAST(CAST(regexp_extract(v, '{_DOLLARS}', 1) AS DOUBLE) AS VARCHAR)
      || CASE WHEN regexp_matches(v, 't(?:rillio)?n$') THEN 't' WHEN regexp_matches(v, 'm(?:illio)?n$') THEN 'm' WHEN regexp_matches(v, '[a-z]$') THEN 'b' ELSE '' END
    ELSE regexp_replace(replace(v, 'percent', '%'), 'basis points?', 'bps', 'g') END)"""


def _by_level(values: dict[str, int]) -> str:
    return "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _kinds(column: str) -> str:
    return f"len(list_distinct(flatten(list({column}))))"


ORACLES: dict[str, str] = {
    "event_gate": f"""WITH {FEATURES_SQL},
m AS ({" UNION ALL ".join(f"SELECT id, domain, event_id, title, url, x, published_at, source_id, reliability, entities, actions, objects, named, match, relevant FROM ({_match_sql(d)}) AS m" for d in catalog.DOMAINS)}),
j AS (SELECT *, {_SPELLED} AS numbers, {_LISTING} AS is_listing FROM m),
p AS (SELECT domain, domain || ':' || event_id AS event_id, greatest(0.0, CAST(max(match) AS DOUBLE)) AS best, bool_or(relevant AND match >= 4) AS relevant,
  {_kinds("entities")} AS e, {_kinds("actions")} AS a, {_kinds("objects")} AS o, {_kinds("numbers")} AS n, count(published_at) > 0 AS dated,
  bool_or(regexp_matches(x, '(?i){_q(catalog.LOW_VALUE)}')) AS low_value, bool_or(len(entities) > 0 AND len(actions) > 0) AS concrete,
  bool_or(regexp_matches(x, '(?i){_q(catalog.MARKET_CORE)}') OR list_has_any(objects, {_listed(list(catalog.MARKET_OBJECTS))})) AS market_core, bool_and(is_listing) AS listing,
  count(DISTINCT source_id) AS sources, bool_or(reliability = 'primary') AS official, bool_or(regexp_matches(x, '(?i){_q(lexicons.RUMOR)}')) AS rumor,
  count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN coalesce({_wires_sql("x")}, source_id) END) AS independent FROM j GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN official AND independent >= 1 THEN 'confirmed' WHEN independent >= 2 THEN 'corroborated' WHEN sources = 1 AND NOT rumor THEN 'single-source'
  ELSE 'unverified' END AS level FROM p),
f AS (SELECT *, best + {_by_level(FIT)} + least(e, 3) + least(a, 2) + least(o, 2) + least(n, 2) * 0.5 + CAST(dated AS INTEGER) AS fit FROM g)
SELECT event_id, level, round(CAST(fit AS DOUBLE), 6) AS fit, CAST({_by_level(BOOST)} AS BIGINT) AS boost, CASE WHEN listing THEN 'non-article-page' WHEN low_value THEN 'low-news-value'
  WHEN domain = '{catalog.MARKETS.name}' AND NOT market_core THEN 'domain-mismatch' WHEN NOT concrete THEN 'no-event-action' WHEN NOT relevant OR fit < 8 THEN 'domain-mismatch'
  ELSE 'accepted' END AS reason FROM f""",
}
