"""Queries on reports made of whole documents: names, dates, numbers, domains, search hits, syndication, events' dates, claims.

The test tables hold no news. A document is a report with its whole text as description; titles, hosts, URLs and times are
dealt out by doc_id from lists that are multiplied with each other, so that titles vary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import catalog, checks, lexicons
from tidewire.functions import text as T
from tidewire.operators import candidates as C
from tidewire.operators import claims as K
from tidewire.operators import diagnostics as D
from tidewire.operators import events as E
from tidewire.operators import followups as U
from tidewire.operators import relevance, syndication
from tidewire.plans.base import NOW, _hits_sql, _listed, _strip_sql, _wires_sql
from tidewire.sources import history, news

SUBJECTS = ["OpenAI", "Federal Reserve", "Iran", "Harvard University", "Reuters says Nvidia", "UNESCO", "Quantum Bridge Labs", "Japan", "A local school board"]
VERBS = ["launches", "cuts rates on", "warns about", "acquires", "publishes", "signs agreement on", "reportedly bans"]
THINGS = ["AI chip factory", "consumer price index", "missile shipping route", "curriculum assessment", "stocks and bonds", "student data", "ceasefire talks", "tag archive"]
AMOUNTS = ["", "worth $3 billion", "by 4.5 percent", "on August 14, 2026", "for 1,200 students"]
HOSTS = ["openai.com", "reuters.com", "techcrunch.com", "example.org", "federalreserve.gov", "bbc.com", "news.example.net", "unesco.org"]
PATHS = ["news", "tag", "2026/08", "blog", "items"]
#: (list, divisor of doc_id): which entry a document takes.
_DEALT = {"subject": (SUBJECTS, 1), "verb": (VERBS, 9), "thing": (THINGS, 3), "amount": (AMOUNTS, 2), "host": (HOSTS, 2), "path": (PATHS, 4)}


def _pick(name: str) -> F.Column:
    values, step = _DEALT[name]
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(F.col("doc_id") / step), F.lit(len(values))) + 1).cast("int"))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports from documents with an id; an event is what one subject does."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    url = F.concat(F.lit("https://www."), _pick("host"), F.lit("/"), _pick("path"), F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"))
    hours = F.pmod(F.col("doc_id"), F.lit(23)) * 17 - 24
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.element_at(F.array(*map(F.lit, news.DOMAINS)), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int")).alias("domain"),
        F.trim(F.concat_ws(" ", _pick("subject"), _pick("verb"), _pick("thing"), _pick("amount"))).alias("title"),
        F.concat_ws(":", _pick("subject"), _pick("verb")).alias("event_id"),
        F.coalesce("text", F.lit("")).alias("description"),
        url.alias("url"),
        _pick("host").alias("source_id"),
        F.when(F.pmod("doc_id", F.lit(13)) != 0, F.lit("2026-08-16 00:00:00").cast("timestamp") - F.make_dt_interval(hours=hours)).alias("published_at"),
        (F.pmod("doc_id", F.lit(10)) / 10).alias("provider_score"),
    )
    tier = rows.withColumn("reliability", news.reliability(F.col("source_id")))
    return tier.withColumn("weight", news.weight(F.col("reliability")))


def _text() -> F.Column:
    return F.concat_ws(" ", "title", "description")


def names(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select("id", F.array_join(F.array_sort(T.named_entities(_text())), ",").alias("names"))


def text_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select("id", F.array_join(T.dates_in(_text()), ",").alias("dates"))


def text_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select("id", F.array_join(T.number_tokens(checks.number_words(_text())), " ").alias("numbers"))


def implied_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select("id", F.array_join(T.actions_of(_text(), T.hits(_text(), lexicons.OBJECTS)), ",").alias("actions"))


def domain_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.with_features(_reports(spark, folder))
    parts = [relevance.with_signals(rows.where(F.col("domain") == d.name), d) for d in catalog.DOMAINS]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.select("id", "domain", F.round("match", 6).alias("match"), "relevant")


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """All hits with their first reason; the accepted ones with score, tags and id."""
    rows, out = C.with_features(_reports(spark, folder)), None
    for d in catalog.DOMAINS:
        found = C.hits_as_candidates(relevance.with_signals(rows.where(F.col("domain") == d.name), d), d, NOW)
        found = found.select("id", "domain", "reason", F.round("score", 6).alias("score"), F.array_join("tags", ",").alias("tags"), "candidate_id")
        out = found if out is None else out.unionByName(found)
    return out


def syndicated(spark: SparkSession, folder: str) -> DataFrame:
    keys = syndication.effective_keys(_reports(spark, folder))
    return keys.select("id", "wire", "via", F.when(F.col("via") != "shared-text", F.col("effective_key")).alias("effective_key"))


def independent_grades(spark: SparkSession, folder: str) -> DataFrame:
    rows = _reports(spark, folder)
    keys = syndication.effective_keys(rows).select("id", F.col("effective_key").alias("independence_key"))
    graded = E.with_rumor(rows).select("id", "event_id", "source_id", "reliability", "rumor")
    return E.evidence(graded.join(keys, "id")).select("event_id", "level", "source_count", "independent_count")


def event_dates(spark: SparkSession, folder: str) -> DataFrame:
    found = E.date_ranges(_reports(spark, folder))
    return found.select("event_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "spread_hours", "date_conflict")


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.with_features(_reports(spark, folder))
    return rows.select("id", checks.is_non_article(F.col("title"), F.col("url"), C.specific()).alias("listing"))


def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """Which reports of an event support its claim, the title of its first report with a key number; a publisher's name is part of its report."""
    rows = _reports(spark, folder).withColumn("description", F.concat_ws(" ", "description", "source_id"))
    stated = rows.where(F.col("title").rlike("[0-9]")).groupBy("event_id").agg(F.min_by("title", F.col("id").cast("long")).alias("claim"))
    return K.supported(stated, C.with_features(rows)).select("event_id", "id", "supports")


def _named_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _reports(spark, folder)
    return rows.withColumn("actions", T.hits(_text(), lexicons.ACTIONS)).withColumn("numbers", T.number_tokens(F.col("title")))


def false_merges(spark: SparkSession, folder: str) -> DataFrame:
    rows = _named_rows(spark, folder)
    return D.false_merges(rows, E.date_ranges(rows).where("date_conflict"))


def dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """A run in which undated reports with a URL of every third length go, events have a dated report, and the first events are chosen."""
    rows = _reports(spark, folder)
    dated = F.col("published_at").isNotNull()
    after = rows.where(dated | (F.length("url") % 3 != 0))
    members = rows.join(rows.where(dated).select("event_id").distinct(), "event_id", "left_semi").select("domain", "id", "event_id")
    moved = rows.select("event_id").distinct().where(F.startswith("event_id", F.lit("OpenAI:l"))).select("event_id", F.lit(f"{SUBJECTS[1]}:{VERBS[1]}").alias("owner"))
    listed, final = members.where(F.endswith("event_id", F.lit("acquires"))), members.where(F.contains("event_id", F.lit("rates")))
    return D.dispositions(rows, after, members, moved, listed, final)


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _reports(spark, folder).withColumn("print", T.fingerprint(F.col("title"))).withColumn("independence_key", F.concat(F.lit("publisher:"), "source_id"))
    grades = E.evidence(rows).select("event_id", "level", "primary_present")
    final = grades.join(rows.groupBy("event_id").agg(F.min("source_id").alias("source_id")), "event_id").where(F.endswith("event_id", F.lit("acquires")))
    return D.run_metrics(rows, rows.where("published_at is not null or weight > 30"), E.date_ranges(rows), final)


def content_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as stories: whole documents as summaries, every other one after its title."""
    rows = _reports(spark, folder)
    summary = F.when(F.col("id").cast("long") % 2 == 0, F.concat("title", F.lit(". "), "description")).otherwise(F.col("description"))
    return D.content_quality(rows.select("domain", "title", summary.alias("summary"), F.array(F.col("title"), summary).alias("fields")))


def follow_ups(spark: SparkSession, folder: str) -> DataFrame:
    """What to ask about each report's event, where, and what to ask to learn more."""
    rows = C.with_features(_reports(spark, folder))
    hosts = U.verification_hosts(F.col("domain"), F.col("entities"), F.col("reliability") == "primary")
    return rows.select(
        "id", U.verification_query(U.named_actions(_text()), F.col("published_at")).alias("question"), F.array_join(hosts, ",").alias("hosts"),
        U.discovery_query(F.col("published_at")).alias("discovery"),
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    found = D.event_snapshots(_named_rows(spark, folder).withColumn("entities", T.hits(F.col("title"), lexicons.ENTITIES)))
    return found.select("event_id", *(F.array_join(c, ",").alias(c) for c in ("article_ids", "article_urls", "entities", "actions", "numbers")))


def earlier_signals(spark: SparkSession, folder: str) -> DataFrame:
    """What digests of one report each said; a later briefing of the same domain does not count."""
    story = F.struct("title", F.col("description").alias("summary"), F.array("event_id", F.lit("")).alias("keyFacts"), F.struct(F.array("source_id").alias("signalsToWatch")).alias("trend"))
    briefing = F.struct("domain", F.array(story).alias("stories"), F.array("url").alias("watchNext"))
    landed = _reports(spark, folder).select("id", F.to_json(F.struct(F.array(briefing, briefing).alias("briefings"))).alias("json"))
    return history.previous_signals(landed)


QUERIES = (
    names, text_dates, text_numbers, implied_actions, domain_match, search_hits, syndicated, independent_grades, event_dates, listing_pages, claim_support,
    false_merges, dispositions, run_metrics, content_quality, follow_ups, snapshots, earlier_signals,
)


def _pick_sql(name: str) -> str:
    values, step = _DEALT[name]
    return f"{_listed(values)}[CAST(floor(doc_id / {step}) AS BIGINT) % {len(values)} + 1]"


def _tier_sql(hosts: list[str]) -> str:
    return f"list_bool_or(list_transform({_listed(hosts)}, lambda h: source_id = h OR ends_with(source_id, '.' || h)))"


def _q(p: str) -> str:
    return p.replace("'", "''")


REPORTS_SQL = f"""
base AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, {_listed(list(news.DOMAINS))}[doc_id % 4 + 1] AS domain,
  trim({_pick_sql("subject")} || ' ' || {_pick_sql("verb")} || ' ' || {_pick_sql("thing")} || ' ' || {_pick_sql("amount")}) AS title,
  {_pick_sql("subject")} || ':' || {_pick_sql("verb")} AS event_id, coalesce(text, '') AS description,
  'https://www.' || {_pick_sql("host")} || '/' || {_pick_sql("path")} || '/' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS VARCHAR) AS url, {_pick_sql("host")} AS source_id,
  CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2026-08-16 00:00:00' - to_hours((doc_id % 23) * 17 - 24) END AS published_at, (doc_id % 10) / 10 AS provider_score
  FROM documents WHERE doc_id IS NOT NULL),
reports AS (SELECT *, title || ' ' || description AS x, CASE WHEN {_tier_sql(lexicons.OFFICIAL_HOSTS)} THEN 'primary' WHEN {_tier_sql(lexicons.TIER_ONE_HOSTS)} THEN 'tier-1'
  WHEN {_tier_sql(lexicons.TIER_TWO_HOSTS)} THEN 'tier-2' ELSE 'other' END AS reliability FROM base)"""
_PLAIN = "trim(replace(lower(v), '.', ''))"
_ALIASES = "|".join(p for _, p in lexicons.ENTITIES)
_NAMES = f"""list_transform(list_filter(list_distinct(regexp_extract_all(x, '{_q(catalog.NAME)}', 1)), lambda v: NOT regexp_matches(v, '(?i){_q(_ALIASES)}')
  AND NOT regexp_matches(v, '(?i){_q(catalog.NAME_VERBS)}') AND NOT regexp_matches(v, '(?i){_q(catalog.GENERIC_NAME_TERMS)}')
  AND NOT list_contains({_listed(list(catalog.GENERIC_NAMES))}, {_PLAIN})), lambda v: {_PLAIN})"""


def _hit_list(text: str, lexicon: list[tuple[str, str]]) -> str:
    return _hits_sql(text, lexicon).removeprefix("array_to_string(").removesuffix(", ',')")


_IMPLIED = ", ".join(f"CASE WHEN list_contains(objects, '{o}') THEN '{a}' END" for o, a in catalog.INFERRED.items())
#: Names and actions without an order of their own: only their numbers and overlaps count.
LISTS_SQL = f"""lists AS (SELECT *, {_hit_list("x", lexicons.OBJECTS)} AS objects, {_hit_list("x", lexicons.ACTIONS)} AS named FROM reports),
feat AS (SELECT *, list_distinct(list_concat({_hit_list("x", lexicons.ENTITIES)}, {_NAMES})) AS entities,
  CASE WHEN len(named) > 0 THEN named ELSE list_distinct(list_filter([{_IMPLIED}], lambda v: v IS NOT NULL)) END AS actions FROM lists)"""
FEATURES_SQL = f"{REPORTS_SQL}, {LISTS_SQL}"


def _count(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(lower(x), '{t}') AS INTEGER)" for t in terms)


def _match_sql(d: catalog.Domain) -> str:
    tags = " + ".join(f"CAST(regexp_matches(x, '(?i){p}') AS INTEGER)" for _, p in d.tags)
    hosts = " OR ".join(f"source_id = '{h}' OR ends_with(source_id, '.{h}')" for h in d.hosts)
    extra = "0"
    if d.name == "learning":
        extra = (
            f"least(24, len(regexp_extract_all(x, '(?i){_q(relevance.LEARNING_PRIORITY)}')) * 8) - CASE WHEN regexp_matches(x, '(?i){_q(relevance.LEARNING_LOCAL)}') "
            f"AND NOT regexp_matches(x, '(?i){_q(relevance.LEARNING_NATIONAL)}') THEN 24 ELSE 0 END"
        )
    return f"""SELECT *, {extra} AS learning, topics * 4 + impacts * 1.5 + n_tags * 2.5 + least(len(entities), 3) + least(len(actions), 2) * 1.5
  + CAST(own AS INTEGER) * 5 + CAST(official AS INTEGER) * 8 + {extra} AS match,
  topics > 0 OR official OR (own AND acts) OR (n_tags > 0 AND acts) AS relevant
  FROM (SELECT *, {_count(d.topics)} AS topics, {_count(d.impacts)} AS impacts, {tags} AS n_tags, list_has_any(objects, {_listed(list(d.objects))}) AS own,
    reliability = 'primary' AND ({hosts}) AS official, len(entities) > 0 OR len(actions) > 0 AS acts FROM feat WHERE domain = '{d.name}')"""


_WORDS = "trim(regexp_replace(regexp_replace(lower(title), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_PATH = "regexp_replace(lower(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)), '/+$', '')"
_LISTING = f"""(regexp_matches({_WORDS}, '(?i){_q(checks.ARCHIVE_TITLE)}') OR regexp_matches({_WORDS}, '(?i){_q(checks.GENERIC_TITLE)}')
  OR ((regexp_matches({_PATH}, '{checks.LISTING_FOLDER}') OR regexp_matches({_PATH}, '{checks.LISTING_PAGE}')) AND NOT (len(entities) > 0 AND (len(named) > 0 OR len(objects) > 0))))"""


def _hits_judged_sql(d: catalog.Domain) -> str:
    tags = ", ".join(f"CASE WHEN regexp_matches(x, '(?i){p}') THEN '{t}' END" for t, p in d.tags)
    found = f"list_filter([{tags}], lambda v: v IS NOT NULL)"
    return f"""SELECT id, domain, reason, round(score, 6) AS score, tags, CASE WHEN reason = 'accepted' THEN substr(sha1('{d.name}:search:' || url), 1, 12) END AS candidate_id
  FROM (SELECT *, CASE WHEN {_LISTING} THEN 'non-article-page' WHEN NOT relevant THEN 'irrelevant' WHEN published_at < TIMESTAMP '{NOW}' - to_days({d.window_days}) THEN 'expired'
    WHEN published_at > TIMESTAMP '{NOW}' + to_hours(6) THEN 'future' ELSE 'accepted' END AS reason,
    CASE WHEN len({found}) > 0 THEN array_to_string(({found})[1:3], ',') ELSE '{d.default_tag}' END AS tags,
    CASE reliability WHEN 'primary' THEN 42.0 WHEN 'tier-1' THEN 36.0 WHEN 'tier-2' THEN 31.0 ELSE 24.0 END
    + coalesce(greatest(0.0, 36.0 - greatest(0.0, (epoch(TIMESTAMP '{NOW}') - epoch(published_at)) / 3600.0) / 4), 0.0) + least(impacts * 2.5, 18.0) + least(8.0, length(x) / 220)
    - CASE WHEN published_at IS NULL THEN 20.0 ELSE 0.0 END + learning + least(12.0, match / 2) + greatest(0.0, least(6.0, provider_score * 6)) AS score
    FROM ({_match_sql(d)}) AS m) AS j"""


_NORMAL = "regexp_replace(lower({0}), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"
_STOPS = _listed(lexicons.STOP_WORDS)


def _first_sql(key: str) -> str:
    return f"(SELECT min(o.wire) FROM t o WHERE o.event_id = r.event_id AND o.{key} = r.{key} AND o.source_id <> r.source_id)"


SYNDICATION_SQL = f"""{REPORTS_SQL},
t AS (SELECT *, {_wires_sql("x")} AS wire, {_NORMAL.format("title")} AS title_key, nullif({_NORMAL.format("description")}, '') AS text_key,
  list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS tokens,
  list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9][a-z0-9.-]*'), lambda v: length(v) > 1 AND NOT list_contains({_STOPS}, v))) AS words FROM reports),
u AS (SELECT *, {_first_sql("url")} AS by_url, {_first_sql("title_key")} AS by_title, {_first_sql("text_key")} AS by_text,
  (SELECT count(DISTINCT o.source_id) FROM t o WHERE o.event_id = r.event_id AND o.url = r.url) > 1 AS same_url,
  (SELECT count(DISTINCT o.source_id) FROM t o WHERE o.event_id = r.event_id AND o.title_key = r.title_key AND o.text_key IS NOT DISTINCT FROM r.text_key) > 1 AS same_both,
  (SELECT min(o.wire) FROM t o WHERE o.event_id = r.event_id AND o.wire IS NOT NULL AND NOT (o.title_key = r.title_key AND o.text_key IS NOT DISTINCT FROM r.text_key)
    AND len(list_intersect(o.tokens, r.tokens)) >= 0.9 * (len(o.tokens) + len(r.tokens) - len(list_intersect(o.tokens, r.tokens)))
    AND len(list_intersect(o.words, r.words)) >= 0.82 * (len(o.words) + len(r.words) - len(list_intersect(o.words, r.words)))) AS by_likeness FROM t r),
keyed AS (SELECT *, CASE WHEN wire IS NOT NULL THEN 'attribution' WHEN by_url IS NOT NULL THEN 'canonical-url' WHEN by_title IS NOT NULL THEN 'exact-title'
  WHEN by_text IS NOT NULL THEN 'exact-description' WHEN by_likeness IS NOT NULL THEN 'likeness' WHEN same_url THEN 'shared-url' WHEN same_both AND text_key IS NOT NULL THEN 'shared-text'
  ELSE 'publisher' END AS via, coalesce(wire, by_url, by_title, by_text, by_likeness, CASE WHEN same_url THEN 'content:url:' || substr(sha1(url), 1, 12) END,
  CASE WHEN same_both AND text_key IS NOT NULL THEN 'content:fingerprint:' || substr(sha1(title_key || ':' || text_key), 1, 12) END, 'publisher:' || source_id) AS key FROM u)"""

_NUMBER_WORDS = "x"
for _i, _w in enumerate(checks.NUMBER_WORDS):
    _NUMBER_WORDS = f"regexp_replace({_NUMBER_WORDS}, '(?i)\\b{_w}\\b', '{_i}', 'g')"

ORACLES: dict[str, str] = {
    "earlier_signals": f"WITH {REPORTS_SQL}, s AS (SELECT id, domain, list_filter([title, description, event_id, source_id, url], lambda v: v <> '') AS a FROM reports) "
    "SELECT id, domain, unnest(range(1, len(a) + 1)) AS position, unnest(a) AS signal FROM s",
    "names": f"WITH {REPORTS_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_concat({_hit_list('x', lexicons.ENTITIES)}, {_NAMES}))), ',') AS names FROM reports",
    "text_dates": f"WITH {REPORTS_SQL}, n AS (SELECT id, list_transform(list_concat({', '.join(f'''regexp_extract_all(x, '{p}', 1)''' for p in catalog.DATES[:2])}), "
    f"lambda v: trim(lower(v))) || list_transform(regexp_extract_all(x, '{catalog.DATES[2]}', 1), lambda v: trim(lower(v))) AS a FROM reports), "
    "o AS (SELECT id, unnest(a) AS v, unnest(range(len(a))) AS i FROM n), d AS (SELECT id, v, min(i) AS i FROM o GROUP BY 1, 2) "
    "SELECT n.id, coalesce(string_agg(v, ',' ORDER BY i), '') AS dates FROM n LEFT JOIN d USING (id) GROUP BY 1",
    "text_numbers": rf"WITH {REPORTS_SQL} SELECT id, array_to_string(list_transform(regexp_extract_all({_NUMBER_WORDS}, '\d[\d,.]*(?:\.\d+)?%?'), lambda v: lower(replace(v, ',', ''))), ' ') AS numbers FROM reports",
    "implied_actions": f"""WITH {REPORTS_SQL}, lists AS (SELECT *, {_hit_list("x", lexicons.OBJECTS)} AS objects, {_hit_list("x", lexicons.ACTIONS)} AS named FROM reports),
i AS (SELECT id, named, list_filter([{_IMPLIED}], lambda v: v IS NOT NULL) AS m FROM lists), o AS (SELECT id, unnest(m) AS v, unnest(range(len(m))) AS k FROM i WHERE len(named) = 0),
d AS (SELECT id, string_agg(v, ',' ORDER BY k) AS v FROM (SELECT id, v, min(k) AS k FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT i.id, CASE WHEN len(named) > 0 THEN array_to_string(named, ',') ELSE coalesce(v, '') END AS actions FROM i LEFT JOIN d USING (id)""",
    "domain_match": f"WITH {FEATURES_SQL}, m AS ({' UNION ALL '.join(f'SELECT id, domain, match, relevant FROM ({_match_sql(d)}) AS m' for d in catalog.DOMAINS)}) "
    "SELECT id, domain, CAST(round(match, 6) AS DOUBLE) AS match, relevant FROM m",
    "search_hits": f"WITH {FEATURES_SQL} {' UNION ALL '.join(_hits_judged_sql(d) for d in catalog.DOMAINS)}",
    "syndicated": f"WITH {SYNDICATION_SQL} SELECT id, wire, via, CASE WHEN via <> 'shared-text' THEN key END AS effective_key FROM keyed",
    "independent_grades": f"""WITH {SYNDICATION_SQL}, g AS (SELECT event_id, count(DISTINCT source_id) AS source_count,
  count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN key END) AS independent_count, bool_or(reliability = 'primary') AS p,
  bool_or(regexp_matches(x, '(?i){lexicons.RUMOR}')) AS rumor FROM keyed GROUP BY 1)
SELECT event_id, CASE WHEN p AND independent_count >= 1 THEN 'confirmed' WHEN independent_count >= 2 THEN 'corroborated' WHEN source_count = 1 AND rumor THEN 'unverified'
  WHEN source_count = 1 THEN 'single-source' ELSE 'unverified' END AS level, source_count, independent_count FROM g""",
    "event_dates": f"""WITH {REPORTS_SQL}, g AS (SELECT event_id, min(published_at) AS a, max(published_at) AS b, (epoch(max(published_at)) - epoch(min(published_at))) / 3600 AS h,
  count(DISTINCT CASE WHEN published_at IS NOT NULL THEN source_id END) AS s FROM reports GROUP BY 1)
SELECT event_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_at, floor(h * 10 + 0.5) / 10 AS spread_hours, h > 24 AND s > 1 AS date_conflict FROM g""",
    "false_merges": f"""WITH {REPORTS_SQL}, s AS (SELECT DISTINCT event_id, list_sort({_hit_list("x", lexicons.ACTIONS)}) AS a FROM reports),
n AS (SELECT DISTINCT event_id, list_sort(list_distinct(list_transform(regexp_extract_all(title, '\\d[\\d,.]*(?:\\.\\d+)?%?'), lambda v: lower(replace(v, ',', ''))))) AS a FROM reports),
c AS (SELECT event_id FROM reports GROUP BY 1 HAVING (epoch(max(published_at)) - epoch(min(published_at))) / 3600 > 24
  AND count(DISTINCT CASE WHEN published_at IS NOT NULL THEN source_id END) > 1),
r AS (SELECT DISTINCT l.event_id, 'conflicting-actions' AS reason FROM s l JOIN s r ON l.event_id = r.event_id AND len(l.a) > 0 AND len(r.a) > 0 AND NOT list_has_any(l.a, r.a)
  UNION SELECT DISTINCT l.event_id, 'conflicting-key-numbers' FROM n l JOIN n r ON l.event_id = r.event_id AND len(l.a) > 0 AND len(r.a) > 0 AND NOT list_has_any(l.a, r.a)
  UNION SELECT event_id, 'published-time-conflict' FROM c)
SELECT event_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1""",
    "dispositions": f"""WITH {REPORTS_SQL}, m AS (SELECT domain, id, event_id AS own FROM reports WHERE event_id IN (SELECT event_id FROM reports WHERE published_at IS NOT NULL)),
c AS (SELECT r.domain, r.id, r.published_at IS NOT NULL OR length(r.url) % 3 <> 0 AS stays, own,
  CASE WHEN starts_with(own, 'OpenAI:l') THEN '{SUBJECTS[1]}:{VERBS[1]}' ELSE own END AS event_id FROM reports r LEFT JOIN m USING (domain, id)),
j AS (SELECT *, CASE WHEN NOT stays THEN 'date-recovery-rejected' WHEN event_id IS NULL THEN 'unknown-date-no-event'
  WHEN event_id IN (SELECT own FROM m WHERE contains(own, 'rates')) THEN 'final-selected' WHEN own IN (SELECT own FROM m WHERE ends_with(own, 'acquires')) THEN 'preselected-not-final'
  ELSE 'not-preselected' END AS reason FROM c)
SELECT domain, id, event_id, CASE reason WHEN 'final-selected' THEN 'selected' WHEN 'preselected-not-final' THEN 'retained' ELSE 'eliminated' END AS outcome, reason FROM j""",
    "run_metrics": f"""WITH {REPORTS_SQL}, w AS (SELECT *, {_NORMAL.format("title")} AS print, CASE reliability WHEN 'primary' THEN 42 WHEN 'tier-1' THEN 36 WHEN 'tier-2' THEN 31 ELSE 24 END AS weight FROM reports),
a AS (SELECT * FROM w WHERE published_at IS NOT NULL OR weight > 30),
g AS (SELECT event_id, count(DISTINCT source_id) AS s, count(DISTINCT CASE WHEN reliability IN ('tier-1', 'tier-2') THEN source_id END) AS i, bool_or(reliability = 'primary') AS p,
  bool_or(regexp_matches(x, '(?i){lexicons.RUMOR}')) AS r, min(source_id) AS source_id, (epoch(max(published_at)) - epoch(min(published_at))) / 3600 > 24
  AND count(DISTINCT CASE WHEN published_at IS NOT NULL THEN source_id END) > 1 AS conflict FROM w GROUP BY 1),
f AS (SELECT *, CASE WHEN p AND i >= 1 THEN 'confirmed' WHEN i >= 2 THEN 'corroborated' WHEN s = 1 AND r THEN 'unverified' WHEN s = 1 THEN 'single-source' ELSE 'unverified' END AS level
  FROM g WHERE ends_with(event_id, 'acquires')),
v AS (SELECT (SELECT count(*) FROM w) AS candidates, (SELECT count(*) FROM w WHERE published_at IS NULL) AS missing, (SELECT count(*) FROM a WHERE published_at IS NULL) AS unresolved,
  (SELECT count(*) FROM g WHERE conflict) AS conflict_events, (SELECT count(*) FROM g) AS events, (SELECT count(*) FROM f) AS final_events, (SELECT count(*) FROM f WHERE p) AS official,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM f GROUP BY source_id)) AS most, (SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) FROM (SELECT count(*) AS n FROM a GROUP BY url)) AS u,
  (SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) FROM (SELECT count(*) AS n FROM a GROUP BY print)) AS c)
SELECT candidates, missing, floor(missing / candidates * 10000 + 0.5) / 10000 AS missing_ratio, unresolved, conflict_events, floor(conflict_events / events * 10000 + 0.5) / 10000 AS conflict_ratio,
  final_events, floor(official / final_events * 10000 + 0.5) / 10000 AS official_ratio, (SELECT count(*) FROM f WHERE level = 'unverified') AS unverified,
  (SELECT count(*) FROM f WHERE level = 'single-source') AS single_source, (SELECT count(*) FROM f WHERE level = 'corroborated') AS corroborated,
  (SELECT count(*) FROM f WHERE level = 'confirmed') AS confirmed, floor(most / final_events * 10000 + 0.5) / 10000 AS source_concentration,
  floor(u * 10000 + 0.5) / 10000 AS duplicate_url_ratio, floor(c * 10000 + 0.5) / 10000 AS duplicate_content_ratio FROM v""",
    "content_quality": f"""WITH {REPORTS_SQL}, s AS (SELECT domain, title, CASE WHEN doc_id % 2 = 0 THEN title || '. ' || description ELSE description END AS summary FROM reports),
t AS (SELECT domain, unnest([title, summary]) AS v FROM s), k AS (SELECT domain, count_if(starts_with(b, a) OR (length(a) > 12 AND contains(b, a))) AS n
  FROM (SELECT domain, {_NORMAL.format("title")} AS a, {_NORMAL.format("summary")} AS b FROM s) GROUP BY 1),
h AS (SELECT domain, count_if(regexp_matches(v, '(?i){_q(checks.HTML_ARTIFACT)}')) AS html, count_if(regexp_matches(p, '{_q(checks.ENGLISH_RUN)}') OR regexp_matches(p, '(?i){checks.DATE_STAMP}')) AS english
  FROM (SELECT domain, v, {_strip_sql("v")} AS p FROM t) GROUP BY 1)
SELECT domain, CAST(n AS BIGINT) AS repeated_summaries, CAST(html AS BIGINT) AS html_artifacts, CAST(english AS BIGINT) AS english_fragments FROM k JOIN h USING (domain)""",
    "snapshots": f"""WITH {REPORTS_SQL}, m AS (SELECT event_id, id, url, {_hit_list("title", lexicons.ENTITIES)} AS e, {_hit_list("x", lexicons.ACTIONS)} AS a,
  list_transform(regexp_extract_all(title, '\\d[\\d,.]*(?:\\.\\d+)?%?'), lambda v: lower(replace(v, ',', ''))) AS n FROM reports),
g AS (SELECT event_id, list_sort(list_distinct(list(id))) AS i, list_sort(list_distinct(list(url))) AS u, list_sort(list_distinct(flatten(list(e)))) AS e,
  list_sort(list_distinct(flatten(list(a)))) AS a, list_sort(list_distinct(flatten(list(n)))) AS n FROM m GROUP BY 1)
SELECT event_id, array_to_string(i, ',') AS article_ids, array_to_string(u, ',') AS article_urls, array_to_string(e, ',') AS entities, array_to_string(a, ',') AS actions,
  array_to_string(n, ',') AS numbers FROM g""",
    "listing_pages": f"WITH {FEATURES_SQL} SELECT id, {_LISTING} AS listing FROM feat",
}
