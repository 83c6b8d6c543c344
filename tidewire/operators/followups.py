"""Follow-up searches: what to ask about an event, where, and which answers count as a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import catalog, lexicons
from tidewire.functions.text import hits, hostname, number_label, of_host
from tidewire.operators.events import match_reason

# Where a second source is looked for.
INDEPENDENT_HOSTS = ["reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "bloomberg.com", "ft.com", "cnbc.com", "theguardian.com"]
OFFICIAL_HOSTS = {
    "ai-tech": ["openai.com", "anthropic.com", "nvidia.com", "amd.com", "intel.com", "tsmc.com", "microsoft.com", "google.com"],
    "markets": ["federalreserve.gov", "bls.gov", "bea.gov", "sec.gov", "eia.gov", "treasury.gov"],
    "world": ["un.org", "nato.int", "consilium.europa.eu", "ec.europa.eu", "whitehouse.gov"],
    "learning": ["ibo.org", "oecd.org", "unesco.org", "worldbank.org"],
}
ENTITY_HOSTS = {
    "openai": "openai.com", "nvidia": "nvidia.com", "amd": "amd.com", "intel": "intel.com", "tsmc": "tsmc.com", "google": "google.com", "microsoft": "microsoft.com",
    "federal-reserve": "federalreserve.gov", "sec": "sec.gov", "oecd": "oecd.org", "unesco": "unesco.org", "international-baccalaureate": "ibo.org",
    "united-nations": "un.org",
}
NO_ENTITY = r"archive|news|latest|report"
NO_QUERY_START = r"^(?:archive|news|latest|report|homepage|read|more|sign|log)(?:\s|$)"
NO_TERM = r"^(?:archive|news|latest|report)$"


def _named(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), value), value)


def _joined(*parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(F.filter(F.concat(*parts), lambda v: v.isNotNull() & (v != "")), " "), r"\s+", " "))


def useful_entity(value: Column) -> Column:
    """Whether an entity says something in a query: no generic word, no stop words alone, four words at most."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(value), F.lit("."), F.lit("")), r"\s+", " "))
    words = F.split(plain, " ")
    stops = F.array(*map(F.lit, lexicons.STOP_WORDS))
    generic = plain.isin(*catalog.GENERIC_NAMES) | (F.size(F.array_except(words, stops)) == 0)
    return (plain != "") & ~generic & (F.size(words) <= 4) & ~plain.rlike(f"(?i){NO_QUERY_START}")


def verification_query(named_actions: Column, at: Column) -> Column:
    """What to ask about an event with these features (entities, objects, numbers): names, acts, things, amounts and the day."""
    entities = F.slice(F.filter("entities", lambda e: ~e.rlike(f"(?i){NO_ENTITY}")), 1, 3)
    numbers = F.transform(F.slice("numbers", 1, 3), number_label)
    return _joined(entities, F.slice(named_actions, 1, 2), F.slice("objects", 1, 2), numbers, F.array(F.date_format(at, "yyyy-MM-dd")))


def discovery_query(at: Column, anchors: Column | None = None) -> Column:
    """What to ask to learn more of an event's kind: useful names under their query names, known ones first, then acts, things,
    amounts, the day and what earlier runs found of it."""
    useful = F.filter("entities", useful_entity)
    rank = lambda e: F.struct((~e.isin(*catalog.ENTITY_LABELS)).cast("int").alias("o"), F.length(e).alias("n"), e.alias("e"))
    entities = F.transform(F.slice(F.array_sort(F.transform(useful, rank)), 1, 3), lambda r: _named(r["e"], catalog.ENTITY_LABELS))
    objects = F.transform(F.slice("objects", 1, 2), lambda o: _named(o, catalog.OBJECT_LABELS))
    numbers = F.transform(F.slice("numbers", 1, 2), number_label)
    parts = F.concat(entities, F.slice("actions", 1, 2), objects, numbers, F.array(F.date_format(at, "yyyy-MM-dd")), F.array().cast("array<string>") if anchors is None else anchors)
    return _joined(F.filter(F.array_distinct(parts), lambda v: ~v.rlike(f"(?i){NO_TERM}")))


def fallback_queries(domain: catalog.Domain, day: str) -> list[str]:
    """Two queries from a domain's topics for days with fewer than two events; day as in Shanghai."""
    first, second = domain.topics[:4], domain.topics[4:8] or domain.topics[:4]
    return [f"{' '.join(first)} {day}".strip(), f"{' '.join(second)} {day} independent".strip()]


def dynamic_queries(events: DataFrame, domain: catalog.Domain, day: str) -> list[str]:
    """The queries of the two best events of a domain (place, query), filled up from its topics. Reads no more than 20 rows."""
    rows = events.where("query <> ''").orderBy("place").limit(20).collect()
    found = list(dict.fromkeys(r["query"] for r in rows))
    return (found if len(rows) >= 2 else list(dict.fromkeys([*found, *fallback_queries(domain, day)])))[:2]


def verification_hosts(domain: Column, entities: Column, primary_present: Column) -> Column:
    """Hosts to look at: independent media where a primary source is known, else those of its entities and its domain, eight at most."""
    own = F.filter(F.transform(entities, lambda e: F.try_element_at(F.create_map(*(F.lit(x) for p in ENTITY_HOSTS.items() for x in p)), e)), lambda h: h.isNotNull())
    official = F.coalesce(*(F.when(domain == d, F.array(*map(F.lit, h))) for d, h in OFFICIAL_HOSTS.items()), F.array().cast("array<string>"))
    return F.when(primary_present, F.array(*map(F.lit, INDEPENDENT_HOSTS))).otherwise(F.slice(F.array_distinct(F.concat(own, official)), 1, 8))


def accepted_answers(events: DataFrame, answers: DataFrame) -> DataFrame:
    """(event_id, id, reason) for answers to events' queries, with the first reason against each.

    events: event_id, hosts, urls and the features of its first report; answers: event_id, id, url and features. An answer
    counts if its URL is new, its host is one of the event's, and it matches the first report strictly.
    """
    both = events.select("event_id", "hosts", "urls", *(F.col(c).alias(f"e_{c}") for c in events.columns if c not in ("event_id", "hosts", "urls"))).join(answers, "event_id")
    host = hostname(F.col("url"))
    targeted = F.exists("hosts", lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    reason = (
        F.when(F.array_contains("urls", F.col("url")), "duplicate-url")
        .when(~targeted, "source-target-mismatch")
        .otherwise(match_reason(lambda c: F.col(f"e_{c}"), F.col, strict=True))
    )
    return both.select("event_id", "id", reason.alias("reason"))


def method_of(query: Column, reliability: Column) -> Column:
    """How a search hit was found: on official hosts, or by search."""
    return F.when((reliability == "primary") | query.rlike(r"(?i)(?<![A-Za-z0-9_])site:"), "official-search").otherwise("search")


def known_official(host: Column) -> Column:
    return of_host(host, lexicons.OFFICIAL_HOSTS)


def named_actions(text: Column) -> Column:
    return hits(text, lexicons.ACTIONS)
