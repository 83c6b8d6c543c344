"""RSS and Atom feeds that were landed as XML, a row for each feed, and what becomes of their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import catalog
from tidewire.functions.checks import is_non_article
from tidewire.functions.text import clean_url, strip_html, tags_of
from tidewire.operators import candidates as C
from tidewire.operators.relevance import with_signals
from tidewire.operators.tables import durable

SCHEMA = (
    "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>, "
    "entry array<struct<title: string, link: struct<_href: string>, summary: string, updated: string>>"
)


def feed_date(text: Column) -> Column:
    """A feed's date, RFC 822 or ISO; null if it is neither."""
    day = F.trim(F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s*", ""))
    forms = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")
    return F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in forms), F.try_to_timestamp(text))


def feed_items(landed: DataFrame, feed_col: str = "feed_id", xml_col: str = "xml") -> DataFrame:
    """feed_id, title, url, description, published_at of each item; XML that cannot be read gives no items."""
    read = landed.select(F.col(feed_col).alias("feed_id"), F.from_xml(F.col(xml_col), SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))
    rss = read.select("feed_id", F.explode("x.channel.item").alias("i")).select("feed_id", "i.title", "i.link", "i.description", F.col("i.pubDate").alias("at"))
    atom = read.select("feed_id", F.explode("x.entry").alias("i")).select("feed_id", "i.title", F.col("i.link._href").alias("link"), F.col("i.summary").alias("description"), F.col("i.updated").alias("at"))
    items = rss.unionByName(atom)
    return items.select("feed_id", strip_html(F.col("title")).alias("title"), clean_url(F.col("link")).alias("url"), strip_html(F.col("description")).alias("description"), feed_date(F.col("at")).alias("published_at"))


RESCUED = (
    "channel struct<item: array<struct<title: string, link: string, guid: string, description: string, pubDate: string>>>, "
    "entry array<struct<title: string, link: struct<_href: string>, id: string, summary: string, updated: string>>, broken string"
)


def read_feeds(landed: DataFrame) -> DataFrame:
    """(feed_id, status, items) of landed feeds (feed_id, xml), a row for each, whatever became of it.

    status: unreachable (nothing landed: null), broken (no XML), empty (no items) or read. items: title, link, description and
    date as written, in order; what has no link has its id. RSS items come before Atom entries.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    read = landed.select("feed_id", "xml", F.from_xml("xml", RESCUED, options).alias("x"))
    none = F.array().cast("array<struct<title: string, link: string, description: string, date: string>>")
    item = lambda title, link, text, at: F.struct(title.alias("title"), link.alias("link"), text.alias("description"), at.alias("date"))
    rss = F.transform("x.channel.item", lambda i: item(i["title"], F.coalesce(i["link"], i["guid"]), i["description"], i["pubDate"]))
    atom = F.transform("x.entry", lambda i: item(i["title"], F.coalesce(i["link"]["_href"], i["id"]), i["summary"], i["updated"]))
    rows = read.select("feed_id", "xml", F.col("x.broken").alias("broken"), F.concat(F.coalesce(rss, none), F.coalesce(atom, none)).alias("items"))
    status = F.when(F.col("xml").isNull(), "unreachable").when(F.col("broken").isNotNull(), "broken").when(F.size("items") == 0, "empty").otherwise("read")
    return rows.select("feed_id", status.alias("status"), F.when(status == "read", F.col("items")).otherwise(none).alias("items"))


def feed_decisions(landed: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """A row for each item of each feed, and one for each feed without any, with the first reason against it.

    landed: feed_id, xml; sources: feed_id, domain, source_id, reliability, weight and focused (all that it says is of its
    domain). Failed and empty feeds have their status as reason and no item. Items without a date, or with one that cannot
    be read, are of now. Accepted items have a score, tags and a candidate_id.
    """
    feeds = read_feeds(landed).join(sources, "feed_id")
    each = feeds.select("feed_id", "status", *(c for c in sources.columns if c != "feed_id"), F.posexplode_outer("items").alias("item", "i"))
    at = F.lit(now).cast("timestamp")
    rows = each.withColumns({
        "title": strip_html(F.col("i.title")), "url": clean_url(F.coalesce("i.link", F.lit(""))), "description": strip_html(F.col("i.description")),
        "published_at": F.coalesce(feed_date(F.col("i.date")), at),
    }).drop("i")
    failed = rows.where("item is null").select("feed_id", "domain", F.lit(None).cast("int").alias("item"), "title", "url", F.col("status").alias("reason"))
    featured, out = durable(C.with_features(rows.where("item is not null"))), None
    listing = is_non_article(F.col("title"), F.col("url"), C.specific())
    for d in catalog.DOMAINS:
        part = with_signals(featured.where(F.col("domain") == d.name), d)
        part = C.decided(part, now, d.window_days, F.col("focused") | F.col("relevant"), listing)
        part = C.with_score(part, now, d.impacts, d.name == "learning").withColumn("tags", tags_of(F.concat_ws(" ", "title", "description"), d))
        out = part if out is None else out.unionByName(part)
    name = F.concat_ws(":", "domain", "source_id", "url")
    kept = lambda c: F.when(F.col("accepted"), c)
    judged = out.withColumns({"score": kept(F.col("score")), "tags": kept(F.col("tags")), "candidate_id": kept(F.substring(F.sha1(name.cast("binary")), 1, 12))})
    judged = judged.select("feed_id", "domain", "item", "title", "url", "reason", "source_id", "published_at", "score", "tags", "candidate_id")
    return judged.unionByName(failed, allowMissingColumns=True)


def collected(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each domain of what a run collected: candidates of feeds and searches, their sources, feeds that failed.

    decisions as of feed_decisions(), whose rows without an item name the feeds that failed; found: domain and source_id of
    searches' candidates.
    """
    fed = decisions.where("reason = 'accepted'").select("domain", "source_id", F.lit(1).alias("fed"))
    both = fed.unionByName(found.select("domain", "source_id", F.lit(0).alias("fed")))
    counted = both.groupBy("domain").agg(F.count("*").alias("fetched"), F.sum("fed").alias("from_feeds"), F.sum(1 - F.col("fed")).alias("from_searches"), F.count_distinct("source_id").alias("sources"))
    broken = decisions.where(F.col("item").isNull() & F.col("reason").isin("unreachable", "broken"))
    failed = broken.groupBy("domain").agg(F.count("*").alias("failed"))
    rows = counted.join(failed, "domain", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("domain", *map(zero, ("fetched", "from_feeds", "from_searches", "sources", "failed")))
