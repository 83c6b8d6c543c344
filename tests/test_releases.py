"""Releases and cached answers: what readers see between writes, and dates in pages."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.sources import releases


def test_readers_keep_the_old_release_until_the_new_one_is_committed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "digest")
    story = lambda title: spark.createDataFrame([("world", title), ("markets", title)], "domain string, title string")
    gate = lambda errors: spark.createDataFrame([("world", errors)], "domain string, errors string")
    assert releases.released(spark, root) is None
    assert not releases.release(story("held"), gate("count"), root, "2026-08-15") and releases.released(spark, root) is None
    assert releases.release(story("one"), gate(""), root, "2026-08-15")
    with monkeypatch.context() as broken:
        broken.setattr(releases, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            releases.release(story("two"), gate(""), root, "2026-08-16")
    titles = lambda day=None: {r.title for r in releases.released(spark, root, day).collect()}
    assert titles() == {"one"} and releases.released(spark, root, "2026-08-16") is None
    assert releases.release(story("two"), gate(""), root, "2026-08-16") and releases.release(story("again"), gate(""), root, "2026-08-15")
    assert titles("2026-08-15") == {"again"} and titles("2026-08-16") == {"two"} and titles() == {"again"}
    assert releases.released(spark, root).where("domain = 'world'").count() == 1


def test_the_last_write_of_a_query_is_read(spark, tmp_path):
    root = str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame(r, "query string, position int, url string")
    assert releases.cached_answers(spark, root, "2026-08-16") is None and not releases.is_complete(spark, root, "2026-08-16")
    releases.store_answers(rows(("AI  chips", 0, "a"), ("AI  chips", 1, "b"), ("oil", 0, "c")), root, "2026-08-16")
    releases.store_answers(rows((" ai CHIPS ", 0, "d")), root, "2026-08-16")
    releases.store_answers(rows(("oil", None, None)), root, "2026-08-16")
    releases.store_answers(rows(("late", 0, "e")), root, "2026-08-17")
    releases.store_answers(rows(("new form", 0, "f")), root, "2026-08-16", version=2)
    assert {r.url for r in releases.cached_answers(spark, root, "2026-08-16").collect()} == {"d"}
    assert {r.url for r in releases.cached_answers(spark, root, "2026-08-17").collect()} == {"e"}
    releases.mark_complete(spark, root, "2026-08-16")
    assert releases.is_complete(spark, root, "2026-08-16") and not releases.is_complete(spark, root, "2026-08-17") and not releases.is_complete(spark, root, "2026-08-16", 2)


def test_dates_of_pages(spark):
    ld = lambda body: f"<script id='x' type=\"application/ld+json\">{body}</script>"
    pages = [
        ld('{"@graph": [{"@type": "WebSite"}, {"author": {"datePublished": "nonsense"}}, {"deep": [[{"datePublished": "2026-08-03T01:02:03Z"}]]}]}') + '<meta name="datePublished" content="2026-01-01">',
        ld('{"a": {"datePublished": "2026-08-05"}, "datePublished": "2026-08-04"}'), ld("{broken") + "<META content='2026-08-06T00:00:00+02:00' Property='article:published_time'>",
        '<meta property="" name="datepublished" content="2026-08-07"><time class="x" datetime="2026-08-08">', "<p>2026-08-09</p>", None, ld("[" * 100_000),
        '<meta name="description" content="2026-08-01"><time datetime="later"><time datetime="2026-08-10 11:12:13">',
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", F.date_format(T.published_in(F.col("html")), "MM-dd HH:mm").alias("at")).orderBy("i")
    assert [r["at"] for r in df.collect()] == ["08-03 01:02", "08-04 00:00", "08-05 22:00", "08-08 00:00", None, None, None, "08-10 11:12"]
