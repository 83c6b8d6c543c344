"""Leaders, set joins, matches, selection and sources against plain loops on small tables."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidewire import plans
from tidewire.functions import checks, quantities
from tidewire.operators import candidates, crossdomain, events, leaders, selection, setjoin, targets
from tidewire.sources import feeds, publish

DATA = "/root/testdata/sf0.001"


def test_leaders_match_a_plain_loop(spark):
    random.seed(5)
    rows = [(f"r{i:03}", i + 1, sorted({f"k{random.randrange(25)}" for _ in range(random.randint(1, 2))})) for i in range(80)]
    links = [(f"k{i}", f"k{i + 1}") for i in range(0, 24, 4)]
    near = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    kept, want = [], {}
    for id_, _, keys in rows:
        first = next((k for k, ks in kept if any(x == y or (x, y) in near for x in ks for y in keys)), None)
        want[id_] = first or id_
        if first is None:
            kept.append((id_, keys))
    members = spark.createDataFrame([(i, r, k) for i, r, ks in rows for k in ks], "id string, rank long, key string")
    both = spark.createDataFrame(sorted(near), "key string, other string")
    assert {r.id: r.leader for r in leaders.greedy_leaders(members, both).collect()} == want


def test_duplicates_and_matches_on_candidates(spark):
    df = candidates.with_features(plans._scored(spark, DATA)).persist()
    rows = {r.id: r for r in df.select("id", "domain", "rank").collect()}
    pairs = {(r.a, r.b) for r in events.duplicate_pairs(df).collect()}
    want = {}
    for domain in {r.domain for r in rows.values()}:
        kept = []
        for id_ in sorted((i for i, r in rows.items() if r.domain == domain), key=lambda i: rows[i].rank):
            want[id_] = next((k for k in kept if (k, id_) in pairs), id_)
            kept += [id_] if want[id_] == id_ else []
    assert {r.id: r.leader for r in events.deduplicated(df).collect()} == want
    left, right = df.select(*(F.col(c).alias(f"l_{c}") for c in events._PAIR)), df.select(*(F.col(c).alias(f"r_{c}") for c in events._PAIR))
    every = left.crossJoin(right).where("l_rank < r_rank").where(events.match_reason(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")) == "accepted")
    assert {(r.a, r.b) for r in events.match_pairs(df).collect()} == {(r.l_id, r.r_id) for r in every.select("l_id", "r_id").collect()}


def test_similar_sets(spark):
    random.seed(2)
    sets = {f"s{i}": set(random.choices("abcdefghij", k=random.randint(0, 8))) for i in range(60)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, tokens array<string>")
    for least in (0.5, 0.8):
        want = {(a, b) for a, x in sets.items() for b, y in sets.items() if x and y and len(x & y) / len(x | y) >= least}
        assert {(r.a, r.b) for r in setjoin.similar_sets(df, df, least).collect()} == want


def test_numbers_agree_within_tolerance(spark):
    cases = [(["usd:3b"], ["usd:3.04b"], True), (["usd:3b"], ["usd:3.1b"], False), (["4.5%"], ["452 bps"], True), ([], ["1%"], True), (["x"], ["x"], True), (["1%"], ["x"], False)]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>, want boolean")
    side = lambda c: F.transform(c, quantities.comparable)
    assert all(r.got == r.want for r in df.select("want", quantities.compatible(side("a"), side("b")).alias("got")).collect())


def test_slates_and_gates(spark):
    rows = [("d", f"e{i}", i + 1, f"h{i % 4}", f"n{i % 5}", "unverified" if i == 0 else "confirmed", "other" if i in (1, 2) else "tier-1") for i in range(9)]
    pool = spark.createDataFrame(rows, "domain string, id string, place long, source_id string, lead string, level string, reliability string")
    chosen = selection.preselect(pool, capped=True).join(pool.drop("place"), ["domain", "id"])
    slate = selection.slates(chosen)
    got = slate.orderBy("position").collect()
    assert len(got) == 5 and all(r.feasible for r in got)
    by_id = {r[1]: SimpleNamespace(source_id=r[3], lead=r[4], level=r[5], reliability=r[6]) for r in rows}
    assert selection.slate_is_valid([by_id[r.id] for r in got])
    stories = slate.join(pool.drop("place"), ["domain", "id"])
    assert [r.errors for r in selection.gate(stories).collect()] == [""]
    assert [r.errors for r in selection.gate(stories.where("position <= 2")).collect()] != [""]


def test_texts(spark):
    df = spark.createDataFrame([("Bearer abc sk-ABCDEFGH1 fine. All rights reserved by us! A second sentence here. Menu of the day for all of us.", "<b>x</b>")], "t string, h string")
    r = df.select(checks.redact_secrets(F.col("t")).alias("r"), checks.sentences(F.col("t")).alias("s"), checks.has_html_artifact(F.col("h")).alias("h")).first()
    assert r.r.startswith("Bearer [REDACTED] [REDACTED] fine.") and r.h
    assert "A second sentence here." in r.s and not any("Menu" in s or "rights reserved" in s for s in r.s)


def test_feeds_and_publishing(spark, tmp_path):
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://X.org/a?utm_source=f</link><description>d</description><pubDate>Sun, 16 Aug 2026 07:30:00 GMT</pubDate></item></channel></rss>"
    atom = "<feed><entry><title>C</title><link href=\"https://x.org/c\"/><summary>s</summary><updated>2026-08-16T07:30:00Z</updated></entry></feed>"
    landed = spark.createDataFrame([("r", rss), ("a", atom), ("bad", "nothing"), ("none", None)], "feed_id string, xml string")
    items = {r.feed_id: r for r in feeds.feed_items(landed).collect()}
    assert set(items) == {"r", "a"} and items["r"].url == "https://x.org/a" and items["a"].url == "https://x.org/c"
    assert items["r"].published_at == items["a"].published_at
    stories = spark.createDataFrame([("world", "1")], "domain string, id string")
    held, free = (spark.createDataFrame([("world", e)], "domain string, errors string") for e in ("count", ""))
    assert not publish.publish(stories, held, str(tmp_path / "out"), "2026-08-16") and not (tmp_path / "out").exists()
    assert publish.publish(stories, free, str(tmp_path / "out"), "2026-08-16")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_dates_are_recovered_within_the_budget(spark):
    page = lambda day: f'<meta property="article:published_time" content="2026-08-{day}T00:00:00Z">'
    rows = [("a", "u1", 5.0, None), ("b", "u1", 9.0, None), ("c", "u2", 7.0, None), ("d", "u3", 1.0, None), ("e", "u4", 8.0, None), ("f", "u5", 2.0, "2026-08-15 00:00:00")]
    df = spark.createDataFrame([(i, "world", u, "t", s, "other", p) for i, u, s, p in rows], "id string, domain string, url string, title string, score double, reliability string, at string")
    df = df.withColumn("published_at", F.col("at").cast("timestamp")).drop("at")
    pages = spark.createDataFrame([("u1", page(15)), ("u2", page("01")), ("u4", page(28)), ("u3", page(15))], "url string, html string")
    found = targets.date_records(df, pages, "2026-08-16 00:00:00", limit=3)
    assert {r.id: r.status for r in found.collect()} == {"a": "recovered", "b": "recovered", "c": "expired", "e": "future-dated"}
    after = {r.id: r for r in targets.with_recovered_dates(df, found, "2026-08-16 00:00:00").collect()}
    assert set(after) == {"a", "b", "d", "f"} and after["d"].published_at is None
    assert after["b"].score == 9.0 + 20 + 30 and after["f"].score == 2.0


def test_events_of_several_domains_are_merged(spark):
    def event(domain, id_, place, day, url, title, entities=(), actions=(), objects=(), fit=1.0):
        return (domain, id_, place, f"2026-08-{day} 00:00:00", [url], title.replace(" ", ""), title.split(), list(entities), list(actions), list(objects), [], list(entities), fit, 1.0)

    rows = [
        event("ai", "a1", 1, 10, "u1", "one two three", ["x"], ["launch"], ["model"]),
        event("ai", "a2", 2, 10, "u2", "other words here", ["y"], ["ban"], []),
        event("world", "w1", 1, 11, "u3", "one more title", ["x"], ["launch"], ["model"], fit=2.0),
        event("world", "w2", 2, 11, "u2", "same page again"),
        event("world", "w3", 3, 20, "u2", "same page but late"),
        event("world", "w4", 4, 10, "u9", "y bought it", ["y"], ["buy"], []),
        event("markets", "m1", 1, 12, "u8", "about y alone", ["y"], [], []),
        event("markets", "m2", 99, 10, "u1", "beyond the limit"),
    ]
    schema = "domain string, id string, place int, at string, urls array<string>, title_key string, title_tokens array<string>, title_entities array<string>, title_actions array<string>, title_objects array<string>, title_locations array<string>, entities array<string>, fit double, priority double"
    df = spark.createDataFrame(rows, schema).withColumn("last_at", F.col("at").cast("timestamp"))
    df = df.withColumn("title_quantities", F.transform(F.array().cast("array<string>"), quantities.comparable))
    pairs = {(r.a, r.b): r.confidence for r in crossdomain.cross_domain_pairs(df).collect()}
    assert pairs == {("a1", "w1"): "high", ("a2", "w2"): "high", ("a2", "m1"): "medium", ("m1", "w4"): "medium"}
    found = {r.id: (r.winner, r.kept) for r in crossdomain.merged(df, ["ai", "world", "markets"]).collect()}
    assert found == {"a1": ("w1", False), "w1": ("w1", True), "a2": ("a2", True), "w2": ("a2", False), "w3": ("w3", True), "w4": ("w4", True), "m1": ("m1", True)}
