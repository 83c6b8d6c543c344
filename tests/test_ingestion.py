"""Feeds whatever became of them, and evaluation by stages and labels against plain loops."""

import itertools
import random

from tidewire.operators import benchmarks as B
from tidewire.sources import feeds

NOW = "2026-08-16 07:30:00"


def test_every_feed_is_a_row(spark):
    rss = "<rss><channel><item><title>A &amp;amp; B</title><link>https://x.org/1?utm_source=f</link><description>d</description><pubDate>Sun, 16 Aug 2026 07:30:00 GMT</pubDate></item><item><guid isPermaLink='false'>https://x.org/2</guid></item></channel></rss>"
    atom = "<feed><entry><title>T</title><id>https://y.org/9</id><summary>s</summary><updated>2026-08-15T01:02:03Z</updated></entry></feed>"
    landed = [("rss", rss), ("atom", atom), ("none", None), ("cut", rss[:-20]), ("text", "no xml at all"), ("empty", "<rss><channel></channel></rss>"), ("blank", "")]
    found = {r.feed_id: (r.status, [(i.title, i.link) for i in r["items"]]) for r in feeds.read_feeds(spark.createDataFrame(landed, "feed_id string, xml string")).collect()}
    assert found["rss"] == ("read", [("A &amp; B", "https://x.org/1?utm_source=f"), (None, "https://x.org/2")])
    assert found["atom"] == ("read", [("T", "https://y.org/9")])
    assert {k: v[0] for k, v in found.items() if k not in ("rss", "atom")} == {"none": "unreachable", "cut": "broken", "text": "broken", "empty": "empty", "blank": "broken"}


def test_the_first_reason_against_an_item(spark):
    item = lambda title, link, at, text="OpenAI launches a chip": f"<item><title>{title}</title><link>{link}</link><description>{text}</description><pubDate>{at}</pubDate></item>"
    good, old, late = "Sat, 15 Aug 2026 07:30:00 GMT", "Sat, 01 Aug 2026 07:30:00 GMT", "Mon, 17 Aug 2026 07:30:00 GMT"
    items = [
        item("OpenAI launches AI chip", "https://x.org/a", good), item("", "https://x.org/b", good), item("OpenAI launches AI chip", "", good), item("Archive", "https://x.org/archive", good),
        item("OpenAI launches AI chip", "https://x.org/c", old), item("OpenAI launches AI chip", "https://x.org/d", late), item("Weather is fine", "https://x.org/e", good, "Sun all week"),
        item("OpenAI launches AI chip", "https://x.org/f", "soon"),
    ]
    xml = f"<rss><channel>{''.join(items)}</channel></rss>"
    landed = spark.createDataFrame([("all", xml), ("own", xml), ("cut", "<rss><chan")], "feed_id string, xml string")
    source = "feed_id string, domain string, source_id string, reliability string, weight double, focused boolean"
    sources = spark.createDataFrame([("all", "ai-tech", "x.org", "other", 24.0, False), ("own", "ai-tech", "y.org", "primary", 42.0, True), ("cut", "world", "z.org", "other", 24.0, False)], source)
    found = feeds.feed_decisions(landed, sources, NOW).persist()
    reasons = {(r.feed_id, r.item): r.reason for r in found.collect()}
    want = ["accepted", "missing-field", "missing-field", "non-article-page", "expired", "future", "irrelevant", "accepted"]
    assert [reasons["all", i] for i in range(8)] == want
    assert [reasons["own", i] for i in range(8)] == [*want[:6], "accepted", "accepted"]  # all that it says is of its domain
    assert reasons["cut", None] == "broken" and len(reasons) == 17
    kept = found.where("reason = 'accepted'").collect()
    assert all(r.score > 0 and len(r.candidate_id) == 12 for r in kept) and len({r.candidate_id for r in kept}) == 5
    searched = spark.createDataFrame([("ai-tech", "x.org"), ("ai-tech", "s.org"), ("learning", "s.org")], "domain string, source_id string")
    rows = {r.domain: (r.fetched, r.from_feeds, r.from_searches, r.sources, r.failed) for r in feeds.collected(found, searched).collect()}
    assert rows == {"ai-tech": (7, 5, 2, 3, 0), "learning": (1, 0, 1, 1, 0), "world": (0, 0, 0, 0, 1)}


def test_stages_match_a_plain_loop(spark):
    rng = random.Random(5)
    stages = [*B.STAGES, "unheard-of"]
    own = [(f"c{rng.randrange(40)}", i, rng.choice(stages)) for i in range(60)]
    decisions = [(rng.choice([None, *(f"c{i}" for i in range(50))]), i, rng.choice(["rss", "base", "dynamic", "verification"]), rng.random() < 0.5) for i in range(60)]
    members = [(f"e{rng.randrange(12)}", f"c{rng.randrange(60)}") for _ in range(80)]
    final = {f"e{i}" for i in range(0, 12, 2)}
    stage = {c: s for c, _, s in own}
    stage |= {c: p if p == "rss" else f"{p}-search" for c, _, p, ok in decisions if ok and c}
    found = {e: [s for s in B.STAGES if any(stage.get(c) == s for x, c in members if x == e)] for e in {e for e, _ in members}}
    first = {e: (s or [B.STAGES[-1]])[0] for e, s in found.items()}
    want = {s: (sum(v == s for v in first.values()), sum(v == s and e in final for e, v in first.items()), sum(s in v and e in final for e, v in found.items())) for s in B.STAGES}
    known = B.candidate_stages(spark.createDataFrame(own, "id string, place int, stage string"), spark.createDataFrame(decisions, "candidate_id string, place int, phase string, accepted boolean"))
    events = B.event_stages(spark.createDataFrame(members, "event_id string, id string"), known)
    got = B.contribution(events, spark.createDataFrame([(e,) for e in final], "event_id string")).collect()
    assert {r.stage: (r.new_events, r.final_events, r.supported_events) for r in got} == want


def test_benchmark_matches_a_plain_loop(spark):
    frame = spark.createDataFrame
    gold = [("g1", "world", ["official", "wire-copy"]), ("g2", "markets", ["official", "independent-media"]), ("g3", "learning", None)]
    articles = [("g1", "https://a/1/", "k1"), ("g1", "https://a/2", "k1"), ("g2", "https://b/1", "k2"), ("g2", "https://b/2", "k1"), ("g3", "https://q/9", "k3"), ("g1", "https://a/2", "k1")]
    titles = [("g2", "Fed cuts rates again"), ("g3", "Nobody wrote about this")]
    events = [("e1", 1, "War talks", "world", True, 0, True), ("e2", 2, "Fed cuts rates", "ai-tech", False, 2, False), ("e3", 3, "Other", "world", True, 1, False)]
    urls = [("e1", "https://a/1"), ("e1", "https://b/2/"), ("e2", "https://a/2"), ("e3", "https://a/2"), ("e2", "https://b/1")]
    candidates = [("c1", 1, "https://a/1", "x"), ("c2", 2, None, "Fed cuts rates again today")]
    owner, final = [("e2", "markets")], ["e1"]
    cluster_of = {u.rstrip("/"): e for e, u in sorted(urls, key=lambda r: r[0])}
    labelled = [(cluster_of[u.rstrip("/")], k) for _, u, k in articles if u.rstrip("/") in cluster_of]
    pairs = list(itertools.combinations(labelled, 2))
    both = sum(a[0] == b[0] and a[1] == b[1] for a, b in pairs)
    precision, recall = both / sum(a[0] == b[0] for a, b in pairs), both / sum(a[1] == b[1] for a, b in pairs)
    got = B.benchmark_metrics(
        frame(gold, "gold_id string, domain string, expected array<string>"), frame(articles, "gold_id string, url string, cluster string"), frame(titles, "gold_id string, title string"),
        frame(candidates, "id string, place int, url string, title string"),
        frame(events, "event_id string, place int, title string, domain string, primary_present boolean, independent_count int, copies boolean"), frame(urls, "event_id string, url string"),
        frame(owner, "event_id string, owner string"), frame([(e,) for e in final], "event_id string"),
    ).first()
    # g1 meets e1 by a URL; g2 meets e1 too, the first event with one of its URLs; g3 meets nothing
    assert (got.candidate_recall, got.final_recall) == (0.6667, 0.6667)
    assert (got.clustering_precision, got.clustering_recall) == (round(precision, 4), round(recall, 4))
    assert got.domain_accuracy == 0.5 and got.source_coverage == 0.75


def test_verification_counts_new_reports_of_known_events(spark):
    frame = spark.createDataFrame
    before, after = frame([("a", "single-source"), ("b", "confirmed")], "event_id string, level string"), frame([("a", "confirmed"), ("b", "confirmed"), ("n", "unverified")], "event_id string, level string")
    old, new = frame([("a", "1"), ("b", "2")], "event_id string, id string"), frame([("a", "1"), ("a", "3"), ("a", "3"), ("b", "2"), ("n", "4")], "event_id string, id string")
    got = {r.event_id: (r.level_before, r.level_after, r.change, r.added) for r in B.verification_changes(before, after, old, new).collect()}
    assert got == {"a": ("single-source", "confirmed", "better", 1), "b": ("confirmed", "confirmed", "same", 0), "n": ("unverified", "unverified", "same", 0)}
    levels = {r.event_id: r.level for r in B.final_evidence(before, after.where("event_id = 'a'")).collect()}
    assert levels == {"a": "confirmed", "b": "confirmed"}
