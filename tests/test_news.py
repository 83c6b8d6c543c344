"""Features, ladders, syndication, claims, follow-ups, backups and diagnostics on small reports with known results."""

import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import catalog, checks, lexicons
from tidewire.functions import text as T
from tidewire.operators import backups, claims, diagnostics, events, followups, relevance, selection, syndication
from tidewire.operators import candidates as C

NOW = "2026-08-16 07:30:00"


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


REPORTS = [
    # id, event, source, tier, title, description, hours before now
    ("a", "e1", "reuters.com", "tier-1", "OpenAI launches chip factory", "OpenAI launches an AI chip factory worth $3 billion in Japan, a person said there.", 3),
    ("b", "e1", "bbc.com", "tier-1", "OpenAI launches chip factory", "OpenAI launches an AI chip factory worth $3 billion in Japan, a person said there.", 5),
    ("c", "e1", "ft.com", "tier-1", "OpenAI opens plant for chips", "The firm builds its own processors, the company said in a note to staff last week.", 7),
    ("d", "e2", "x.org", "other", "Federal Reserve holds rates steady", "AFP - The Federal Reserve keeps its policy rate at 4.5 percent.", 9),
    ("e", "e2", "y.org", "other", "Fed holds interest rates", "No change, the bank says.", 40),
    ("f", "e3", "un.org", "primary", "Iran warns on shipping route", "Vessels in the strait of Hormuz were warned.", None),
]


@pytest.fixture(scope="module")
def reports(spark):
    rows = spark.createDataFrame([(*r[:6], r[6], f"https://www.{r[2]}/{r[0]}") for r in REPORTS], "id string, event_id string, source_id string, reliability string, title string, description string, hours int, url string")
    at = F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=F.col("hours"))
    return rows.withColumn("published_at", at).withColumn("domain", F.when(F.col("event_id") == "e2", "markets").otherwise("ai-tech")).drop("hours")


def test_literals_of_patterns_lose_no_hit(spark):
    texts = [None, "", "ſec and İran", "U.S. SEC sues", "Strait of\nHormuz", "theft of student data", "slid; strengthened; CONTACTS", "大学竞争力下滑", "GROQ grok", "kids' products", "an identity leak"]
    for lexicon in (lexicons.ENTITIES, lexicons.ACTIONS, lexicons.OBJECTS, lexicons.LOCATIONS):
        plain = lambda v: F.filter(F.array(*(F.when(v.rlike(T.pattern(p)), F.lit(k)) for k, p in lexicon)), lambda x: x.isNotNull())  # noqa: B023, E731
        assert column(spark, texts, lambda v: T.hits(v, lexicon)) == column(spark, texts, plain)  # noqa: B023
    for lexicon in (lexicons.ENTITIES, lexicons.ACTIONS, lexicons.OBJECTS):
        for _, p in lexicon:
            assert T.needed(p) is None or all(len(x) >= 2 and x == x.lower() for x in T.needed(p))


def test_needed_takes_what_every_match_has():
    assert T.needed(r"\bacquir(?:e|es)\b|收购") == ("acquir", "收购")
    assert T.needed(r"\bu\.?s\.?\b") is None
    assert T.needed("raise[ds]?") == ("raise",)
    assert T.needed("vaccines?|covid-?19") == ("vaccine", "covid")


def test_names_dates_and_numbers(spark):
    texts = ["Quantum Bridge Labs joins OpenAI", "THE NEW Report says", "Acme Launches Widget", "plain words", None]
    assert column(spark, texts, T.named_entities) == [["openai", "quantum bridge labs"], [], [], [], []]
    dates = ["On 2026-08-01 and Aug 3, 2026, then aug 3, 2026; 2026年8月4日", "1999-01-01"]
    assert column(spark, dates, T.dates_in) == [["2026-08-01", "aug 3, 2026", "2026年8月4日"], []]
    assert column(spark, ["Ten of 1,200 rose 4.5%"], lambda v: T.number_tokens(checks.number_words(v))) == [["10", "1200", "4.5%"]]
    assert column(spark, ["usd:1.5b", "usd:3", "4 gw"], T.number_label) == ["$1.5 billion", "$3", "4 gw"]
    assert column(spark, ["Google and OpenAI", "nothing"], T.first_entity) == ["google", None]
    assert column(spark, ["CPI is out", "earthquake hits", "Fed cuts CPI"], lambda v: T.actions_of(v, T.hits(v, lexicons.OBJECTS))) == [["data-release"], ["occur"], ["reduce"]]
    a, b = column(spark, ["A title!", "a  TITLE"], T.fingerprint)
    assert a == b and re.fullmatch("[0-9a-f]{16}", a)
    assert column(spark, ["gpu policy paper funding", "rain"], lambda v: F.array_join(T.tags_of(v, catalog.AI_TECH), ",")) == ["芯片,政策,产业", "AI"]


def test_flags_and_repairs(spark):
    assert column(spark, ["", "Press release details", "公司发布相关更新", "OpenAI opens a plant"], checks.is_placeholder_title) == [True, True, True, False]
    assert column(spark, [" ", "具体细节以来源页面为准", "围绕学校发布；参与或受影响的主体还包括学生", "The bank cut rates."], checks.is_placeholder_summary) == [True, True, True, False]
    fragments = ["one two three four five six seven", "One two three", "中文 fri, 8/14/2026 - x", "a lot of words in lower case"]
    assert column(spark, fragments, checks.has_english_fragment) == [True, False, True, False]  # words of one letter break a run
    assert column(spark, ['x ```json\n{"a": 1}\n``` y', '{"b": 2}', "none"], checks.json_in) == ['{"a": 1}', '{"b": 2}', None]
    assert column(spark, ["cpi site:www.bls.gov site:sec.gov. site:x.org"], lambda v: checks.official_hosts_in(v, lexicons.OFFICIAL_HOSTS)) == [["bls.gov", "sec.gov"]]
    assert column(spark, ["First fact has 3 parts here. No digits at all."], checks.fact_sentences) == [["First fact has 3 parts here."]]
    assert column(spark, ["A long enough sentence. Another one stands here. Menu of things to do"], checks.sentences)[0][:2] == ["A long enough sentence.", "Another one stands here."]
    assert column(spark, ["中文字a", "abcdefgh中"], checks.enough_chinese) == [True, False]


def test_listing_pages(spark):
    rows = spark.createDataFrame(
        [(1, "News archive", "https://x.org/a"), (2, "Latest news 3", "https://x.org/a"), (3, "Some page", "https://x.org/tag/ai"), (4, "OpenAI launches chip", "https://x.org/tag/ai"), (5, "Some page", "https://x.org/2026")],
        "i int, title string, url string",
    ).withColumn("description", F.lit(""))
    found = C.with_features(rows).select("i", checks.is_non_article(F.col("title"), F.col("url"), C.specific()).alias("r")).collect()
    assert {r.i: r.r for r in found} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_search_hits_are_judged_by_relevance_before_dates(spark):
    rows = spark.createDataFrame(
        [("1", "OpenAI launches chip", 0), ("2", "A quiet walk", 30), ("3", "OpenAI launches chip", 30), ("4", "OpenAI launches chip", -1), ("5", "", 0), ("6", "OpenAI chip", None)], "id string, title string, days int"
    )
    at = F.lit(NOW).cast("timestamp") - F.make_dt_interval(days=F.col("days"))
    rows = rows.select("id", "title", F.lit("").alias("description"), F.lit("https://a.org/x").alias("url"), F.lit("a.org").alias("source_id"), F.lit("other").alias("reliability"), F.lit(24.0).alias("weight"), F.lit(2.0).alias("provider_score"), at.alias("published_at"))
    judged = C.hits_as_candidates(relevance.with_signals(C.with_features(rows), catalog.AI_TECH), catalog.AI_TECH, NOW)
    found = {r.id: (r.reason, r.candidate_id is not None) for r in judged.collect()}
    assert found == {"1": ("accepted", True), "2": ("irrelevant", False), "3": ("expired", False), "4": ("future", False), "5": ("missing-field", False), "6": ("accepted", True)}


def test_ranks_do_not_depend_on_ranges(spark):
    rows = spark.range(500).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("domain"), (F.col("id") % 7).cast("double").alias("score"),
        F.lit(NOW).cast("timestamp").alias("published_at"), F.lit("u").alias("url"), F.lit("t").alias("title"),
    )
    by: dict = {}
    for r in C.ranked(rows.repartition(7), "domain").collect():
        by.setdefault(r.domain, []).append(r)
    assert sum(map(len, by.values())) == 500
    for own in by.values():
        want = sorted(own, key=lambda r: (-r.score, r.id))
        assert [r.id for r in sorted(own, key=lambda r: r.rank)] == [r.id for r in want] and [r.rank for r in sorted(own, key=lambda r: r.rank)] == list(range(1, len(own) + 1))


def test_syndication(reports):
    keys = {r.id: (r.effective_key, r.via) for r in syndication.effective_keys(reports).collect()}
    assert keys["a"] == ("wire:reuters", "attribution")
    assert keys["b"] == ("wire:reuters", "exact-title")
    assert keys["c"] == ("publisher:ft.com", "publisher")
    assert keys["d"] == ("wire:afp", "attribution")
    grades = events.evidence(reports.join(syndication.effective_keys(reports).select("id", F.col("effective_key").alias("independence_key")), "id"))
    found = {r.event_id: (r.level, r.independent_count) for r in grades.collect()}
    assert found == {"e1": ("corroborated", 2), "e2": ("unverified", 0), "e3": ("single-source", 0)}


def test_strict_matches_need_entity_action_and_object(reports):
    rows = C.with_features(reports.where("event_id = 'e1'"))
    both = rows.select(*(F.col(c).alias(f"l_{c}") for c in rows.columns)).crossJoin(rows.select(*(F.col(c).alias(f"r_{c}") for c in rows.columns)))
    for strict in (False, True):
        reason = events.match_reason(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"), strict)
        got = {(r.l_id, r.r_id): r.r for r in both.select("l_id", "r_id", reason.alias("r")).collect()}
        assert got[("a", "b")] == got[("b", "a")] == "accepted"
        assert got[("a", "c")] == got[("c", "a")] == "action-mismatch"


def test_claims(spark, reports):
    stated = spark.createDataFrame([("e1", "OpenAI launches a chip factory worth $3 billion"), ("e2", "具体细节以来源页面为准")], "event_id string, claim string")
    found = {(r.event_id, r.id): r.supports for r in claims.supported(stated, C.with_features(reports)).collect()}
    assert found[("e1", "a")] and found[("e1", "b")] and not found[("e1", "c")]
    assert not found[("e2", "d")] and not found[("e2", "e")]
    rows = C.with_features(spark.createDataFrame([("CPI rises in China", "PPI falls in Japan"), ("OpenAI launches chip", "OpenAI launches model")], "title string, other string").withColumn("description", F.lit("")))
    other = C.with_features(rows.select(F.col("title").alias("was"), F.col("other").alias("title"), F.lit("").alias("description")))
    both = rows.select(*(F.col(c).alias(f"l_{c}") for c in rows.columns)).join(other, F.col("l_title") == F.col("was"))
    a, b = (lambda c: F.col(f"l_{c}")), F.col
    got = {r.was: (r.m, r.k, r.d) for r in both.select("was", claims.matches(a, b).alias("m"), claims.conflicts(a, b).alias("k"), claims.adds_detail(a, b).alias("d")).collect()}
    assert got == {"CPI rises in China": (False, True, True), "OpenAI launches chip": (True, False, False)}


def test_numbers_borne_out(spark):
    rows = spark.createDataFrame([(1, "Profit was $3 billion", "Profit made $3.01 billion"), (2, "Profit was $3 billion", "It made $9 billion"), (3, "There are 12 rooms", "a dozen, 12, rooms"), (4, "There are 12 rooms", "none")], "i int, c string, r string")
    claim = C.with_features(rows.select("i", F.col("c").alias("title"), F.lit("").alias("description")))
    report = C.with_features(rows.select("i", F.lit("").alias("title"), F.col("r").alias("description")))
    both = claim.select("i", *(F.col(c).alias(f"c_{c}") for c in claim.columns)).join(report, "i")
    got = both.select("i", claims.numbers_borne_out(lambda c: F.col(f"c_{c}"), F.col, T.number_tokens(F.col("c_title")), F.lower(checks.number_words(F.col("description")))).alias("r")).collect()
    assert {r.i: r.r for r in got} == {1: True, 2: False, 3: True, 4: False}


def test_follow_ups(spark, reports):
    useful = column(spark, ["openai", "news", "latest thing", "the new", "a b c d e", "acme corp"], followups.useful_entity)
    assert useful == [True, False, False, False, False, True]
    rows = C.with_features(reports)
    asked = {r.id: r for r in rows.select("id", followups.verification_query(F.col("actions"), F.col("published_at")).alias("q"), followups.discovery_query(F.col("published_at")).alias("d"), followups.verification_hosts(F.col("domain"), F.col("entities"), F.col("reliability") == "primary").alias("h")).collect()}
    assert asked["a"].q.startswith("openai") and asked["a"].q.endswith("$3 billion 2026-08-16")
    assert "Federal Reserve 美联储" in asked["d"].d and "interest rate" in asked["d"].d
    assert asked["a"].h[0] == "openai.com" and asked["f"].h == followups.INDEPENDENT_HOSTS
    assert followups.fallback_queries(catalog.WORLD, "2026-08-16") == ["war conflict diplomacy sanction 2026-08-16", "election trade security military 2026-08-16 independent"]
    some = spark.createDataFrame([(1, "x y"), (2, "")], "place int, query string")
    assert followups.dynamic_queries(some, catalog.WORLD, "d") == ["x y", "war conflict diplomacy sanction d"]


def test_second_sources(spark, reports):
    rows = C.with_features(reports)
    event = rows.where("id = 'a'").withColumn("hosts", F.array(F.lit("bbc.com"))).withColumn("urls", F.array(F.lit("https://www.bbc.com/old")))
    answers = rows.where("id in ('b', 'c')").unionByName(rows.where("id = 'b'").withColumn("id", F.lit("g")).withColumn("url", F.lit("https://www.bbc.com/old")))
    found = {r.id: r.reason for r in followups.accepted_answers(event, answers).collect()}
    assert found == {"b": "accepted", "c": "source-target-mismatch", "g": "duplicate-url"}


def options(spark, rows):
    return spark.createDataFrame(rows, "domain string, id string, original int, priority double, source_id string, lead string, level string, reliability string")


def test_backups_take_the_slate_with_the_fewest_faults(spark):
    kept = [("world", f"k{i}", i, 10.0, f"s{i % 3}", f"l{i}", "confirmed", "tier-1") for i in range(1, 5)]
    bad = ("world", "k5", 5, 10.0, "s0", "l5", "unverified", "other")
    spare = [("world", "b1", None, 50.0, "s1", "l1", "confirmed", "tier-1"), ("world", "b2", None, 40.0, "s2", "l9", "confirmed", "primary")]
    rows = options(spark, [*kept, *spare])
    got = backups.stabilized(rows).orderBy("position").collect()
    assert [r.id for r in got] == ["k1", "k2", "k3", "k4", "b1"] or [r.id for r in got] == ["k1", "k2", "k3", "k4", "b2"]
    assert {r.errors for r in got} == {""}
    worse = backups.stabilized(options(spark, [*kept, bad])).collect()
    assert {r.id for r in worse} == {"k1", "k2", "k3", "k4", "k5"}
    before = spark.createDataFrame([("world", "k5", 5), ("world", "k1", 1)], "domain string, id string, position int")
    after = spark.createDataFrame([("world", "k1", 1), ("world", "b1", 2)], "domain string, id string, position int")
    out = backups.replacements(before, after, spark.createDataFrame([("world", "k5")], "domain string, id string")).collect()
    assert [tuple(r) for r in out] == [("world", "k5", "b1", "cross-domain-duplicate")]
    two = options(spark, [*kept, *spare, *[("markets", f"m{i}", i, 5.0, f"t{i}", f"q{i}", "confirmed", "tier-1") for i in range(1, 7)]])
    free = backups.without_shared(two, spark.createDataFrame([("k1", "m1")], "a string, b string")).collect()
    assert "m1" not in {r.id for r in free} and len(free) == 10


def test_backup_priority(spark):
    row = spark.createDataFrame([("markets", "财报 利率", 10.0, 8.0, "primary")], "domain string, text string, score double, fit double, reliability string")
    got = row.select(backups.backup_priority(*(F.col(c) for c in row.columns)).alias("p")).first().p
    assert got == 10 + 2 + 8 + 5


def test_caps_of_a_preselection():
    from collections import namedtuple

    Row = namedtuple("Row", "id source_id lead level reliability")
    rows = [Row(str(i), "s" if i < 4 else f"t{i}", f"l{i}", "unverified" if i == 4 else "confirmed", "other" if i in (5, 6) else "tier-1") for i in range(9)]
    assert [r.id for r in selection._in_turn(rows, ("source", "lead"), 5, late="unverified")] == ["0", "1", "5", "6", "7"]
    assert [r.id for r in selection._in_turn(rows, tuple(selection.CAPS), 9)][:6] == ["0", "1", "4", "5", "7", "8"]


def test_diagnostics(spark, reports):
    rows = reports.withColumn("actions", T.hits(F.concat_ws(" ", "title", "description"), lexicons.ACTIONS)).withColumn("numbers", F.array(F.col("id")))
    found = {r.event_id: r.reasons for r in diagnostics.false_merges(rows, events.date_ranges(reports).where("date_conflict")).collect()}
    assert "conflicting-key-numbers" in found["e1"] and "published-time-conflict" in found["e2"] and "e3" not in found
    merged = spark.createDataFrame([("m", "world", "Iran warns ships", ["iran"], ["warn"], NOW), ("n", "world", "Iran warns all ships", ["iran"], ["warn"], NOW), ("o", "world", "Other", ["x"], ["y"], NOW)], "id string, domain string, title string, entities array<string>, actions array<string>, at string")
    pairs = diagnostics.missed_merges(merged.withColumn("at", F.col("at").cast("timestamp")).withColumn("tokens", T.title_tokens(F.col("title")))).collect()
    assert [(r.a, r.b) for r in pairs] == [("m", "n")]


def test_reading_publishing_and_reliability(spark, tmp_path):
    from tidewire.sources import news, publish

    path = str(tmp_path / "hits")
    spark.createDataFrame([("2026-08-16", "a"), ("2026-08-15", "b")], "date string, title string").write.json(path)
    assert [r.title for r in news.read_json_lines(spark, path, "date string, title string", "2026-08-16").collect()] == ["a"]
    for run in ("r1", "r2"):
        publish.write_diagnostics(spark.createDataFrame([(1, "Bearer abcdefgh hunter22")], "i int, note string"), str(tmp_path / "runs"), run, ("hunter22",))
    noted = spark.read.json(str(tmp_path / "runs")).orderBy("run_id").collect()
    assert [(r.run_id, r.note) for r in noted] == [("r1", "Bearer [REDACTED] [REDACTED]"), ("r2", "Bearer [REDACTED] [REDACTED]")]
    hosts = ["www.sec.gov", "feeds.bbc.co.uk", "x.org"]
    assert column(spark, hosts, lambda v: selection.effective_reliability(v, F.lit("other"))) == ["primary", "tier-1", "other"]
    stories = spark.createDataFrame([("w", "a", 1, "unverified", "tier-1"), ("w", "b", 2, "confirmed", "other"), ("w", "c", 3, "confirmed", "tier-1")], "domain string, id string, position long, level string, reliability string")
    assert [(r.id, r.position) for r in selection.renumbered(stories).orderBy("position").collect()] == [("c", 1), ("a", 2), ("b", 3)]


def test_earlier_digests(spark, tmp_path):
    import json

    from tidewire.sources import history

    assert history.previous_signals(history.landed_digests(spark, str(tmp_path / "none"))).count() == 0
    story = {"title": "A", "summary": "", "keyFacts": ["f", None], "trend": {"signalsToWatch": ["s"]}}
    briefings = [{"domain": "world", "stories": [story, {"title": "B"}], "watchNext": ["w"]}, {"domain": "world", "stories": [{"title": "late"}]}, {"domain": "markets", "watchNext": ["x"]}]
    (tmp_path / "d.json").write_text(json.dumps({"briefings": briefings}, indent=1))
    (tmp_path / "broken.json").write_text("{nothing")
    landed = history.landed_digests(spark, str(tmp_path / "*.json"))
    signals = [(r.domain, r.position, r.signal) for r in history.previous_signals(landed).orderBy("domain", "position").collect()]
    assert signals == [("markets", 1, "x"), *(("world", i + 1, v) for i, v in enumerate("AfsBw"))]
    assert [(r.domain, r.title) for r in history.previous_titles(landed).orderBy("position").collect()] == [("world", "A"), ("world", "B")]


def test_streams(spark, tmp_path):
    from tidewire.streaming import candidates as S

    rows = spark.createDataFrame([("https://a.org/x?utm_source=f", NOW, "w"), ("https://a.org/x", "2026-08-16 07:40:00", "w"), ("https://a.org/y", "2026-08-16 09:00:00", "m"), ("https://a.org/z", None, "m")], "url string, published_at string, domain string")
    rows.withColumn("published_at", F.col("published_at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, published_at timestamp, domain string").parquet(str(tmp_path / "in"))
    for name, query, mode in (("first", S.first_reports(stream), "append"), ("counted", S.counts(stream, "domain"), "complete")):
        run = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted(r.url for r in spark.table("first").collect()) == ["https://a.org/x", "https://a.org/y"]
    assert sorted((str(r.start), r.domain, r.n) for r in spark.table("counted").collect()) == [("2026-08-16 07:00:00", "w", 2), ("2026-08-16 09:00:00", "m", 1)]


def test_batches_of_names_and_number_words_are_as_the_patterns(spark):
    texts = ["oneſix ſıx TEN aone one1 Seven-eight; tenth fıve fİve", "Acme Labs. and OpenAI\nLabs, Foo-Bar.Baz Partners With AB_C Acme Labs", None]
    assert column(spark, texts, checks.number_words) == ["oneſix 6 10 aone one1 7-8; tenth 5 5", texts[1], None]
    assert column(spark, texts, T.named_entities) == [["ten", "seven-eight"], ["openai", "acme labs"], []]


def test_number_words_take_one_pass(spark):
    plan = spark.createDataFrame([("x",)], "c string").select(checks.number_words(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # there were eleven, one after the other


def test_copies_that_differ_a_little_meet_by_their_words(spark):
    words = [f"w{i:03}" for i in range(100)]
    texts = [words, [*words[:95], *(f"x{i}" for i in range(5))], [*words[:80], *(f"y{i}" for i in range(20))], [], []]
    rows = [("e", str(i), f"s{i}", f"u{i}", "Acme Labs opens a new plant in Ohio", " ".join(t) or ("!" if i == 3 else "1")) for i, t in enumerate(texts)]
    rows[0] = (*rows[0][:5], rows[0][5] + " (Reuters)")
    rows[3] = (*rows[3][:2], "reuters.com", *rows[3][3:])
    rows.append(("e", "9", "s9", "u9", "Another title of it all", " ".join(words)))
    found = syndication.effective_keys(spark.createDataFrame(rows, "event_id string, id string, source_id string, url string, title string, description string")).collect()
    got = {r.id: r.via for r in found}
    assert got["0"] == got["3"] == "attribution" and got["1"] in ("exact-title", "likeness") and got["9"] in ("publisher", "exact-description")
    apart = [(*r[:4], f"{r[4]} {'of late' if r[1] == '1' else ''}", r[5]) for r in rows]
    far = [(*r[:4], "Nothing like it " + r[1], r[5]) for r in rows]
    for given, want in ((apart, 1), (far, 0)):
        df = spark.createDataFrame(given, "event_id string, id string, source_id string, url string, title string, description string")
        tokens = [set(r[4].lower().split()) for r in given]
        near = len(tokens[0] & tokens[1]) >= 0.9 * len(tokens[0] | tokens[1])
        assert ({r.id: r.via for r in syndication.effective_keys(df).collect()}["1"] == "likeness") == near


def test_texts_are_compared_only_where_titles_agree(spark, monkeypatch):
    from tidewire.operators import syndication

    head = "One two three four five six seven eight nine ten"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [("e", "n", "a.org", "https://a.org/n", f"{head} eleven", f"{text} Reuters")] + [("e", "q", "b.org", "https://b.org/q", head, text)]
    rows += [("e", str(i), "c.org", f"https://c.org/{i}", f"Title {i} of its own", f"{text} and {i}") for i in range(20)]
    rows += [("e", str(i), "d.org", f"https://d.org/{i}", f"{head} eleven", f"Text of {i}") for i in (20, 21)]  # settled by their title
    seen, near = [], syndication._near_classes
    monkeypatch.setattr(syndication, "_near_classes", lambda classes, *rest: seen.append({r.id for r in classes.collect()} if "id" in classes.columns else classes.count()) or near(classes, *rest))
    found = {r.id: r.via for r in syndication.effective_keys(spark.createDataFrame(rows, "event_id string, id string, source_id string, url string, title string, description string")).collect()}
    assert found == {"n": "attribution", "q": "likeness", "20": "exact-title", "21": "exact-title"} | {str(i): "publisher" for i in range(20)}
    assert seen == [{"n", "q"}]
