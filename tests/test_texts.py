"""Text steps that look for what is rare first, against the plain patterns; and what plans of the larger queries leave out."""

from pyspark.sql import functions as F

from tidewire import plans
from tidewire.functions import catalog, checks, lexicons
from tidewire.functions import text as T
from tidewire.operators import candidates as C
from tidewire.operators import relevance

LISTS = (lexicons.OBJECTS, lexicons.ENTITIES, lexicons.LOCATIONS, lexicons.ACTIONS)
TEXTS = [
    "", "a  b\n\tc\x01d�� e", "U.S. officials meet US and u.s teams; trust us.", "AT&T &amp; Co<b>x</b> ''quoted'' ““twice””", "Identity data will leak, the breach of identity",
    "Chips and apps in the classroom with AI", "\"\x01\" \"\" ﾟ　全角 数据泄露 中国 美国", "AI literacy, assessment and OECD; curriculum reform in a local school", "May 5, 2026 and 2026-08-14, 8月14日",
    "It fell. He said so! Well? Yes. no. 第一句。 第二句！ > | End • All rights reserved by X. Menu here it is.", "drop dropped 恢复联系 research that it found",
]


def column(spark, f, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_no_pattern_is_tried_on_every_text(spark):
    for lexicon in (*LISTS, *(list(d.tags) for d in catalog.DOMAINS)):
        assert T._finder(tuple(map(tuple, lexicon))).always == set()
        plain = lambda v: F.filter(F.array(*(F.when(v.rlike(T.pattern(p)), F.lit(k)) for k, p in lexicon)), lambda x: x.isNotNull())  # noqa: B023, E731
        assert column(spark, lambda v: T.hits(v, lexicon)) == column(spark, plain)  # noqa: B023
    assert T.required(r"\bu\.?s\.?\b") == ("u.s", "us")
    assert T.required("(?:a|b)+c?") is None


def test_one_pass_finds_what_each_finds(spark):
    found = column(spark, lambda v: T.found_in(v), [*TEXTS, None])
    for c, lexicon in zip(("objects", "aliased", "locations", "named"), LISTS, strict=True):
        assert [r[c] for r in found] == column(spark, lambda v: T.hits(v, lexicon), [*TEXTS, None])  # noqa: B023
    assert [r["entities"] for r in found] == column(spark, T.named_entities, [*TEXTS, None])
    assert [r["first"] for r in found] == column(spark, T.first_entity, [*TEXTS, None])


def test_shortcuts_are_as_the_plain_patterns(spark):
    def stripped(v):
        for p in (r"<!--[\s\S]*?-->", r"<[^>]+>"):
            v = F.regexp_replace(v, p, " ")
        v = F.regexp_replace(v, "(?i)&amp;", "&")
        v = F.regexp_replace(F.regexp_replace(v, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|�+", " "), "([\"'“”‘’])\\1+", "$1")
        return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))

    assert column(spark, T.strip_html) == column(spark, stripped)
    dates = lambda v: F.concat(*(F.regexp_extract_all(v, F.lit(p.replace(r"\b", T._BOUNDARY)), F.lit(1)) for p in catalog.DATES))
    assert column(spark, T.dates_in) == column(spark, lambda v: F.array_distinct(F.transform(dates(v), lambda x: F.trim(F.lower(x)))))
    assert column(spark, checks.has_html_artifact) == column(spark, lambda v: v.rlike(T.pattern(checks.HTML_ARTIFACT)))
    normal = lambda v: T.nfkc(v)
    latin = lambda v: F.filter(F.regexp_extract_all(normal(v), F.lit("([a-z0-9][a-z0-9.-]*)"), F.lit(1)), lambda t: F.length(t) > 1)
    words = lambda v: F.array_distinct(F.concat(F.array_except(latin(v), F.array(*map(F.lit, lexicons.STOP_WORDS))), T._han_bigrams(normal(v))))
    assert column(spark, lambda v: T.text_tokens(v, lexicons.STOP_WORDS)) == column(spark, words)
    n = lambda v: F.size(F.regexp_extract_all(v, F.lit(T.pattern(relevance.LEARNING_PRIORITY)), F.lit(0)))
    local = lambda v: v.rlike(T.pattern(relevance.LEARNING_LOCAL)) & ~v.rlike(T.pattern(relevance.LEARNING_NATIONAL))
    assert column(spark, relevance.learning_relevance) == column(spark, lambda v: F.least(F.lit(24), n(v) * 8) - F.when(local(v), 24).otherwise(0))
    assert column(spark, lambda v: T.occurring(v, catalog.AI_TECH.topics)) == column(spark, lambda v: sum(F.contains(F.lower(v), F.lit(t)).cast("int") for t in catalog.AI_TECH.topics))


def test_signals_make_no_words_that_nothing_asks_for(spark):
    rows = C.with_features(plans._candidates(spark, "/root/testdata/sf0.001"))
    plan = relevance.with_signals(rows, catalog.AI_TECH).select("id", "match", "relevant")._jdf.queryExecution().optimizedPlan().toString()
    assert "text_tokens" not in plan and "words(" not in plan


def test_texts_that_stay_as_they_are_do_not_leave_spark(spark):
    odd = [*TEXTS, "ÀÉß é ½ ﬁ", "Σίσυφος ΣΑΣ", "“quoted” – 中国。", " x", "ÅÄÖ × ÷", None]
    assert column(spark, T.nfkc, odd) == column(spark, T._nfkc, odd)
    assert column(spark, lambda v: T._nfkc(F.when(v.rlike(T._UNSETTLED), v)), ["Plain", "Élan “x”", "中国"]) == [None] * 3


def test_tokens_of_titles_need_no_python(spark):
    titles = [*TEXTS, "Cafe\u0301 o\u0323\u0302 b\u0346\u0301 e\u0346\u0301", "ＡＩ ㎏\u0301 ½ ① ﬁne ǆ", "㈱株式 ⼈口 \uf900\u2f81a", "\U0001d400\U0001d7d9 İx K ſt", "人\u0334\U00016ff0\u0301口", "a\u0344 e\u0340", "ガ\u3099 한글", None]
    old = lambda v: F.array_distinct(F.concat(F.regexp_extract_all(v, F.lit("([a-z0-9]+)"), F.lit(1)), T._han_bigrams(v)))
    assert column(spark, T.title_tokens, titles) == column(spark, lambda v: old(T._nfkc(F.coalesce(v, F.lit("")))), titles)
    assert "Python" not in spark.range(1).select(T.title_tokens(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()


def test_few_patterns_need_no_python(spark):
    texts = [*TEXTS, None, "Reportedly a rumour; people familiar with it", "ſources ſay", "AFP - AP News", "rafp xinhuas 路透社 据悉", "sources\nsay", "Busıness Wire, PR NEWSWİRE, AFP\u00e9 _afp"]
    for lexicon in ([(k, p) for k, p, _ in checks.WIRES], [("rumor", lexicons.RUMOR)]):
        assert column(spark, lambda v: T.hits(v, lexicon), texts) == [T._finder(tuple(lexicon)).all(T._fold(x)) if x else [] for x in texts]  # noqa: B023
        assert "Python" not in spark.range(1).select(T.hits(F.col("id").cast("string"), lexicon))._jdf.queryExecution().executedPlan().toString()


def test_duplicates_meet_without_words_of_texts(spark):
    from tidewire.operators import events

    assert "text_tokens" in events._PAIR
    rows = spark.createDataFrame([("1", "d", "u1", 1, "t", ["a"]), ("2", "d", "u1", 2, "s", ["b"]), ("3", "d", "u3", 3, "q", ["c"])], "id string, domain string, url string, rank int, title_key string, title_tokens array<string>")
    assert [tuple(r) for r in events.duplicate_pairs(rows).collect()] == [("d", "1", "2")]  # needs no other column
