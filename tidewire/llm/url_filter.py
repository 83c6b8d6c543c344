"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hosts (labels before a parent domain) and paths of pages with running text, chosen by hand.
_TEXT_PAGES = (
    ("en.wiki", "/wiki/Harbour"), ("news", "/2021/05/river-flood-report"), ("blog", "/posts/learning-to-sail"), ("docs", "/en/guide/install.html"),
    ("library", "/books/essays/chapter-3"), ("www.school", "/courses/history/notes"), ("journal", "/articles/soil-and-rain"),
    ("museum", "/de/ausstellung/geschichte.html"), ("magazine", "/fr/culture/portrait"), ("forum", "/t/how-to-prune-apple-trees/4411"),
    ("science", "/papers/tides.html"), ("www.town", "/en/council/minutes"), ("recipes", "/soup/lentil"), ("m.times", "/es/opinion/2020/carta"),
    ("stories", "/en/12044.html"), ("garden", "/en/5120/"), ("www.radio", "/en/programme/31"), ("archive", "/texts/letters/1890"),
    ("health", "/en/advice/sleep"), ("www.law", "/commentary/contracts"), ("essay", "/en/77"), ("travel", "/guides/coast-path"),
    ("university", "/lectures/week-2.html"), ("reader", "/en/20981.html"),
    ("notes", "/de/4123"), ("www.chronicle", "/fr/907/"), ("m.letters", "/es/3315.html"), ("lexicon", "/en/6840"), ("m.herald", "/de/1502.html"),
    ("www.nation", "/es/284/"), ("blog.farmhouse", "/fr/5077"), ("gardian", "/en/930"),
    ("m.theatre", "/en/61"), ("therapy", "/en/8830.html"), ("www.theses", "/fr/12/"), ("blog.weather", "/en/4410"), ("thermal", "/de/9"), ("m.threads", "/en/73/"),
    ("thistle", "/es/310.html"), ("www.anthem", "/en/2"), ("healthtion", "/en/18/"), ("blog.nations", "/de/77.html"), ("m.earth", "/fr/6"), ("www.north", "/en/440/"),
    ("mother", "/en/51.html"), ("blog.other", "/es/8"), ("www.thing", "/en/905"), ("m.stable", "/de/12/"), ("fashion", "/fr/41.html"), ("www.thin", "/en/3/"),
    ("blog.intention", "/en/17"), ("m.when", "/es/2210"), ("thesis", "/de/5.html"), ("www.whether", "/en/19/"), ("m.nothing", "/en/660"), ("month", "/fr/83"),
)

#: The same for pages that carry none worth keeping.
_JUNK_PAGES = (
    ("ads", "/click?id=1"), ("track", "/pixel.gif"), ("shop", "/cart/checkout"), ("www.casino-bonus", "/free-spins"), ("login", "/signin"),
    ("cdn", "/static/app.min.js"), ("cheap-pills", "/buy-now"), ("banner", "/ads/728x90"), ("img", "/thumbs/0001.jpg"), ("win-prize", "/claim"),
    ("dl", "/setup.exe"), ("popup", "/landing/offer"), ("adult-xxx", "/videos"), ("redirect", "/out?to=1"), ("coupon", "/deals/50-off"),
    ("api", "/v1/status.json"), ("proxy", "/browse"), ("spam-seo", "/backlinks"), ("betting", "/odds/live"), ("loan", "/apply-fast"),
    ("feed", "/rss.xml"), ("share", "/submit"), ("tag", "/t/buy/cheap"), ("search", "/results/page"),
    ("promo", "/win/phone"), ("www.clicks", "/go?ad=77"), ("basket", "/cart/add"), ("m.slots", "/casino/play"), ("www.pay", "/checkout/now"),
    ("affiliate", "/ref/link"), ("static", "/css/site.css"), ("blog.backlink", "/seo/cheap-links"),
    # Hosts that tell enough, on paths like those of pages with text.
    ("casino", "/en/4.html"), ("m.casino-club", "/fr/12/"), ("online-bets", "/en/77"), ("www.best-bets", "/de/3/"), ("free-chips", "/es/910"), ("blog.ads", "/en/8.html"),
    ("ad-track", "/en/31/"), ("www.ads-server", "/fr/6"), ("click-track", "/de/55.html"), ("spam", "/en/2210/"), ("m.spam-links", "/es/14"), ("link-farm", "/en/9/"),
    ("www.content-farm", "/fr/71.html"), ("pills", "/en/660"), ("blog.cheap-meds", "/de/18/"), ("discount-pills", "/es/5.html"), ("adult", "/en/43"), ("m.adult-cams", "/fr/3/"),
    ("xxx-video", "/en/12.html"), ("poker-win", "/es/88"), ("www.win-cash", "/en/7/"), ("payday-loans", "/de/640"), ("blog.slots-free", "/en/51"), ("cheap-watches", "/fr/29.html"),
)

_PARENTS = ("example.com", "example.org", "example.net")

#: A small labelled table: pages with running text (0) and pages without (1). Each is on every parent domain, so that a
#: parent tells nothing of the label.
LABELLED = [(f"https://{host}.{parent}{path}", label) for label, own in enumerate((_TEXT_PAGES, _JUNK_PAGES)) for host, path in own for parent in _PARENTS]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without one."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lower).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _grams(text: Column, sizes: tuple[int, ...], mark: str) -> Column:
    """The character n-grams of a text between two end marks, each with a mark of its own; a run of digits counts as one."""
    full = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
    some = lambda n: F.when(
        F.length(full) >= n, F.transform(F.sequence(F.lit(1), F.length(full) - n + 1), lambda i: F.concat(F.lit(mark), F.substr(full, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(*(some(n) for n in sizes))


def _featured(df: DataFrame, buckets: int, sizes: tuple[int, ...]) -> DataFrame:
    grams = F.concat(_grams(F.col("host"), sizes, "h:"), _grams(F.col("path"), sizes, "p:"))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features").transform(df.withColumn("grams", grams))


def fitted(spark: SparkSession, labelled: list[tuple[str, int]], buckets: int, sizes: tuple[int, ...], strength: float):
    """The regression over a labelled table that the driver holds: some dozens of URLs."""
    rows = spark.createDataFrame(labelled, "url string, label double").coalesce(1)
    rows = _featured(rows.select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), buckets, sizes)
    return LogisticRegression(regParam=strength, maxIter=50, featuresCol="features", labelCol="label").fit(rows)


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    labelled: list[tuple[str, int]] | None = None,
    buckets: int = 4096,
    sizes: tuple[int, ...] = (3, 4),
    strength: float = 0.05,
    threshold: float = 0.5,
) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, score (chance of block) and verdict (allow or block).

    rules: (host, path, verdict). A rule fits its host and all of its subdomains where the path starts with the rule's;
    the longest rule wins, a host's length counting before a path's. Without a fitting rule the verdict is the model's.

    Runs of digits are all alike to the model: numbers in paths say nothing of a page. A null url, or one without ://, has an empty host and path, and is scored as such. Repeated rows and null ids are
    kept. URLs are read whole. An empty table gives no rows; no rules leave all to the model. Other columns are ignored.
    """
    spark = pages.sparkSession
    labelled = LABELLED if labelled is None else labelled
    model = fitted(spark, [(u, float(y)) for u, y in labelled], buckets, sizes, strength)

    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.lower(), []).append((path, verdict))
    if by_host:
        entries: list[Column] = []
        for host, own in by_host.items():
            some = [F.struct(F.lit(len(host)), F.lit(len(p)), F.lit(host + p), F.lit(v), F.lit(p)) for p, v in own]
            entries += [F.lit(host), F.array(*some)]
        table = F.create_map(*entries)
        labels = F.split("host", r"\.")
        # A host's suffixes, each a look-up: the work follows the host's labels, not the number of rules.
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.slice(F.map_values(table)[0], 1, 0))))
        fitting = F.filter(found, lambda r: F.startswith(F.col("path"), r["col5"]))
        best = F.array_max(fitting)
        rule, given = best["col3"], best["col4"]
    else:
        rule = given = F.lit(None).cast("string")

    scored = model.transform(_featured(base, buckets, sizes))
    chance = F.element_at(vector_to_array(F.col("probability")), 2)
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), chance.alias("score"),
        F.coalesce(given, F.when(chance >= threshold, "block").otherwise("allow")).alias("verdict"),
    )

