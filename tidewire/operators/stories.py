"""Stories: proposals merged with what rules tell, field by field; repair of what does not hold; errors; counts of quality.

A story is a row of arrays of texts, one array a field (FIELDS), with fact_urls, the URLs behind each fact. What has to be
judged against the reports of an event is laid out in rows (event, field, at, text), each distinct text once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.checks import has_english_fragment, has_html_artifact, han_ratio, is_placeholder_summary, is_placeholder_title
from tidewire.functions.numerals import has_broken_quantifier, has_numbers
from tidewire.functions.similarity import disjoint
from tidewire.functions.text import composed, normal_title, strip_html
from tidewire.operators.claims import conflicts, matches, supports
from tidewire.operators.narration import _print_of, concrete, says_more
from tidewire.operators.numeric import CLAIMS, number_support, sanitized
from tidewire.operators.tables import durable, spread_join

FIELDS = ("title", "summary", "key_facts", "why", "background", "chain", "parties", "uncertainties", "terms", "definitions", "near", "medium", "signals", "tags")
ONE = ("title", "summary", "why", "background", "uncertainties", "near", "medium")
ANALYSIS = ("why", "background", "chain", "parties", "uncertainties", "terms", "definitions", "near", "medium", "signals")
#: What proposed stories look like in JSON.
PROPOSAL = """slot int, title string, summary string, keyFacts array<string>, factSources array<struct<factIndex:int,sourceIds:array<string>,urls:array<string>>>,
whyItMatters string, background string, impactChain array<string>, affectedParties array<string>, uncertainties string, glossary array<struct<term:string,definition:string>>,
trend struct<nearTerm:string,mediumTerm:string,signalsToWatch:array<string>>, tags array<string>"""

# Wording that makes a prediction conditional, an analysis careful, and a statement a fact; and what stands in for gaps.
CONDITIONAL_PREDICTION = r"如果|若|可能|取决于|需(?:要)?观察|在.+(?:情况下|前提下)"
CONDITIONAL_ANALYSIS = r"如果|若|可能|或将|有望|取决于|需(?:要)?观察|在.+(?:情况下|前提下)|影响|传导|风险|机会|承压|受益"
CONCRETE_FACT = r"宣布|发布|推出|收购|融资|扩建|下调|上调|袭击|死亡|签署|批准|实施|发生|公布|启动|停止|关闭|裁员|invest|launch|announce|acquire|attack|kill|approve|implement"
CONDITION = "如果后续公开证据继续支持这一判断，"
NO_TERM, NO_DEFINITION, NO_SIGNAL, CROSS_CHECK = "相关概念", "该概念的具体量化口径以来源材料为准。", "后续可验证信号", "独立可靠来源的交叉验证"
FULL_STOP = r"[。！？.!?]$"


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def as_fields(stories: DataFrame, event: str = "event_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(event, field, at, text): a row for each text of each story."""
    tagged = [F.transform(c, lambda v, i: F.struct(F.lit(c).alias("field"), i.alias("at"), v.alias("text"))) for c in fields]  # noqa: B023
    return stories.select(event, F.explode(F.flatten(F.array(*tagged))).alias("x")).select(event, "x.*")


def as_stories(fields: DataFrame, event: str = "event_id", names: tuple[str, ...] = FIELDS) -> DataFrame:
    """The stories of rows (event, field, at, text); a story's texts are few."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("at", "text")))), lambda x: x["text"])
    return fields.groupBy(event).agg(*(listed(c).alias(c) for c in names))


@dataclass
class Judged:
    """flags: (event, text, has_event, fits, supported, severe and the text's print c_*); links and number_links: (event, text, url), the
    reports that support a text, and those that have its numbers."""

    flags: DataFrame
    links: DataFrame
    number_links: DataFrame


def judged(texts: DataFrame, context: DataFrame, reports: DataFrame, support: DataFrame, event: str = "event_id") -> Judged:
    """What texts (event, text) are worth against their events.

    context are event_context() rows, reports report_prints(), support supporting_reports(). A text fits if its features can
    be of its event; a report supports it if it fits and the report bears it out. It conflicts severely if none of the
    event's reports has its numbers, or if it states as a fact what another actor, or this one otherwise, did. An event's
    reports are many, its texts few: reports are dealt out.
    """
    asked = texts.select(event, "text").where("text is not null").distinct().withColumn("clean", strip_html(F.col("text")))
    asked = _print_of(asked, "clean", "c_")
    about = context.select(event, "domain", *(f"e_{c}" for c in ("entities", "actions", "objects", "locations")), F.lit(True).alias("has_event"))
    asked = asked.join(about, event, "left").withColumn("has_event", F.coalesce("has_event", F.lit(False)))
    e, c = (lambda k: F.col(f"e_{k}")), (lambda k: F.col(f"c_{k}"))
    asked = durable(asked.withColumn("fits", F.coalesce((F.col("clean") != "") & matches(e, c), F.lit(False))))
    claims = asked.where(F.col("fits") & ~is_placeholder_summary(F.col("clean")))
    claims = claims.select(event, "text", *(f"c_{k}" for k in ("entities", "actions", "objects", "numbers", "quantities", "all_tokens")))
    sources = reports.select(event, "id", "url", *(f"p_{k}" for k in ("entities", "actions", "objects", "quantities", "all_tokens")))
    links = durable(spread_join(sources, claims, event, F.col("id"), copied=CLAIMS).where(supports(c, lambda k: F.col(f"p_{k}"))).select(event, "text", "url").distinct())
    number_links = durable(number_support(asked.select(event, "text"), support, event).select(event, "text", "url").distinct())
    any_link = links.select(event, "text").distinct().withColumn("supported", F.lit(True))
    any_number = number_links.select(event, "text").distinct().withColumn("_numbers", F.lit(True))
    asked = asked.join(any_link, [event, "text"], "left").join(any_number, [event, "text"], "left")
    apart = {k: disjoint(e(k), c(k)) for k in ("entities", "objects", "actions")}
    same_actor = F.arrays_overlap(e("entities"), c("entities"))
    other = (apart["entities"] & (apart["objects"] | apart["actions"])) | (same_actor & apart["objects"] & apart["actions"])
    stated = conflicts(e, c) & F.col("clean").rlike("(?iu)" + CONCRETE_FACT) & other & ~F.col("clean").rlike(CONDITIONAL_ANALYSIS)
    severe = (F.trim("text") != "") & F.col("has_event") & ((has_numbers(F.col("text")) & F.col("_numbers").isNull()) | F.coalesce(stated, F.lit(False)))
    kept = [f"c_{k}" for k in ("entities", "actions", "objects", "locations", "dates", "numbers", "all_tokens", "named", "first")]
    return Judged(durable(asked.select(event, "text", "has_event", "fits", F.coalesce("supported", F.lit(False)).alias("supported"), severe.alias("severe"), *kept)), links, number_links)


def _text(field: str) -> Column:
    return F.coalesce(F.try_element_at(field, F.lit(1)), F.lit(""))


def _with_flags(stories: DataFrame, flags: DataFrame, field: str, prefix: str, event: str) -> DataFrame:
    """stories with the flags of their first text of a field, each name after the prefix."""
    named = flags.select(F.col(event), F.col("text").alias(f"_{field}"), *(F.col(c).alias(prefix + c.removeprefix("c_")) for c in flags.columns if c not in (event, "text")))
    return stories.withColumn(f"_{field}", _text(field)).join(named, [event, f"_{field}"], "left")


def _facts(stories: DataFrame, found: Judged, reports: DataFrame, event: str) -> DataFrame:
    """(event, at, fact, n_urls, allowed, backed, counted): each fact, whether all its URLs are of reports of its event, and whether one of
    them supports it and has its numbers."""
    urls = F.coalesce(F.try_element_at("fact_urls", F.col("at") + 1), _none())
    each = stories.select(event, "fact_urls", F.posexplode("key_facts").alias("at", "text")).select(event, "at", "text", F.explode_outer(urls).alias("url"))
    mark = lambda df, name: df.select(*(c for c in (event, "text", "url") if c in df.columns)).distinct().withColumn(name, F.lit(True))
    each = each.join(mark(reports.select(event, "url"), "_known"), [event, "url"], "left")
    each = each.join(mark(found.links, "_backed"), [event, "text", "url"], "left").join(mark(found.number_links, "_counted"), [event, "text", "url"], "left")
    some = lambda c: F.bool_or(F.col(c).isNotNull())
    return each.groupBy(event, "at", F.col("text").alias("fact")).agg(
        F.count("url").alias("n_urls"), F.bool_and(F.col("_known").isNotNull()).alias("allowed"), some("_backed").alias("backed"), some("_counted").alias("counted")
    )


def story_errors(stories: DataFrame, context: DataFrame, reports: DataFrame, support: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, errors): what is wrong with each story, sorted; empty for one without errors.

    Stories of events that are not known are judged by their texts alone, and none of their facts has a source.
    """
    texts = as_fields(stories, event, tuple(f for f in FIELDS if f != "tags"))
    found = judged(texts, context, reports, support, event)
    all_texts = as_fields(stories, event).groupBy(event).agg(
        F.bool_or(has_html_artifact(F.col("text"))).alias("_html"), F.bool_or(has_english_fragment(F.col("text"))).alias("_english"),
        F.bool_or(has_broken_quantifier(F.col("text"))).alias("_broken"), F.bool_or((F.col("field") == "key_facts") & is_placeholder_summary(F.col("text"))).alias("_empty_fact"),
    )
    analysis = texts.where(F.col("field").isin(*ANALYSIS)).join(found.flags.select(event, "text", "severe"), [event, "text"]).groupBy(event).agg(F.bool_or("severe").alias("_severe"))
    fact = F.when((F.col("n_urls") == 0) | ~F.col("allowed"), "fact-without-source").when(~F.col("backed"), "fact-of-other-event")
    fact = fact.when(has_numbers(F.col("fact")) & ~F.col("counted"), "number-without-source")
    facts = _facts(stories, found, reports, event).groupBy(event).agg(F.collect_set(fact).alias("_facts"))
    rows = _with_flags(_with_flags(stories, found.flags, "title", "t_", event), found.flags, "summary", "s_", event)
    rows = rows.drop("tags").join(context.drop("domain"), event, "left")
    for part in (all_texts, analysis, facts):
        rows = rows.join(part, event, "left")
    rows = durable(rows)
    title, summary = strip_html(F.col("_title")), strip_html(F.col("_summary"))
    prose = F.concat("_summary", _text("why"), _text("background"))
    prediction = F.concat_ws(" ", _text("near"), _text("medium"))
    known, off = F.col("t_has_event"), lambda c: ~F.coalesce(c, F.lit(False))
    more = says_more("_title", "_summary", "t_", "s_", F.col("s_fits"), F.col("s_supported"))
    rules = {
        "not-chinese": (han_ratio(F.col("_title")) < 0.18) | (han_ratio(prose) < 0.45),
        "placeholder-title": is_placeholder_title(title), "placeholder-summary": is_placeholder_summary(summary),
        "title-without-act": known & off(concrete("_title", "t_")), "summary-adds-nothing": known & off(more),
        "summary-too-long-or-open": (F.length("_summary") > 220) | ~F.trim("_summary").rlike(FULL_STOP),
        "other-event": known & (off(F.col("t_fits")) | off(F.col("s_fits"))), "analysis-conflicts": F.col("_severe"), "html": F.col("_html"), "english": F.col("_english"),
        "broken-quantity": F.col("_broken"), "placeholder-fact": F.col("_empty_fact"), "open-prediction": ~prediction.rlike(CONDITIONAL_PREDICTION) | (F.size("signals") < 2),
    }
    listed = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))
    return rows.select(event, F.array_sort(F.concat(F.filter(listed, lambda v: v.isNotNull()), F.coalesce("_facts", _none()))).alias("errors"))


def quality_counts(stories: DataFrame, context: DataFrame, reports: DataFrame, support: DataFrame, by: str = "domain", event: str = "event_id") -> DataFrame:
    """Six counts for each `by` over stories: summaries that repeat their titles, that add nothing, titles or summaries of other
    events, facts without a source of their event, texts with left-over HTML, and with English fragments."""
    found = judged(as_fields(stories, event, ("title", "summary", "key_facts")), context, reports, support, event)
    rows = _with_flags(_with_flags(stories.select(by, event, "title", "summary"), found.flags, "title", "t_", event), found.flags, "summary", "s_", event)
    head, told = normal_title(F.col("_title")), normal_title(F.col("_summary"))
    off = lambda c: ~F.coalesce(c, F.lit(False))
    more = says_more("_title", "_summary", "t_", "s_", F.col("s_fits"), F.col("s_supported"))
    counts = rows.groupBy(by).agg(
        F.count_if(F.startswith(told, head) | ((F.length(head) > 12) & F.contains(told, head))).alias("repeated_summaries"),
        F.count_if(F.col("t_has_event") & off(more)).alias("summaries_without_news"), F.count_if(off(F.col("t_fits")) | off(F.col("s_fits"))).alias("mismatches"),
    )
    facts = _facts(stories, found, reports, event).where((F.col("n_urls") == 0) | ~F.col("backed"))
    facts = facts.join(stories.select(event, by), event).join(context.select(event), event, "left_semi").groupBy(by).agg(F.count("*").alias("facts_of_other_events"))
    fields = as_fields(stories, event).join(stories.select(event, by), event)
    texts = fields.groupBy(by).agg(F.count_if(has_html_artifact(F.col("text"))).alias("html_artifacts"), F.count_if(has_english_fragment(F.col("text"))).alias("english_fragments"))
    return counts.join(facts, by, "left").join(texts, by, "left").fillna(0, ["facts_of_other_events", "html_artifacts", "english_fragments"])


def proposals_of(landed: DataFrame) -> DataFrame:
    """(domain, position, slot, fields, fact_urls, fact_sources) of landed answers (domain, position, json): one proposed story each.

    What is no JSON or has another form is null, field by field. A period of the trend may be a text, or a condition and an
    outlook. slot is the one asked for, else the position counted from 1.
    """
    s = F.from_json("json", PROPOSAL)
    rows = landed.select("domain", "position", s.alias("s"))
    parts = lambda v: F.from_json(v, "condition string, outlook string")
    period = lambda v: F.when(F.startswith(F.ltrim(v), F.lit("{")), F.array_join(F.filter(F.array(F.trim(parts(v)["condition"]), F.trim(parts(v)["outlook"])), lambda x: x != ""), "，")).otherwise(F.trim(v))
    single = lambda v: F.when(F.trim(v) != "", F.array(F.trim(v)))
    # texts that are all there, and at least so many of them
    listed = lambda v, least: F.when((F.size(v) >= least) & F.forall(v, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), v)
    near, medium = period(F.col("s.trend.nearTerm")), period(F.col("s.trend.mediumTerm"))
    valid_trend = near.isNotNull() & medium.isNotNull() & F.col("s.trend.signalsToWatch").isNotNull()
    pairs = F.col("s.glossary")
    valid_pairs = pairs.isNotNull() & F.forall(pairs, lambda x: x["term"].isNotNull() & x["definition"].isNotNull())
    of = lambda name: F.when(valid_pairs, F.transform(F.slice(pairs, 1, 4), lambda x: x[name]))
    return rows.select(
        "domain", "position", F.coalesce("s.slot", F.col("position") + 1).cast("int").alias("slot"), single(F.col("s.title")).alias("title"), single(F.col("s.summary")).alias("summary"),
        F.slice(listed(F.col("s.keyFacts"), 1), 1, 4).alias("key_facts"), F.col("s.factSources").alias("fact_sources"), single(F.col("s.whyItMatters")).alias("why"),
        single(F.col("s.background")).alias("background"), F.slice(listed(F.col("s.impactChain"), 3), 1, 5).alias("chain"), F.slice(listed(F.col("s.affectedParties"), 2), 1, 4).alias("parties"),
        single(F.col("s.uncertainties")).alias("uncertainties"), of("term").alias("terms"), of("definition").alias("definitions"), F.when(valid_trend, F.array(near)).alias("near"),
        F.when(valid_trend, F.array(medium)).alias("medium"),
        F.when(valid_trend, F.transform(F.filter("s.trend.signalsToWatch", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.trim)).alias("signals"),
        F.slice(listed(F.col("s.tags"), 1), 1, 3).alias("tags"),
    )


def merged(baseline: DataFrame, proposals: DataFrame, context: DataFrame, reports: DataFrame, support: DataFrame, event: str = "event_id") -> DataFrame:
    """baseline stories (domain, slot, event, publisher, fields) with what proposals (proposals_of() rows) offer for their slots.

    The first proposal for a slot counts. Each of its fields that is there takes the place of the story's; numbers that no
    report bears out are cut, and where nothing stays of a text the story's own stands in. Facts need a report that
    supports them: those they name, else any two of the event. taken lists the fields that come from a proposal. A
    proposal for a slot that no story has is lost, a story without a proposal stays as it is.
    """
    first = proposals.groupBy("domain", "slot").agg(F.min_by(F.struct(*FIELDS, "fact_sources"), "position").alias("p"))
    rows = durable(baseline.join(first, ["domain", "slot"], "left"))
    p = lambda c: F.col("p")[c]
    condition = lambda v: F.transform(v, lambda x: F.when(x.rlike(CONDITIONAL_PREDICTION), x).otherwise(F.concat(F.lit(CONDITION), x)))
    period = lambda c: condition(F.transform(p(c), lambda x: F.when(x == "", F.element_at(c, 1)).otherwise(x)))
    defaults = F.array(F.concat("publisher", F.lit("的后续正式信息")), F.lit(CROSS_CHECK))
    offered = {c: p(c) for c in FIELDS} | {c: period(c) for c in ("near", "medium")} | {"signals": F.slice(F.array_distinct(F.concat(p("signals"), defaults)), 1, 4)}
    wide = rows.select(event, *(F.coalesce(offered[c], _none()).alias(c) for c in FIELDS))
    cleaned = sanitized(as_fields(wide, event, tuple(c for c in FIELDS if c not in ("key_facts", "tags"))), support, event)
    own = rows.select(event, *(F.col(c).alias(f"b_{c}") for c in FIELDS))
    instead = F.coalesce(*(F.when(F.col("field") == c, F.coalesce(F.try_element_at(f"b_{c}", F.col("at") + 1), F.lit(NO_SIGNAL) if c == "signals" else F.try_element_at(f"b_{c}", F.lit(1))))
                           for c in FIELDS if c not in ("terms", "definitions")), F.when(F.col("field") == "terms", NO_TERM).otherwise(NO_DEFINITION))
    filled = cleaned.join(own, event).select(event, "field", "at", F.coalesce("text", instead).alias("text"))
    facts = _sourced_facts(rows, context, reports, support, event)
    done = durable(as_stories(filled, event).drop("key_facts", "tags").join(facts, event, "left"))
    out = rows.select(event, "domain", "slot", "publisher", "p", *(F.col(c).alias(f"b_{c}") for c in (*FIELDS, "fact_urls"))).join(done, event, "left")
    has = lambda c: F.col("p").isNotNull() & (F.size("key_facts") > 0 if c == "key_facts" else p(c).isNotNull())
    pick = lambda c: F.when(has(c), p(c) if c == "tags" else F.col(c)).otherwise(F.col(f"b_{c}"))
    taken = F.filter(F.array(*(F.when(has(c), F.lit(c)) for c in FIELDS)), lambda v: v.isNotNull())
    return out.select(event, "domain", "slot", "publisher", *(pick(c).alias(c) for c in FIELDS), F.when(has("key_facts"), F.col("fact_urls")).otherwise(F.col("b_fact_urls")).alias("fact_urls"), taken.alias("taken"))


def _sourced_facts(rows: DataFrame, context: DataFrame, reports: DataFrame, support: DataFrame, event: str) -> DataFrame:
    """(event, key_facts, fact_urls) of the facts that proposals offer, without numbers that their reports do not have.

    A fact may name reports by URL or id. With numbers it is backed by reports that have them, or else bear it out; without,
    by any of its event. Of those it names all count; if it names none of them, the first two by place. Facts that nothing
    backs are left out, and of equal ones all but the first.
    """
    link = F.filter("p.fact_sources", lambda x: x["factIndex"] == F.col("at"))
    given = F.coalesce(F.flatten(F.transform(link, lambda x: F.concat(F.coalesce(x["urls"], _none()), F.coalesce(x["sourceIds"], _none())))), _none())
    each = rows.where("p is not null").select(event, "p", F.posexplode("p.key_facts").alias("at", "text"))
    each = each.select(event, "at", F.trim(F.regexp_replace(composed(F.col("text")), r"(?U)\s+", " ")).alias("text"), given.alias("given"))
    known = reports.select(event, "id", "url", "place")
    named = each.select(event, "at", F.explode("given").alias("g")).join(known, event).where((F.col("g") == F.col("url")) | (F.col("g") == F.col("id")))
    named = durable(named.select(event, "at", "url").distinct())
    each = durable(each.drop("given").join(named.groupBy(event, "at").agg(F.collect_set("url").alias("urls")), [event, "at"], "left"))
    clean = sanitized(each.withColumn("field", F.lit("key_facts")), support, event, whole=True).select(event, "at", F.col("text").alias("fact")).where("fact is not null")
    clean = durable(clean.groupBy(event, "fact").agg(F.min("at").alias("at")))
    found = judged(clean.select(event, F.col("fact").alias("text")), context, reports, support, event)
    counted = clean.where(has_numbers(F.col("fact")))
    of = lambda links: counted.join(links.withColumnRenamed("text", "fact"), [event, "fact"]).select(event, "at", "url")
    by_number = of(found.number_links)
    by_claim = of(found.links).join(by_number.select(event, "at").distinct(), [event, "at"], "left_anti")
    placed = spread_join(known.select(event, "url", "place"), by_number.unionByName(by_claim).withColumnRenamed("url", "_url"), event, F.col("url"), copied=CLAIMS).where("url = _url").drop("_url")
    early = known.withColumn("_n", F.row_number().over(Window.partitionBy(event).orderBy("place", "url"))).where("_n <= 2").select(event, "url", "place")
    plain = clean.where(~has_numbers(F.col("fact"))).select(event, "at")
    free = plain.join(early, event).unionByName(plain.join(named, [event, "at"]).withColumn("place", F.lit(None).cast(reports.schema["place"].dataType)), allowMissingColumns=True)
    pool = placed.unionByName(free).join(named.withColumn("_named", F.lit(True)), [event, "at", "url"], "left").groupBy(event, "at", "url").agg(F.min("place").alias("place"), F.max("_named").alias("_named"))
    nth = F.row_number().over(Window.partitionBy(event, "at").orderBy(F.col("_named").isNull(), "place", "url"))
    chosen = pool.withColumn("_n", nth).where(F.col("_named").isNotNull() | (F.col("_n") <= 2)).groupBy(event, "at").agg(
        F.collect_set(F.when(F.col("_named").isNotNull(), F.col("url"))).alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "url"))), lambda x: x["url"]).alias("b")
    )
    backed = clean.join(chosen, [event, "at"]).select(event, F.struct("at", "fact", F.when(F.size("a") > 0, F.array_sort("a")).otherwise(F.col("b")).alias("urls")).alias("x"))
    listed = backed.groupBy(event).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select(event, F.transform("x", lambda v: v["fact"]).alias("key_facts"), F.transform("x", lambda v: v["urls"]).alias("fact_urls"))


def repaired(stories: DataFrame, baseline: DataFrame, content: DataFrame, context: DataFrame, reports: DataFrame, support: DataFrame, event: str = "event_id") -> DataFrame:
    """stories with what does not hold replaced field by field, and repairs: (field, reason) of each that was.

    baseline are the stories that rules tell of the same events, content what they are told from. A title must say who did
    what, be Chinese and of its event; else a part of the summary that does, the baseline's title or the content's takes its
    place. A summary must say more than the title and be whole; else the baseline's or the content's. Facts stay if they are
    of their event and a report they name bears them out, numbers too; without any the content's summary is the fact.
    Analysis stays unless it conflicts with the event or is no clean Chinese; lists stay or go as a whole.
    """
    pieces = stories.select(event, F.explode(_pieces(_text("summary"))).alias("text"))
    base = baseline.select(event, *(F.col(c).alias(f"b_{c}") for c in FIELDS))
    made = content.select(event, F.col("title").alias("made_title"), F.col("summary").alias("made_summary"), F.col("url").alias("made_url"))
    texts = as_fields(stories, event).select(event, "text")
    shown = stories.select(event, F.array(F.concat_ws(" ", _text("near"), _text("medium"), F.array_join("signals", " "))).alias("x"))
    pairs = stories.select(event, F.zip_with("terms", "definitions", lambda a, b: F.concat_ws(" ", a, b)).alias("x"))
    whole = shown.unionByName(pairs).select(event, F.explode("x").alias("text"))
    extra = base.select(event, F.explode(F.array(_text("b_title"), _text("b_summary"))).alias("text"))
    found = judged(texts.unionByName(pieces).unionByName(whole).unionByName(extra).unionByName(made.select(event, F.col("made_summary").alias("text"))), context, reports, support, event)
    flags = found.flags
    event_side = context.select(event, "e_objects", "official")

    # The title: the first part of the summary that says who did what, is of the event, and supported.
    told = stories.select(event, F.posexplode(_pieces(_text("summary"))).alias("n", "text")).join(flags, [event, "text"]).join(event_side, event)
    told = told.where(F.col("fits") & F.col("supported") & concrete("text", "c_")).groupBy(event).agg(F.min_by("text", "n").alias("told_title"))
    rows = stories.join(base, event, "left").join(made, event, "left").join(told, event, "left").join(event_side, event, "left")
    for field, prefix in (("title", "t_"), ("summary", "s_"), ("b_title", "bt_"), ("b_summary", "bs_")):
        rows = _with_flags(rows, flags, field, prefix, event)
    rows = durable(rows.withColumn("_acts", concrete("_title", "t_")).withColumn("_base_acts", concrete("_b_title", "bt_")))
    off = lambda c: ~F.coalesce(c, F.lit(False))
    broken = lambda v: has_html_artifact(v) | has_english_fragment(v)
    first = lambda *tests: F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for reason, test in tests))
    title = F.col("_title")
    title_reason = first(
        ("placeholder", is_placeholder_title(title)), ("no-act", off(F.col("_acts"))), ("other-event", off(F.col("t_fits"))), ("unclean", broken(title)), ("not-chinese", han_ratio(title) < 0.18)
    )
    sound = ~is_placeholder_title(F.col("_b_title")) & F.coalesce("_base_acts", F.lit(False))
    rows = rows.withColumn("title_reason", title_reason).withColumn(
        "new_title", F.when(F.col("title_reason").isNull(), title).otherwise(F.coalesce("told_title", F.when(sound, F.col("_b_title")), "made_title", "_b_title"))
    )
    rows = durable(_print_of(rows.withColumn("_new", strip_html(F.col("new_title"))), "_new", "n_"))
    summary = F.col("_summary")
    more = lambda c, p: F.coalesce(says_more("_new", c, "n_", p, F.col(f"{p}fits"), F.col(f"{p}supported")), F.lit(False))
    summary_reason = first(
        ("placeholder", is_placeholder_summary(summary)), ("adds-nothing", ~more("_summary", "s_")), ("too-long", F.length(summary) > 220), ("open", ~F.trim(summary).rlike(FULL_STOP)),
        ("unclean", broken(summary) | has_broken_quantifier(summary)), ("not-chinese", han_ratio(summary) < 0.32),
    )
    base_summary = F.when(~is_placeholder_summary(F.col("_b_summary")) & more("_b_summary", "bs_"), F.col("_b_summary"))
    rows = rows.withColumn("summary_reason", summary_reason).withColumn("new_summary", F.when(F.col("summary_reason").isNull(), summary).otherwise(F.coalesce(base_summary, "made_summary", "_b_summary")))

    rows = durable(rows)
    # Facts: those of the event that a report they name bears out.
    facts = _facts(stories, found, reports, event).join(flags.select(event, F.col("text").alias("fact"), "fits"), [event, "fact"], "left")
    fact = F.col("fact")
    good = (F.trim(fact) != "") & ~is_placeholder_summary(fact) & ~broken(fact) & F.coalesce("fits", F.lit(False)) & (F.col("n_urls") > 0) & F.col("allowed") & F.col("backed")
    good = good & (~has_numbers(fact) | F.col("counted"))
    kept = facts.where(good).groupBy(event).agg(F.array_sort(F.collect_list("at")).alias("kept"))
    rows = rows.join(kept, event, "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    pick = lambda c: F.transform("kept", lambda i: F.element_at(c, i + 1))
    said = F.when(F.coalesce("made_summary", F.lit("")) != "", F.array("made_summary")).otherwise(_none())
    some = F.size("kept") > 0
    new_facts, new_urls = F.when(some, pick("key_facts")).otherwise(said), F.when(some, pick("fact_urls")).otherwise(F.transform(said, lambda _: F.array("made_url")))

    # Analysis: what conflicts with the event, by field.
    clash = as_fields(stories, event).join(flags.select(event, "text", "severe"), [event, "text"]).where("severe").select(event, "field")
    joint = lambda df, name: df.select(event, F.explode("x").alias("text")).join(flags.select(event, "text", "severe"), [event, "text"]).where("severe").select(event, F.lit(name).alias("field"))
    clash = clash.unionByName(joint(shown, "trend")).unionByName(joint(pairs, "glossary")).groupBy(event).agg(F.collect_set("field").alias("clash"))
    rows = rows.join(clash, event, "left").withColumn("clash", F.coalesce("clash", _none()))
    hit = lambda c: F.array_contains("clash", c)
    prediction = F.concat_ws(" ", _text("near"), _text("medium"))
    prose = lambda c, least: first(("empty", F.trim(_text(c)) == ""), ("not-chinese", han_ratio(F.trim(_text(c))) < least), ("unclean", broken(_text(c))), ("conflict", hit(c)))
    list_ = lambda c: first(("empty", F.size(c) == 0), ("conflict", hit(c)), ("unclean", F.exists(c, broken)))
    trend = first(("open-prediction", ~prediction.rlike(CONDITIONAL_PREDICTION) | (F.size("signals") < 2)), ("conflict", hit("trend")))
    reasons = {
        "title": F.col("title_reason"), "summary": F.col("summary_reason"), "key_facts": first(("without-source", F.size("kept") < F.size("key_facts")), ("none", F.size("key_facts") == 0)),
        "why": prose("why", 0.32), "background": prose("background", 0.32), "uncertainties": prose("uncertainties", 0.25), "chain": list_("chain"), "parties": list_("parties"),
        "tags": list_("tags"), "near": trend, "medium": trend, "signals": trend, "terms": first(("conflict", hit("glossary"))), "definitions": first(("conflict", hit("glossary"))),
    }
    new = {"title": F.array("new_title"), "summary": F.array("new_summary"), "key_facts": new_facts}
    out = {c: new.get(c, F.when(reasons[c].isNull(), F.col(c)).otherwise(F.col(f"b_{c}"))) for c in FIELDS}
    repairs = F.filter(F.array(*(F.when(reasons[c].isNotNull(), F.struct(F.lit(c).alias("field"), reasons[c].alias("reason"))) for c in FIELDS)), lambda v: v.isNotNull())
    return rows.select(event, *(c for c in ("domain", "slot") if c in stories.columns), *(out[c].alias(c) for c in FIELDS), new_urls.alias("fact_urls"), repairs.alias("repairs"))


def _pieces(summary: Column) -> Column:
    """What of a summary could be its title: its clauses and sentences of 10 to 58 characters, sentence by sentence, but not all of it."""
    clean = F.trim(F.regexp_replace(strip_html(summary), r"\s+", " "))
    bare = lambda v: F.regexp_replace(v, r"(?U)[\p{P}\p{S}\s]+", "")
    each = F.transform(F.split(clean, r"(?<=[。！？!?])\s*"), lambda s: F.trim(F.regexp_replace(s, r"[。！？!?]+$", "")))
    parts = F.flatten(F.transform(F.filter(each, lambda s: s != ""), lambda s: F.concat(F.transform(F.split(s, "[，；]"), F.trim), F.array(s))))
    fit = lambda v: F.length(v).between(10, 58) & ~has_broken_quantifier(v) & (bare(v) != bare(clean)) & ~is_placeholder_title(v)
    return F.filter(parts, fit)
