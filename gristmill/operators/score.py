"""Confidence, review, triage, compliance, gold scoring and model metrics over cells and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from ..functions import fixed, text, units
from .learn import micro

#: Columns that a row needs to be usable.
CRITICAL = ("BRAND_NAME", "MANUFACTURER_NAME", "Classpath", "SHORT_DESC", "INVOICE_DESC", "MOBILE_DESC")


def source_weight(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in fixed.SOURCE_WEIGHTS.items() for x in p)), source), F.lit(0.5))


def quality(cells: DataFrame) -> DataFrame:
    """row_index, n_filled, provenance_quality, critical_score, generative_share, missing (critical headers, sorted)."""
    has = F.trim("value") != ""
    weighted = source_weight(F.col("source")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))
    per = cells.groupBy("row_index").agg(
        F.count_if(has).alias("n_filled"),
        F.avg(F.when(has, weighted)).alias("q"),
        F.count_if(has & F.col("source").isin("llm", "local_model")).alias("g"),
        F.collect_set(F.when(has & F.col("header").isin(*CRITICAL), F.col("header"))).alias("have"),
    )
    return per.select(
        "row_index", "n_filled", micro(F.coalesce("q", F.lit(0.0)) + 1e-9).alias("provenance_quality"), (F.size("have") / float(len(CRITICAL))).alias("critical_score"),
        F.when(F.col("n_filled") > 0, F.col("g") / F.col("n_filled")).otherwise(0.0).alias("generative_share"), F.array_except(F.array(*map(F.lit, CRITICAL)), "have").alias("missing"),
    )


def verdicts(cells: DataFrame, checks: DataFrame) -> DataFrame:
    """row_index, confidence, needs_review, reasons. checks: row_index, invoice_length, mobile_length, n_lov_violations,
    unclassified, brand_unresolved, margin, runner_up."""
    r = quality(cells).join(checks, "row_index", "left")
    tests = [
        (F.col("generative_share") > 0, F.lit("value(s) proposed by a model rather than read from the input"), 0.0),
        (F.col("invoice_length") > fixed.INVOICE_MAX, F.concat(F.lit("INVOICE_DESC is "), F.col("invoice_length").cast("string"), F.lit(" chars, over the 40 limit")), 0.25),
        ((F.col("mobile_length") > 0) & ~F.col("mobile_length").between(fixed.MOBILE_MIN, fixed.MOBILE_MAX), F.concat(F.lit("MOBILE_DESC is "), F.col("mobile_length").cast("string"), F.lit(" chars, outside the 60-80 window")), 0.10),
        (F.col("n_lov_violations") > 0, F.concat(F.col("n_lov_violations").cast("string"), F.lit(" attribute value(s) outside the controlled vocabulary")), 0.25),
        (F.col("unclassified"), F.lit("no taxonomy match, generic template used"), 0.20),
        (F.col("brand_unresolved"), F.lit("brand unresolved: no column, alias, account or group names it"), 0.20),
        ((F.col("margin") > 0) & (F.col("margin") < 0.10), F.concat(F.lit("classification was near-tied with "), F.coalesce("runner_up", F.lit("the runner-up"))), 0.08),
    ]
    sure = lambda c: F.coalesce(c, F.lit(False))
    empty = F.col("n_filled") == 0
    blanks = F.transform("missing", lambda h: F.concat(h, F.lit(" is empty")))
    reasons = F.when(empty, F.array(F.lit("no cell was populated at all"))).otherwise(F.concat(blanks, F.array_compact(F.array(*(F.when(sure(c), why) for c, why, _ in tests)))))
    penalty = sum((F.when(sure(c), p).otherwise(0.0) for c, _, p in tests), F.lit(0.0))
    base = 0.45 * F.col("provenance_quality") + 0.30 * F.col("critical_score") + 0.25 * (1.0 - F.col("generative_share"))
    # A hair above ties, which sums of decimals in doubles fall on either side of.
    confidence = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)))
    return r.select("row_index", micro(confidence + 1e-9).alias("confidence"), reasons.alias("reasons")).withColumn("needs_review", (F.size("reasons") > 0) | (F.col("confidence") < fixed.REVIEW))


def bucket(confidence: Column, needs_review: Column) -> Column:
    return F.when((confidence >= fixed.AUTO) & ~needs_review, "auto_publish").when(confidence >= fixed.BLOCKED, "needs_review").otherwise("blocked")


def triage(verdict: DataFrame) -> DataFrame:
    return verdict.groupBy(bucket(F.col("confidence"), F.col("needs_review")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def row_tone(confidence: Column, needs_review: Column) -> Column:
    return F.when(confidence < fixed.BLOCKED, "blocked").when(needs_review, "review").otherwise("")


def reason_key(reason: Column) -> Column:
    key = reason
    for mark in (":", " is ", " value(s)"):
        key = F.substring_index(key, mark, 1)
    return F.substring(F.trim(key), 1, 70)


def reason_histogram(verdict: DataFrame) -> DataFrame:
    return verdict.select(F.explode("reasons").alias("r")).groupBy(reason_key(F.col("r")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def source_histogram(cells: DataFrame, blank: bool = False) -> DataFrame:
    """Cells by source: those with values, or the blank ones."""
    has = F.trim("value") != ""
    return cells.where(~has if blank else has).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def compliance(rows: DataFrame) -> DataFrame:
    """One row of checks over rows with INVOICE_DESC, MOBILE_DESC, SHORT_DESC, LONG_DESC1 and RETAIL_DESC."""
    inv, mob = F.coalesce("INVOICE_DESC", F.lit("")), F.coalesce("MOBILE_DESC", F.lit(""))
    glued = units.glued_unit(F.col("SHORT_DESC")) | units.glued_unit(F.col("LONG_DESC1")) | units.glued_unit(F.col("RETAIL_DESC")) | units.glued_unit(mob)
    share = lambda a, b: micro(100.0 * a / F.greatest(b, F.lit(1)), 2)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        share(F.count_if((inv != "") & (F.length(inv) <= 40)), F.count_if(inv != "")).alias("invoice_within_40_chars_pct"),
        share(F.count_if((inv == "") | ((inv == F.upper(inv)) & inv.rlike("[A-Za-z]"))), F.count(F.lit(1))).alias("invoice_all_caps_pct"),
        share(F.count_if(F.length(mob).between(60, 80)), F.count_if(mob != "")).alias("mobile_within_60_80_pct"),
        F.count_if(glued).alias("uom_spacing_violations"),
    )


def lov_violations(pairs: DataFrame, lov: DataFrame) -> DataFrame:
    """The (row_index, label, value) whose label has permitted values and the value is none of them."""
    governed = pairs.where(F.trim("value") != "").join(lov.select("label").distinct(), "label", "left_semi")
    return governed.join(lov, ["label", "value"], "left_anti")


def gold_scores(got: DataFrame, gold: DataFrame, fields: list[str], key: str = "Mfg_Part_Num") -> DataFrame:
    """field, compared, exact, normalised: outputs against a labelled table; of repeated keys the last row counts."""
    last = F.row_number().over(Window.partitionBy(F.trim(key)).orderBy(F.col("row_index").desc()))
    wanted = gold.where(F.trim(key) != "").withColumn("_n", last).where("_n = 1")
    long = lambda df, name: df.select(F.trim(F.col(key)).alias("_k"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(F.col(f"`{f}`"), F.lit(""))).alias("v")) for f in fields))).alias("x")).select("_k", "x.field", F.col("x.v").alias(name))
    pairs = long(got, "got").join(long(wanted, "want").where("want <> ''"), ["_k", "field"])
    same = F.col("got") == F.col("want")
    return pairs.groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.count_if(same).alias("exact"), F.count_if(text.normalised(F.col("got")) == text.normalised(F.col("want"))).alias("normalised"))


def classification_metrics(pairs: DataFrame) -> DataFrame:
    """accuracy and macro F1 (over labels in the truth) of (label, pred)."""
    counts = pairs.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    truth = counts.groupBy("label").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    guessed = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("p"))
    per = truth.join(guessed, "label", "left").withColumn("f1", 2.0 * F.col("tp") / (F.col("t") + F.coalesce("p", F.lit(0))))
    return per.agg(micro(F.sum("tp") / F.sum("t")).alias("accuracy"), micro(F.avg("f1")).alias("macro_f1"))


def align_bio(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """id, pos, tag of tokens (id, pos, start, end): B- or I- of the first entity (id, ord, e_start, e_end, label) that
    holds the whole token, else O; null for empty tokens."""
    inside = tokens.join(entities, "id", "left").withColumn("hit", (F.col("start") >= F.col("e_start")) & (F.col("end") <= F.col("e_end")))
    best = inside.groupBy("id", "pos", "start", "end").agg(F.min_by(F.when(F.col("hit"), F.struct("e_start", "label")), F.when(F.col("hit"), F.col("ord"))).alias("e"))
    tag = F.when(F.col("start") == F.col("end"), None).when(F.col("e").isNull(), "O").otherwise(F.concat(F.when(F.col("start") == F.col("e.e_start"), "B-").otherwise("I-"), F.col("e.label")))
    return best.select("id", "pos", tag.alias("tag"))


def decode_spans(tags: DataFrame) -> DataFrame:
    """id, start, stop, label of the spans in (id, pos, tag): null tags are stepped over, an I- without its B- opens
    nothing, and what is open at the end runs to the sequence's length."""
    length = tags.groupBy("id").agg((F.max("pos") + 1).alias("n"))
    used = tags.where("tag is not null")
    order = Window.partitionBy("id").orderBy("pos")
    name = F.substring("tag", F.lit(3), F.length("tag"))
    before = F.lag("tag").over(order)
    goes_on = F.col("tag").startswith("I-") & before.isNotNull() & (before != "O") & (F.substring(before, F.lit(3), F.length(before)) == name)
    marked = used.withColumn("label", name).withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
    runs = marked.groupBy("id", "run").agg(F.min("pos").alias("start"), F.min_by("tag", "pos").alias("first"), F.min_by("label", "pos").alias("label"))
    runs = runs.withColumn("next", F.lead("start").over(Window.partitionBy("id").orderBy("run")))
    return runs.where(F.col("first").startswith("B-")).join(length, "id").select("id", "start", F.coalesce("next", "n").alias("stop"), "label")


def span_metrics(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """precision, recall and F1 of spans (id, start, stop, label)."""
    keys = ["id", "start", "stop", "label"]
    both = predicted.select(*keys, F.lit(1).alias("p")).distinct().join(actual.select(*keys, F.lit(1).alias("a")).distinct(), keys, "full_outer")
    tp, p, a = F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()), F.count("p"), F.count("a")
    share = lambda x, y: micro(F.when(y > 0, x / y).otherwise(0.0))
    return both.agg(share(tp, p).alias("entity_precision"), share(tp, a).alias("entity_recall"), share(2 * tp, p + a).alias("entity_f1"))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """spans (id, start, end, label or more) without those that begin inside a kept one: earliest first, then longest,
    then by the other columns in their order."""
    rest = [c for c in spans.columns if c not in ("id", "start", "end")]
    kind = "array<struct<start:int,neg:int," + ",".join(f"{c}:{spans.schema[c].dataType.simpleString()}" for c in rest) + ">>"
    listed = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), *rest))).alias("s"))
    last = lambda acc: F.coalesce(-F.element_at(acc, -1)["neg"], F.lit(0))
    kept = F.aggregate(F.col("s").cast(kind), F.array().cast(kind), lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] < F.when(F.size(acc) > 0, last(acc)).otherwise(0)), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("id", F.explode(kept).alias("k")).select("id", F.col("k.start").alias("start"), (-F.col("k.neg")).alias("end"), *(f"k.{c}" for c in rest))


def merged_spans(spans: DataFrame) -> DataFrame:
    """id, start, end: overlapping spans as one."""
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return spans.withColumn("new", new).withColumn("run", F.sum("new").over(order)).groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def review_queue(rows: DataFrame) -> DataFrame:
    """Flagged rows, least confident first, in the queue's columns."""
    cols = ["Mfg_Part_Num", "Part_Desc", "BRAND_NAME", "MANUFACTURER_NAME", "Classpath", "SHORT_DESC", "INVOICE_DESC", "MOBILE_DESC"]
    out = rows.where("needs_review").select("row_index", micro(F.col("confidence"), 3).alias("confidence"), *cols[:7], F.length("INVOICE_DESC").alias("invoice_chars"), "MOBILE_DESC", F.length("MOBILE_DESC").alias("mobile_chars"), F.array_join("reasons", " | ").alias("review_reasons"))
    return out.orderBy("confidence", "row_index")


def histogram(rows: DataFrame, key: str, seen: str) -> DataFrame:
    """key, n: the most frequent first, equals in the order in which `seen` is least."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("_seen"))
    return counts.orderBy(F.col("n").desc(), "_seen").drop("_seen")


def placed(rows: DataFrame, group: str, value: str, seen: str) -> DataFrame:
    """group, value, place of the values of each group: the most frequent first, equals in the order seen."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("_seen"))
    return counts.select(group, value, F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "_seen")).alias("place"))


def sources_by_row(cells: DataFrame) -> DataFrame:
    """row_index, source, n of the cells with a value."""
    return C.filled(cells).groupBy("row_index", "source").agg(F.count(F.lit(1)).alias("n"))


def run_stats(cells: DataFrame) -> DataFrame:
    """One row: rows, classified (rows with a class), filled (cells with a value), proposed (those of a model)."""
    has = F.trim("value") != ""
    return cells.agg(
        F.count_distinct("row_index").alias("rows"),
        F.count_distinct(F.when((F.col("header") == "Classpath") & has, F.col("row_index"))).alias("classified"),
        F.count_if(has).alias("filled"),
        F.count_if(F.col("source").isin("llm", "local_model") & has).alias("proposed"),
    )


def coverage(cells: DataFrame) -> DataFrame:
    """row_index, coverage: the share of a row's cells that hold a value."""
    return cells.groupBy("row_index").agg(micro(F.avg((F.trim("value") != "").cast("double"))).alias("coverage"))


def shared_spans(one: DataFrame, other: DataFrame) -> DataFrame:
    """The spans (id, start, stop, label) that both hold."""
    keys = ["id", "start", "stop", "label"]
    return one.select(keys).intersect(other.select(keys))


def leaked(train: DataFrame, validation: DataFrame, text: str = "text") -> DataFrame:
    """One row: `leaked`, the number of texts, case ignored, that both hold. A digest stands for a text in the shuffle."""
    key = lambda df: df.select(F.sha2(F.lower(text).cast("binary"), 256).alias("t"))
    return key(train).intersect(key(validation)).agg(F.count(F.lit(1)).alias("leaked"))


def keep_first(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of least `order` for each combination of `by`, compared without regard to case, by a digest."""
    key = F.sha2(F.concat_ws("\x00", *(F.concat(F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.lower(c), F.lit(""))) for c in by)).cast("binary"), 256)
    keyed = rows.withColumn("_k", key)
    first = keyed.groupBy("_k").agg(F.min(order).alias(order))
    return keyed.join(first, ["_k", order], "left_semi").drop("_k")


QUEUE = ("Mfg_Part_Num", "Part_Desc", "BRAND_NAME", "MANUFACTURER_NAME", "Classpath", "SHORT_DESC", "INVOICE_DESC", "MOBILE_DESC")
CHANNELS = ("SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MOBILE_DESC", "INVOICE_DESC")


def queue_rows(cells: DataFrame, verdict: DataFrame) -> DataFrame:
    """What review_queue() needs of each row: its verdict and the values of the queue's columns."""
    return C.wide(cells.where(F.col("header").isin(*QUEUE)), QUEUE).join(verdict, "row_index")


def channel_check(got: DataFrame, want: DataFrame, key: str = "Mfg_Part_Num", channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """channel, compared, matched over the rows of `want` (key and channel texts; an empty text asks for nothing)."""
    each = lambda df: F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.coalesce(c, F.lit("")).alias("said")) for c in channels if c in df.columns))).alias("x")
    asked = want.select(key, each(want)).select(key, "x.channel", F.col("x.said").alias("want")).where("want <> ''")
    have = got.select(key, each(got)).select(key, "x.channel", F.col("x.said").alias("got"))
    same = F.count_if(F.col("got").eqNullSafe(F.col("want")))
    return asked.join(have, [key, "channel"], "left").groupBy("channel").agg(F.count(F.lit(1)).alias("compared"), same.alias("matched"))


def payload(cells: DataFrame, verdict: DataFrame) -> DataFrame:
    """section, name, value of a run's figures: run, triage, sources (of filled cells) and blanks (of empty ones)."""
    run = run_stats(cells)
    run = run.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in run.columns))).alias("x")).select("x.*")
    parts = {"run": run, "triage": triage(verdict), "sources": source_histogram(cells), "blanks": source_histogram(cells, blank=True)}
    out = [df.toDF("name", "n").select(F.lit(k).alias("section"), "name", F.col("n").cast("long").alias("value")) for k, df in parts.items()]
    return reduce(DataFrame.unionByName, out)


def evaluate(cells: DataFrame, verdict: DataFrame, gold: DataFrame | None = None, key: str = "Mfg_Part_Num") -> dict:
    """The figures of a run's report: run, compliance, triage, sources, blanks and reasons; with `gold` (labelled rows in
    delivery columns) also the accuracy of each field and the channels that match. Each part is a small aggregate."""
    told: dict[str, dict] = {"run": {}, "triage": {}, "sources": {}, "blanks": {}}
    for r in payload(cells, verdict).orderBy(F.col("value").desc(), "name").collect():  # a row a figure
        told[r["section"]][r["name"]] = r["value"]
    wide = C.wide(cells.where(F.col("header").isin(*CHANNELS)), CHANNELS)
    out = {
        **told,
        "compliance": compliance(wide).first().asDict(),
        "reasons": {r["reason"]: r["n"] for r in reason_histogram(verdict).orderBy(F.col("n").desc(), "reason").collect()},
    }
    if gold is not None:
        fields = [c for c in gold.columns if c not in ("row_index", key)]
        got = C.wide(cells.where(F.col("header").isin(key, *fields)), [key, *fields])
        out["fields"] = {r["field"]: {"compared": r["compared"], "exact": r["exact"], "normalised": r["normalised"]} for r in gold_scores(got, gold, fields, key).collect()}
        out["channels"] = {r["channel"]: f"{r['matched']} of {r['compared']}" for r in channel_check(got, gold, key, tuple(c for c in CHANNELS if c in fields)).collect()}
    return out
