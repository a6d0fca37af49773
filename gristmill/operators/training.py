"""Silver training data from the engine's own readings: augmented texts, classes, spans, and checks on them.

Randomness is a hash of (seed, row, step), so runs agree whatever the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import score

#: Words and the shorthand that contraction writes for their first occurrence.
SHORTHAND = {
    "light": "Lt", "lights": "Lts", "electric": "Elect", "white": "Wh", "black": "Bk", "stainless steel": "SS", "square": "Sq", "exterior": "Ext",
    "interior": "Int", "refrigerator": "Refrig", "dishwasher": "DW", "grooved": "Grvd", "primed": "Prmd", "professional": "Prof",
    "aluminum": "Alum", "galvanized": "Galv", "assembly": "Assy", "adjustable": "Adj", "receptacle": "Recep", "fluorescent": "Fluor",
    "reciprocating": "Recip", "circular": "Circ", "oscillating": "Osc", "cordless": "Crdls", "battery": "Batt", "charger": "Chgr",
    "diameter": "Dia", "thickness": "Thk", "mounting": "Mtg",
}
#: Separators, inch marks and endings that feeds use.
SEPARATORS, INCHES, ENDINGS = (" - ", ", ", " | ", " "), ("$1 in", "$1in", "$1 IN.", '$1"', "$1 inch"), ("", "", " - Display Only", " (Linear Foot)", " - Special Order", " NEW", " - Clearance")


def draw(n: int, *keys: Column, salt: int = 0) -> Column:
    """A number from 0 to n - 1 by a hash of the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(n)).cast("int")


def _one_of(choices, k: Column) -> Column:
    return reduce(lambda acc, p: F.when(k == p[0], p[1]).otherwise(acc), list(enumerate(choices))[1:], choices[0])


def contract_words(t: Column) -> Column:
    """Each known word's first occurrence in shorthand."""
    return reduce(lambda acc, p: F.regexp_replace(acc, rf"(?is)^(.*?)\b{p[0]}\b", f"$1{p[1]}"), SHORTHAND.items(), t)


def drop_mpn(t: Column, mpn: Column) -> Column:
    return text.strip_leading_mpn(t, mpn)


def add_mpn(t: Column, mpn: Column) -> Column:
    return F.when((mpn != "") & ~F.startswith(F.upper(t), F.upper(mpn)), F.concat_ws(" ", mpn, t)).otherwise(t)


def separator(t: Column, k: Column) -> Column:
    return _one_of([F.regexp_replace(t, r"(?s)^(.*?)\s+-\s+", "$1" + s) for s in SEPARATORS], k)


def recase(t: Column, k: Column) -> Column:
    """Upper, lower, title or as it is, by k of 20: 5, 4, 3 and 8 parts."""
    return F.when(k < 5, F.upper(t)).when(k < 9, F.lower(t)).when(k < 12, text.title_case(t)).otherwise(t)


def inch_style(t: Column, k: Column) -> Column:
    return _one_of([F.regexp_replace(t, r'(\d+(?:[-./]\d+)*)"', s) for s in INCHES], k)


def trailing_noise(t: Column, k: Column) -> Column:
    return F.concat(t, _one_of([F.lit(e) for e in ENDINGS], k))


def augmented(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows (row_index, text, mpn, label, confidence) as (row_index, text, label, augmentation, teacher_confidence):
    the text and its variants, those alike in text and label once (the first in order)."""
    t, mpn, key = F.col("text"), F.col("mpn"), F.col("row_index")
    k = lambda n, salt: draw(n, key, salt=seed * 100 + salt)
    made = [("original", t), ("contract", contract_words(t)), ("expand", text.expand(t)), ("drop_mpn", drop_mpn(t, mpn)), ("add_mpn", add_mpn(t, mpn)), ("separator", separator(t, k(4, 1))), ("case", recase(t, k(20, 2))), ("quotes", inch_style(t, k(5, 3))), ("noise", trailing_noise(t, k(7, 4)))]
    listed = F.posexplode(F.array(*(F.struct(F.lit(n).alias("augmentation"), x.alias("text")) for n, x in made))).alias("step", "v")
    flat = rows.select("row_index", "label", F.col("confidence").alias("teacher_confidence"), listed).select("row_index", "v.text", "label", "v.augmentation", "teacher_confidence", "step")
    # A digest stands for the text; copies collapse before the shuffle.
    key = F.sha2(F.lower("text").cast("binary"), 256)
    names = ["row_index", "text", "label", "augmentation", "teacher_confidence"]
    first = flat.groupBy(key.alias("_k"), "label").agg(F.min_by(F.struct(*names), F.struct("row_index", "step")).alias("f"))
    return first.select("f.*")


def split(rows: DataFrame, seed: int = 0, validation: float = 0.12) -> DataFrame:
    """rows with `fold`, 'train' or 'val', by a hash of row_index: variants of one row share a fold."""
    return rows.withColumn("fold", F.when(draw(10_000, F.col("row_index"), salt=seed) < int(validation * 10_000), "val").otherwise("train"))


def floored(rows: DataFrame, floor: int) -> DataFrame:
    """rows repeated so that each label has `floor` rows at least, as evenly as may be. Only rows of labels with fewer are
    numbered, so no window holds more than `floor` rows."""
    few = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < floor)
    same = F.col("label").eqNullSafe(F.col("_label"))
    few = few.withColumnRenamed("label", "_label")
    enough = rows.join(few.select("_label"), same, "left_anti")
    order = F.row_number().over(Window.partitionBy("label").orderBy("row_index"))
    times = F.floor(F.lit(floor) / F.col("_n")) + F.when(F.col("_r") <= F.lit(floor) % F.col("_n"), 1).otherwise(0)
    short = rows.join(few, same).withColumn("_r", order)
    return enough.unionByName(short.withColumn("_t", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*rows.columns))


def silver(rows: DataFrame, floor: int = 60, least: float = 0.70, validation: float = 0.12, seed: int = 0) -> DataFrame:
    """Training rows (row_index, text, label, augmentation, teacher_confidence, split) from classified rows (row_index,
    text, mpn, label, confidence): those that are sure enough, with their variants, each label `floor` times at least in
    the training part, split by a hash of the row so that variants of a row stay together."""
    sure = rows.where(F.col("label").isNotNull() & (F.col("confidence") >= least))
    made = split(augmented(sure, seed), seed, validation).withColumnRenamed("fold", "split")
    return floored(made.where("split = 'train'"), floor).unionByName(made.where("split = 'val'"))


def span_examples(rows: DataFrame) -> DataFrame:
    """id, start, end, label, value of the filled slots (row_index, text, filled in contract order), at the snippet's first
    place in the text, overlaps dropped: earliest first, then longest, then first in the contract."""
    each = rows.select(F.col("row_index").alias("id"), "text", F.posexplode("filled").alias("rank", "f")).where("f.end > f.start and trim(f.value) <> ''")
    snippet = F.substring("text", F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    placed = each.withColumn("start", F.instr(F.col("text"), snippet) - 1).where((F.col("start") >= 0) & (snippet != ""))
    label = F.upper(F.regexp_replace(F.regexp_replace("f.label", "[^A-Za-z]+", "_"), "^_+|_+$", ""))
    spans = placed.select("id", F.col("start").cast("int"), (F.col("start") + F.length(snippet)).cast("int").alias("end"), "rank", label.alias("label"), F.col("f.value").alias("value"))
    return score.without_overlaps(spans).drop("rank")


#: The parts of a training set.
SPLITS = ("train", "val")


def _is_blank(t: Column) -> Column:
    return ~F.coalesce(t, F.lit("")).rlike(r"(?U)\S")


def validation(classes: DataFrame, spans: DataFrame, class_labels: DataFrame, span_labels: DataFrame) -> DataFrame:
    """part, split, fault, n, examples: what is wrong with a training set; no rows where it may be used.

    classes: split, text, label; spans: split, text, entities (array of start, end, label); the declared labels, each a
    table with `label`. Faults of classes: 'no rows', 'empty text', 'unknown label', and for both splits at once ('all')
    'text of both splits', which counts texts that differ in more than case once. Faults of spans: 'no rows', 'offset out
    of range' (nulls too), and of those in range 'unknown label' and 'blank span'. `examples` are the first five unknown
    labels, a null label as '<none>'. Everything is counted by aggregation; texts meet by digests."""
    declared = lambda df: df.select(F.col("label").alias("_l")).where("_l is not null").distinct()
    nothing = F.lit(None).cast("string")
    shown = F.coalesce("label", F.lit("<none>"))

    def found(rows: DataFrame, part: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
        told = F.explode(F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("fault"), example.alias("example"))) for name, bad, example in checks))))
        return rows.select(F.lit(part).alias("part"), "split", told.alias("f")).select("part", "split", "f.*")

    named = classes.join(declared(class_labels), F.col("label") == F.col("_l"), "left")
    of_classes = found(named, "classes", [("empty text", _is_blank(F.col("text")), nothing), ("unknown label", F.col("_l").isNull(), shown)])
    entities = spans.select("split", F.coalesce("text", F.lit("")).alias("text"), F.explode("entities").alias("e")).select("split", "text", "e.start", "e.end", "e.label")
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")), F.lit(False))
    stretch = F.expr("substring(text, start + 1, end - start)")
    tagged = entities.join(declared(span_labels), F.col("label") == F.col("_l"), "left").withColumn("_in", inside)
    of_spans = found(tagged, "spans", [("offset out of range", ~F.col("_in"), nothing), ("unknown label", F.col("_in") & F.col("_l").isNull(), shown), ("blank span", F.col("_in") & _is_blank(stretch), nothing)])

    each = of_classes.unionByName(of_spans).groupBy("part", "split", "fault", "example").agg(F.count(F.lit(1)).alias("n"))
    key = ["part", "split", "fault"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("example"))
    listed = each.where("example is not null").withColumn("_r", first).where("_r <= 5").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("example")), ", ").alias("examples"))
    counted = each.groupBy(*key).agg(F.sum("n").alias("n")).join(listed, key, "left")

    held = classes.select(F.lit("classes").alias("part"), "split").unionByName(spans.select(F.lit("spans").alias("part"), "split")).distinct()
    expected = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).alias("split")) for p in ("classes", "spans") for s in SPLITS)))
    absent = classes.sparkSession.range(1).select(expected.alias("x")).select("x.*").join(held, ["part", "split"], "left_anti")
    empty = absent.select(*key[:2], F.lit("no rows").alias("fault"), F.lit(1).cast("long").alias("n"), nothing.alias("examples"))
    texts = classes.where("text is not null").groupBy(F.sha2(F.lower("text").cast("binary"), 256).alias("_t")).agg(F.count_distinct("split").alias("_s")).where("_s > 1")
    shared = texts.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("classes").alias("part"), F.lit("all").alias("split"), F.lit("text of both splits").alias("fault"), "n", nothing.alias("examples"))
    return counted.unionByName(empty).unionByName(shared).withColumn("examples", F.coalesce("examples", F.lit("")))


def faults(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """fault, n of spans (text, start, end, label): empty texts, unknown labels, offsets out of range, blank spans."""
    known = labels.select(F.col("label").alias("_l")).distinct()
    s = spans.join(known, F.col("label") == F.col("_l"), "left")
    out_of_range = (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end"))
    blank = ~out_of_range & (F.trim(F.expr("substring(text, start + 1, end - start)")) == "")
    found = F.array_compact(F.array(F.when(F.trim("text") == "", "empty text"), F.when(F.col("_l").isNull(), "unknown label"), F.when(out_of_range, "offset out of range"), F.when(blank, "blank span")))
    return s.select(F.explode(found).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
