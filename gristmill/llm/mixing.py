"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Sizes are words. Sources weigh 1, 2, 3, repeating, in code point order (null last) and share the total; a
target stops at `repeats` times its source's size and the excess is reshared by weight (water-filling, solved
in closed form over the sources).

Schedule: slot t carries the golden-ratio point frac((t + 1) * phi), which falls on one source through the
cumulative targets; the slots of a source are ranked, and its slot j takes words [j * block, (j + 1) * block)
of the source's shuffled documents laid end to end and repeated. A source whose slots fall short of its
target by the sequence's discrepancy gets its last blocks at the end, and its last block is cut at the
target, so every source takes its rounded target exactly.

Scale: documents are read once, for their word counts. Ranks and positions come in two levels, over
hash-range buckets and then within a bucket, so that no source, however hot, is one task's work. Tables of one
row a source are the only ones held whole; they are joined by size, not by hint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parallelism

#: Fixed value: the fractional part of the golden ratio.
PHI = 0.6180339887498949
_WORDS = r"[^\x20\x09-\x0D]+"
_CELLS = 1024


def targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """Per source (null included): source, source_id (rank), weight, source_size, target.

    The windows without partitions run over one row a source. With no words at all, every target is 0."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_id", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", (F.col("source_id") % 3 + 1).cast("double"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    # Sources fill up in the order of cap / weight; the level after the first k are full shares the rest by weight.
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "source_id").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    per = per.withColumn("level", (F.col("total") - before("cap")) / (F.col("weights") - before("weight")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.withColumn("final", F.max(fits).over(every))  # the first that fits: levels fall from there on
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce("final", F.lit(float("inf"))))
    return per.select("source", "source_id", "weight", "source_size", "n_docs", F.when(F.col("total") > 0, target).otherwise(0.0).alias("target"))


def _ranked(df: DataFrame, keys: list[str], bucket: str, order: list, amount) -> DataFrame:
    """df with `before`: the sum of `amount` over the rows of the same keys that come earlier by (bucket, order).
    Sums of buckets first, then sums within a bucket."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.join(sums, [*keys, bucket]).withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in")


def laid_out(sizes: DataFrame, sources: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Documents with words: id, size, source_id, source_size, target and `before`, their first word's position in the
    source's shuffled stream. Rows that agree in source, id and size are interchangeable: they are counted before
    anything is dealt, lie next to each other, and are told apart again by their number."""
    per_bucket, run = 1000, 4096
    rows = sizes.where("size > 0").groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("copies"))
    known = rows.join(sources.select("source", "source_id", "source_size", "n_docs", "target"), rows["source"].eqNullSafe(sources["source"])).drop("source")
    buckets = F.greatest(F.lit(1), F.col("n_docs").cast("long") / per_bucket).cast("long")
    draw = F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.lit(1 << 40))
    known = known.withColumn("draw", draw).withColumn("bucket", F.shiftrightunsigned(F.col("draw"), 20) * buckets / (1 << 20)).withColumn("bucket", F.col("bucket").cast("long"))
    laid = scratch.store(_ranked(known, ["source_id"], "bucket", ["draw", "id", "size"], F.col("size") * F.col("copies")).drop("bucket", "draw", "n_docs"), "laid")
    most = laid.agg(F.max("copies")).first()[0] or 0
    if most > 1:
        laid = laid.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / run))))
        if most > run:  # one key's rows are numbered by as many tasks as others'
            laid = laid.repartition(parallelism(sizes.sparkSession), "before", "run")
        nth = F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, "copies") - 1))
        laid = laid.withColumn("nth", nth).withColumn("before", F.col("before") + F.col("nth") * F.col("size")).drop("run", "nth")
    return laid.drop("copies")


def slots(sources: DataFrame, block: int) -> DataFrame:
    """The schedule: slot, source_id, rank (of the slot within its source)."""
    spark = sources.sparkSession
    goal = sources.select("source_id", F.floor(F.col("target") + 0.5).cast("long").alias("goal")).withColumn("need", F.ceil(F.col("goal") / block).cast("long"))
    every = Window.partitionBy(F.lit(0))
    upto = F.sum("goal").over(Window.partitionBy(F.lit(0)).orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("goal").over(every)
    bounds = goal.where("goal > 0").withColumn("hi", upto).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("source_id")), F.lit(0.0)))
    n, n_sources = (int(x or 0) for x in goal.agg(F.sum("need"), F.count(F.lit(1))).first())
    # A source covers the cells that its interval meets: an equi-join on cells instead of a comparison of all pairs.
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.least(F.floor(F.col("hi") * _CELLS), F.lit(_CELLS - 1)))))
    point = F.col("id") * F.lit(PHI) + F.lit(PHI)
    points = spark.range(n).withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * _CELLS))
    drawn = points.join(cells, "cell").where("u >= lo and u < hi").select(F.col("id").alias("slot"), "source_id", "need")
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / 65536))
    drawn = _ranked(drawn, ["source_id"], "chunk", ["slot"], F.lit(1)).withColumnRenamed("before", "rank").where("rank < need")
    have = drawn.groupBy("source_id").agg(F.count(F.lit(1)).alias("have"))
    short = goal.join(have, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    tail = short.select(F.col("source_id"), F.explode(F.sequence("have", F.col("need") - 1)).alias("rank")).select((F.lit(n) + F.col("rank") * n_sources + F.col("source_id")).alias("slot"), "source_id", "rank")
    return drawn.select("slot", "source_id", "rank").unionByName(tail)


def pieces(laid: DataFrame, block: int, repeats: int) -> DataFrame:
    """The documents cut at block edges, once for each pass over the source that the target reaches:
    source_id, rank (of the block), before, id, size, epoch, first (word of the document), words."""
    goal = F.floor(F.col("target") + 0.5).cast("long")
    passes = laid.withColumn("goal", goal).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("at", F.col("before") + F.col("epoch") * F.col("source_size")).where("at < goal")
    passes = passes.withColumn("upto", F.least(F.col("at") + F.col("size"), F.col("goal")))
    cut = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("upto") - 1) / block))))
    start, stop = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("upto"), (F.col("rank") + 1) * block)
    return cut.select("source_id", "rank", "before", "id", "size", "epoch", (start - F.col("at")).alias("first"), (stop - start).alias("words"))


def schedule(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 1024, repeats: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mix, laid, sources, sizes): the mix as pieces in slot order (slot, source_id, id, epoch, first, words, ...), the
    documents' places, the sources and the documents' sizes. Null text has no words; null is a source of its own, the
    last."""
    sizes = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long").alias("size"))
    sizes = scratch.store(sizes, "sizes")
    sources = scratch.store(targets(sizes, repeats), "sources")
    laid = laid_out(sizes, sources, seed, scratch)
    mix = pieces(laid, block, repeats).join(slots(sources, block), ["source_id", "rank"])
    return mix, laid, sources, sizes


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    mix, laid, sources, sizes = schedule(docs, Scratch(docs.sparkSession, "mixing"), **options)
    # A document's place in its source names its row, so repeated ids stay apart; documents the mix leaves out have taken 0.
    drawn = mix.groupBy("source_id", "before").agg(F.sum("words").alias("taken"))
    kept = laid.select("source_id", "before", "id", "size", "source_size", "target").join(drawn, ["source_id", "before"], "left")
    empty = sizes.where("size = 0").join(sources, sizes["source"].eqNullSafe(sources["source"])).select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    out = kept.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(empty)
    return out.withColumnRenamed("id", options.get("doc_id", "doc_id"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as a pass of the mix begins with their first word, 0 to `repeats` times, with the
    columns of `docs`: the schedule rounded to whole documents. Rows without words are never drawn."""
    scratch = Scratch(docs.sparkSession, "mixing")
    row = f"row_{uuid.uuid4().hex}"
    rows = scratch.store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written, so that the numbers stay
    mix, _, _, _ = schedule(rows, scratch, **(options | {"doc_id": row}))
    times = scratch.store(mix.where("first = 0").groupBy(F.col("id").alias(row)).agg(F.count(F.lit(1)).cast("int").alias(f"n_{row}")), "times")
    scratch.drop(*(t for t, _ in scratch.tables if t is not rows and t is not times))
    # The counts grow with the rows: a broadcast that their files' size suggests would too.
    return rows.join(times.hint("merge"), row).withColumn(f"n_{row}", F.explode(F.sequence(F.lit(1), F.col(f"n_{row}")))).select(*docs.columns)
