"""Models learnt from counts: a multinomial classifier of texts and a tagger of word sequences.

Both are trained by grouped counts with smoothing, so training is as distributed as the counting. What they leave by
word is a table, joined by its size; what they leave by class or tag is as small as the number of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "([a-z0-9]+)"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


@dataclass
class Classifier:
    """weights: word, label, weight, what the word adds to a label beyond a word that the label never has; classes: label,
    prior, unseen, the logarithms of a label's share of rows and of such a word's share."""

    weights: DataFrame
    classes: DataFrame

    def write(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def read(cls, spark, path: str) -> Classifier:
        return cls(spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/classes"))


def train_classifier(rows: DataFrame, smoothing: float = 1.0) -> Classifier:
    """The multinomial model of rows (text, label). A word of the training rows has the share (n + smoothing) / (all words
    of the label + smoothing * different words); rows without a label are left out, a null text has no words."""
    known = rows.where("label is not null").select("label", words_of(F.col("text")).alias("w"))
    counts = known.select("label", F.explode("w").alias("word")).groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = counts.agg(F.count_distinct("word").alias("v"))
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("w")).alias("total"))
    all_ = sizes.agg(F.sum("rows").alias("all"))
    classes = sizes.join(F.broadcast(vocabulary)).join(F.broadcast(all_))  # one row each
    unseen = F.log(F.lit(smoothing) / (F.col("total") + smoothing * F.col("v")))
    weights = counts.select("word", "label", F.log((F.col("n") + smoothing) / smoothing).alias("weight"))
    return Classifier(weights, classes.select("label", F.log(F.col("rows") / F.col("all")).alias("prior"), unseen.alias("unseen")))


def classified(rows: DataFrame, model: Classifier) -> DataFrame:
    """row_index, pred, score of rows (row_index, text): the likeliest label, the smaller one of equals. Words that the
    model has never seen count for nothing, so a text without known words gets the commonest label.

    Words meet weights by an equi-join; a row keeps one number a label."""
    words = rows.select("row_index", F.explode(words_of(F.col("text"))).alias("word")).groupBy("row_index", "word").agg(F.count(F.lit(1)).alias("n"))
    by_word = model.weights.groupBy("word").agg(F.collect_list(F.struct("label", "weight")).alias("w"))  # a number a label
    met = words.join(by_word, "word")
    size = met.groupBy("row_index").agg(F.sum("n").alias("n"))
    told = met.select("row_index", "n", F.explode("w").alias("w")).groupBy("row_index", F.col("w.label").alias("label")).agg(F.sum(F.col("n") * F.col("w.weight")).alias("more"))
    told = told.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("label", "more"))).alias("more")).join(size, "row_index")
    every = model.classes.agg(F.sort_array(F.collect_list(F.struct("label", "prior", "unseen"))).alias("classes"))  # one row
    out = rows.select("row_index").join(told, "row_index", "left").join(F.broadcast(every))
    n = F.coalesce("n", F.lit(0))
    score = lambda c: c["prior"] + n * c["unseen"] + F.coalesce(F.element_at("more", c["label"]), F.lit(0.0))
    scored = F.transform("classes", lambda c: F.struct(score(c).alias("score"), c["label"].alias("label")))
    best = F.aggregate(F.slice(scored, 2, F.greatest(F.size(scored) - 1, F.lit(0))), F.get(scored, F.lit(0)), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
    return out.select("row_index", best.alias("b")).select("row_index", F.col("b.label").alias("pred"), F.col("b.score").alias("score"))


def shape(word: Column) -> Column:
    """A word in lower case, its digits all alike."""
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


@dataclass
class Tagger:
    """tags; first and after, logarithms of the tags' shares at the beginning and after each other, by number; words:
    word, shares, those of a word among each tag's; unseen, those of a word that no training row has."""

    tags: list[str]
    first: np.ndarray
    after: np.ndarray
    unseen: np.ndarray
    words: DataFrame


def may_follow(before: str | None, tag: str) -> bool:
    """An I- stands after a B- or I- of its label alone."""
    return not tag.startswith("I-") or (before is not None and before != "O" and before[2:] == tag[2:])


def train_tagger(tokens: DataFrame, smoothing: float = 0.1) -> Tagger:
    """The model of rows (id, pos, word, tag), tags as BIO; rows without a tag are stepped over. Counts of words, of tags at
    the beginning and of tags after tags come by grouping; only those by tag, a row a pair, come to the driver."""
    used = tokens.where("tag is not null and word is not null").select("id", "pos", shape(F.col("word")).alias("word"), "tag")
    pairs = used.withColumn("before", F.lag("tag").over(Window.partitionBy("id").orderBy("pos"))).groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n")).collect()
    tags = sorted({r["tag"] for r in pairs})
    at = {t: i for i, t in enumerate(tags)}
    counts = np.zeros((len(tags) + 1, len(tags)))
    for r in pairs:
        counts[at[r["before"]] if r["before"] is not None else -1, at[r["tag"]]] += r["n"]
    free = np.array([[may_follow(b, t) for t in tags] for b in [*tags, None]])
    with np.errstate(divide="ignore"):
        share = np.where(free, counts + smoothing, 0.0)
        share = np.log(share / np.maximum(share.sum(1, keepdims=True), 1e-300))
    by_word = used.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("n"))
    n_words, totals = by_word.count() + 1, counts.sum(0)
    each = [F.log((F.coalesce(F.element_at("n", F.lit(t)), F.lit(0)) + smoothing) / F.lit(float(totals[i] + smoothing * n_words))) for i, t in enumerate(tags)]
    words = by_word.select("word", F.array(*each).alias("shares")) if tags else by_word.select("word", F.array().cast("array<double>").alias("shares"))
    return Tagger(tags, share[-1], share[:-1], np.log(smoothing / (totals + smoothing * n_words)), words)


def best_path(first: np.ndarray, after: np.ndarray, shares: np.ndarray) -> list[int]:
    """The likeliest tags of a sequence whose words have the given shares (Viterbi), the smaller of equals."""
    score, back = first + shares[0], []
    for own in shares[1:]:
        reached = score[:, None] + after
        back.append(reached.argmax(0))
        score = reached.max(0) + own
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def tagged(tokens: DataFrame, model: Tagger) -> DataFrame:
    """id, pos, tag of rows (id, pos, word): the likeliest tags of each id's words, in the order of pos. Words meet their
    shares by an equi-join; a sequence is decoded in one row. Without a trained tag nothing comes out."""
    tags, first, after, unseen = model.tags, model.first, model.after, model.unseen
    if not tags:
        return tokens.select("id", "pos", F.lit(None).cast("string").alias("tag")).where("false")
    told = tokens.select("id", "pos", shape(F.coalesce("word", F.lit(""))).alias("word")).join(model.words, "word", "left")
    rows = told.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "shares"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column("s").to_pylist():
                path = best_path(first, after, np.array([x["shares"] or unseen for x in s]))
                out.append([{"pos": x["pos"], "tag": tags[i]} for x, i in zip(s, path)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.struct([("pos", pa.int64()), ("tag", pa.string())])))], ["id", "t"])

    rows = rows.select("id", F.transform("s", lambda x: F.struct(x["pos"].cast("long").alias("pos"), x["shares"].alias("shares"))).alias("s"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, t array<struct<pos:long,tag:string>>")
    return found.select("id", F.explode("t").alias("t")).select("id", "t.pos", "t.tag")
