"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed single words, word beginnings (the first `STEM` bytes, so that inflected
and compounded forms share one), word pairs and pairs with one word between (present or not; words are runs
of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased). Training
takes a bounded sample, the first `most` labelled rows by hash order, in one task;
per-coordinate rates and the L1 term leave few non-zero weights, which is what scoring broadcasts: never
more than 2**bits of them. Scoring is a map over the documents without any shuffle of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, mixed, packed, texts_of, trimmed, word_hashes
from .decontaminate import _FOLD

STEM = 6
_SKIP, _STEM = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C3C3C3C3C3C3C3C)


def features(texts: list[bytes], bits: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every occurrence."""
    folded = [t.translate(_FOLD) for t in texts]
    hashes, edges = word_hashes(folded, rolling)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    owners, out = [owner, owner], [hashes, word_hashes(folded, rolling, STEM)[0] ^ _STEM]
    for gap, salt in ((1, np.uint64(0)), (2, _SKIP)):
        if len(hashes) > gap:
            same = owner[gap:] == owner[:-gap]
            owners.append(owner[:-gap][same])
            out.append(mixed(hashes[:-gap] * np.uint64(3) + hashes[gap:] ^ salt)[same])
    return np.concatenate(owners), (mixed(np.concatenate(out)) >> np.uint64(64 - bits)).astype(np.int64)


def fit(rows: list[tuple[bytes, int]], *, bits: int = 20, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the rows (text, label), in the order given."""
    rolling, sets = Rolling(3), []
    for at in range(0, len(rows), 64):
        texts = [t for t, _ in rows[at : at + 64]]
        owner, feature = features(texts, bits, rolling)
        pairs = np.unique(owner << bits | feature)
        cuts = np.searchsorted(pairs, np.arange(len(texts) + 1) << bits)
        sets += [(pairs[a:b] & ((1 << bits) - 1)).astype(np.int32) for a, b in zip(cuts, cuts[1:])]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    labels = [y for _, y in rows]
    positive = sum(labels)
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 1.5)))
    bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, y in zip(sets, labels):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    kept = np.flatnonzero(np.abs(z) > l1)
    return kept, weights(kept), bias


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = 8000, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    `most` bounds the sample, taken by the order of a hash of the id. Labels other than 0 and 1 and
    null ids are left out; an id labelled twice takes the larger label, an id with several texts the least. Without
    labels the model is a constant below one half."""
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where((~held_out(F.col("id"))) & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    order = (F.xxhash64("id", F.lit(11)), F.col("id"))
    sample = known.orderBy(*order).limit(most).collect()
    if not sample:
        return np.zeros(0, np.int64), np.zeros(0), -1.0
    chosen = spark.createDataFrame(sample, known.schema)  # at most `most` rows of two numbers
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("body").alias("body"))

    def learn(key, table):
        table = table.sort_by([("rank", "ascending"), ("id", "ascending")])
        kept, weights, bias = fit(list(zip(texts_of(table.column("body")), table.column("y").to_pylist())), **options)
        return pa.table({"features": [kept.astype("<i8").tobytes()], "weights": [weights.astype("<f8").tobytes()], "bias": [bias]}, pa.schema([("features", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64())]))

    model = rows.select("id", "y", "body", F.xxhash64("id", F.lit(12)).alias("rank"), F.lit(1).alias("one")).groupBy("one").applyInArrow(learn, "features binary, weights binary, bias double").first()
    if model is None:
        return np.zeros(0, np.int64), np.zeros(0), -1.0
    return np.frombuffer(model["features"], "<i8"), np.frombuffer(model["weights"], "<f8"), model["bias"]


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the held-out fold; a null id does, since it is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text: str = "text", bits: int = 20) -> tuple[DataFrame, str]:
    """Every row and column of `docs` and a score column, whose name is the second value. Empty and null texts get
    the score of a text without features."""
    name = f"score_{uuid.uuid4().hex}"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weights, bias = sent.value
        rolling, dense = Rolling(3), np.zeros(1 << bits)
        dense[kept] = weights
        for part in packed(batches, text, 1 << 20):
            texts = texts_of(as_bytes(part.column(text)))
            owner, feature = features(texts, bits, rolling)
            heavy = np.flatnonzero(dense[feature])
            pairs = np.unique(owner[heavy] << bits | feature[heavy])
            total = np.bincount(pairs >> bits, dense[pairs & ((1 << bits) - 1)], len(texts)) + bias
            at = part.schema.get_field_index(name)
            yield from part.set_column(at, part.schema.field(at), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))).combine_chunks().to_batches()

    out = docs.withColumn(name, F.lit(None).cast("double"))
    return out.mapInArrow(trimmed(run), out.schema), name


def report(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score and predicted (1 from a score of 0.5)."""
    out, name = scored(docs.select(doc_id, text), train(docs, labels, doc_id=doc_id, text=text, **options), text=text)
    return out.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that score below one half, with the columns of `docs`."""
    out, name = scored(docs, train(docs, labels, **options), text=options.get("text", "text"))
    return out.where(F.col(name) < 0.5).drop(name)
