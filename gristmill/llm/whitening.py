"""Embedding whitening: principal components from MLlib's singular values of the centred rows.

The fit list is every distinct integer vector once; grouping merges copies before they travel. Its count and exact
sums centre the rows, which go as a distributed `RowMatrix` to `computeSVD`: the right singular vectors are the
components, and a singular value s of n rows is the eigenvalue s * s / n of the covariance with divisor n. Total
variance doesn't come from the singular values but from the exact deviations of the rows. Rows are projected in Arrow
batches; the driver holds vectors of one row's length, and computeSVD one matrix of that length squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Entries beyond this are left at it: a long holds them, and floats tell them apart no better.
_EDGE = float(1 << 62)
_COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part: x = floor(256 * c) as longs."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    usable = usable.where(F.col("c").isNotNull() & ~F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return usable.select("vec_id", F.transform("c", lambda x: F.floor(F.greatest(F.least(x * 256.0, F.lit(_EDGE)), F.lit(-_EDGE)))).alias("x"))


def _literal(values: list[float]) -> Column:
    """An array of doubles as one literal, whatever its length."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<double>")


def projected(rows: DataFrame, n: int, sums: list[int], wide: bool, axes: np.ndarray) -> DataFrame:
    """(vec_id, deviation, size, w) of rows (vec_id, x): the sum over dimensions of (n * x - S)**2 as a long (null
    beyond) and as a double, and the centred row's products with `axes`. If `wide`, integers may pass 64 bits."""
    means, kind = np.array([float(Fraction(s, n)) for s in sums]), object if wide else np.int64
    shape = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("size", pa.float64()), ("w", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, dtype=kind)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            squares = ((n * x.astype(kind) - total) ** 2).sum(1)
            w = ((x - means) @ axes.T).ravel()
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, len(axes), dtype=np.int32)), pa.array(w))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v if v < 1 << 63 else None for v in squares.tolist()], pa.int64()), pa.array(squares.astype(float)), w], schema=shape)

    return rows.mapInArrow(run, "vec_id long, deviation long, size double, w array<double>")


def principal(centred: DataFrame, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows) of the covariance, divisor n, of the rows of `centred` (vector: array<double>):
    the largest `count`, fewer where the rows span less. More than half of all are asked for, as MLlib then decomposes
    the rows' Gram matrix to double precision; for fewer it iterates, and stops at 1e-10."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("vector").alias("vector")), "vector")
    found = RowMatrix(rows).computeSVD(max(count, rows.first()["vector"].size // 2 + 1), computeU=False, rCond=1e-7)
    return found.s.toArray()[:count] ** 2 / n, found.V.toArray().T[:count]


def whiten(vectors: DataFrame, *, count: int = 4, dim: int | None = None) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding) that takes part and per component up to `count`: vec_id, component (from
    1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry take no part, nor do those whose length isn't `dim`, by
    default the commonest length (of equally common ones the longest). Rows that repeat a vec_id, or have none, are rows
    of their own; a vector counts in the fit once, however many rows have it. Directions without variance (singular
    values below 1e-7 of the largest) are no components, so vectors that are all alike, and an empty table, give no rows. A
    deviation beyond a long is null. Entries beyond 2**62 count as that."""
    spark = vectors.sparkSession
    rows = integers(vectors)
    if dim is None:
        common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = common["dim"] if common else 0
    if not dim:
        return spark.createDataFrame([], _COLUMNS)
    rows = rows.where(F.size("x") == dim)
    scratch = Scratch(spark, "whitening")
    fit = scratch.store(rows.select("x").distinct(), "fit")
    places = fit.select(F.posexplode("x").alias("place", "v")).groupBy("place")
    told = places.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("place").collect()  # a row a dimension
    if not told or all(r["low"] == r["high"] for r in told):
        return spark.createDataFrame([], _COLUMNS)
    n, sums = told[0]["n"], [int(r["s"]) for r in told]
    reach = max(max(abs(n * r["low"] - int(r["s"])), abs(n * r["high"] - int(r["s"]))) for r in told)
    wide = dim * reach * reach >= 1 << 63 or n * max(abs(v) for r in told for v in (r["low"], r["high"])) >= 1 << 62
    means = _literal([float(Fraction(s, n)) for s in sums])
    centred = fit.select(F.zip_with("x", means, lambda v, m: v.cast("double") - m).alias("vector"))
    values, components = principal(centred, n, min(count, dim))
    axes = components / np.sqrt(values)[:, None]

    own = projected(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), n, sums, wide, axes)
    pairs = [(i, j) for i in range(len(axes)) for j in range(i, len(axes))]
    size = F.sum("size") if wide else F.sum(F.col("deviation").cast("decimal(38,0)"))
    told = own.agg(size.alias("size"), *(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    total = float(Fraction(told["size"]) / n**3)
    error = float(max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs))

    out = projected(rows, n, sums, wide, axes).select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    shares = _literal([float(e) / total for e in values])
    return out.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "place").alias("explained"), F.lit(error).alias("identity_error"))
