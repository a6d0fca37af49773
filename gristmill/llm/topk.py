"""Exact top-k by inner product: tiled matrix products, partial selection per tile, tree merging.

Vectors are packed into tiles, one row a tile, of at most `tile` vectors; a product takes their integers
floor(256 * x). Query tiles meet candidate tiles by an equi-join on strips: every query tile goes to each strip,
every candidate tile to its own, so the stated query set meets all rows in blocks and no pair of rows is ever a row
of a plan. Tiles are dealt to strips in turn, and there are no more strips than tiles. A tile pair yields k rows a
query at most; lists merge within a task, then within a strip, then over strips.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stored

_EXACT = float(1 << 53)


def _pack(tile: int, every: int):
    """Record batches of (vec_id, embedding) to tiles: candidates whole, and beside them the queries among them."""
    kind = pa.schema([("uid", pa.string()), ("turn", pa.int32()), ("dim", pa.int32()), ("query", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("home", pa.string()), ("vectors", pa.binary())])

    def rows(ids: np.ndarray, vectors: np.ndarray, turn: int) -> Iterator[dict]:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        home = uuid.uuid4().hex
        where = np.flatnonzero(ids % every == 0)
        for query, at in ((False, np.arange(len(ids))), (True, where)):
            if len(at):
                yield {"uid": f"{home}-{int(query)}", "turn": turn, "dim": vectors.shape[1], "query": query, "n": len(at), "ids": ids[at].astype("<i8").tobytes(), "places": at.astype("<i4").tobytes(), "home": home, "vectors": vectors[at].astype("<f8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        turns = count(TaskContext.get().partitionId())

        def flush(dim: int, all_of_it: bool = False) -> Iterator[pa.RecordBatch]:
            while held[dim] and (all_of_it or sum(len(i) for i, _ in held[dim]) >= tile):
                ids, vectors = (np.concatenate(x) for x in zip(*held[dim]))
                held[dim] = [(ids[tile:], vectors[tile:])] if len(ids) > tile else []
                yield pa.RecordBatch.from_pylist(list(rows(ids[:tile], vectors[:tile], next(turns))), kind)

        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id").to_numpy(zero_copy_only=False)
            starts, values = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False).astype("f8")
            lengths = np.diff(starts)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole = bad[starts[1:]] == bad[starts[:-1]]
            for dim in np.unique(lengths[whole]):
                at = np.flatnonzero(whole & (lengths == dim))
                held.setdefault(int(dim), []).append((ids[at].astype("i8"), values[starts[at][:, None] + np.arange(dim)]))
                yield from flush(int(dim))
        for dim in held:
            yield from flush(dim, True)

    return run


def _product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of floor(256 * x): as int64 by floats where no sum can round, else as Python integers."""
    with np.errstate(over="ignore"):
        a, b = np.floor(256.0 * queries), np.floor(256.0 * vectors)
        bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * queries.shape[1]
    if bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    # 256 * x may leave the floats' range; x is a whole number long before it does.
    as_int = lambda m: np.array([[int(x) * 256 if abs(x) > 1 << 53 else math.floor(256.0 * x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return as_int(queries) @ as_int(vectors).T


def _beyond(score: int) -> bytes:
    """A key by which scores outside 64 bits sort among those held at the same end; empty for others."""
    if -(1 << 63) <= score < 1 << 63:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(8, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else bytes(255 - x for x in key)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to the earlier column."""
    m = scores.shape[1]
    k = min(k, m)
    if m and scores.dtype != object and np.abs(scores).max(initial=0) < (1 << 62) // m:
        key = scores * m - np.arange(m)
        part = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < m else np.broadcast_to(np.arange(m), scores.shape)
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(key, part, 1), axis=1), 1)
    return np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]


def _search(k: int):
    kind = pa.schema([("query_uid", pa.string()), ("query_place", pa.int32()), ("query_id", pa.int64()), ("strip", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, c = (np.frombuffer(r[f"{s}_vectors"], "<f8").reshape(r[f"{s}_n"], r["dim"]) for s in "qc")
                q_ids, c_ids, places = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8"), np.frombuffer(r["q_places"], "<i4")
                for at in range(0, len(q), 256):
                    scores = _product(q[at : at + 256], c)
                    own = places[at : at + 256] if r["q_home"] == r["c_home"] else None
                    best = _best(scores, k + 1 if own is not None else k)
                    rows, cols = np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()
                    if own is not None:
                        other = cols != own[rows]
                        rows, cols = rows[other], cols[other]
                        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                        rows, cols = rows[rank < k], cols[rank < k]
                    found = scores[rows, cols]
                    beyond = [_beyond(x) for x in found] if found.dtype == object else [b""] * len(found)
                    if found.dtype == object:
                        found = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in found], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([r["q_uid"]] * len(rows)), pa.array((rows + at).astype(np.int32)), pa.array(q_ids[at : at + 256][rows]), pa.array(np.full(len(rows), r["strip"], np.int32)), pa.array(c_ids[cols]), pa.array(found), pa.array(beyond, pa.binary())], schema=kind)

    return run


def search(vectors: DataFrame, *, k: int = 5, every: int = 50, tile: int = 4096, strips: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows but its own, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`. Rows without a vec_id, null vectors and vectors with
    a null or non-finite component take no part; vectors of different lengths are not compared, and empty ones score 0
    with each other. A score outside 64 bits is ranked by its true value and shown as the end of the range that it
    passes. Rows that repeat a vec_id are rows of their own, as queries and as candidates. An empty table gives no rows."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    tiles = stored(usable.mapInArrow(_pack(tile, every), "uid string, turn int, dim int, query boolean, n int, ids binary, places binary, home string, vectors binary"), "topk-tiles")
    strips = strips or max(1, min(parallelism(spark), tiles.where("not query").count()))
    c = tiles.where("not query").select("dim", *(F.col(x).alias(f"c_{x}") for x in ("n", "ids", "home", "vectors")), F.pmod("turn", F.lit(strips)).cast("int").alias("strip"))
    q = tiles.where("query").select("dim", *(F.col(x).alias(f"q_{x}") for x in ("uid", "n", "ids", "places", "home", "vectors")), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    lists = q.join(c, ["dim", "strip"]).mapInArrow(_search(k), "query_uid string, query_place int, query_id long, strip int, vec_id long, score long, beyond binary")
    best = [F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id")]
    by_strip = Window.partitionBy("query_uid", "query_place", "strip").orderBy(*best)
    over_all = Window.partitionBy("query_uid", "query_place").orderBy(*best)
    merged = lists.withColumn("r", F.row_number().over(by_strip)).where(F.col("r") <= k).drop("r", "strip")
    return merged.withColumn("rank", F.row_number().over(over_all)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same search of one table, for engines with list functions.
ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""
