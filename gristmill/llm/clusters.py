"""Centroid clustering of integer vectors: rounds of exact k-means, filtered through kd-trees.

Every partition packs its vectors into blocks of at most `block` rows, and each block into one kd-tree, which is built
once and written to shared storage. A node holds its count, its integer sums and its box. In a round a tree meets all
centroids (k of them, sent to each task): level by level, a node's candidate nearest to the middle of its box strikes
out every other candidate that is strictly farther from all of the box; a node with one candidate left is assigned
whole, by its count and sums, and a leaf with more is resolved point by point among them. Tasks emit k rows of sums a
component at most, whatever they read, so nothing is shuffled but sums, and a vector that many rows share costs no
exchange at all. Integers are exact at any size: numpy's 64 bits (products in floats that cannot round) where bounds
allow, else Python's.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed

_LIMB = 40
_ENDS = (-(1 << 63), (1 << 63) - 1)


def as_integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles: int64 where every value is below 2**52, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(256.0 * values)
    if np.abs(scaled).max(initial=0) < 1 << 52:
        return scaled.astype(np.int64)
    whole = lambda x: int(x) * 256 if abs(x) >= 1 << 53 else math.floor(256.0 * x)
    return np.array([whole(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def _largest(*arrays: np.ndarray) -> int:
    return max((int(np.abs(a).max()) for a in arrays if a.size), default=0)


def _fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as int64, if differences, doubled, and their squares summed over a row fit; else as objects."""
    dim = max(a.shape[-1] for a in arrays)
    exact = dim * (4 * _largest(*arrays)) ** 2 < 1 << 62
    return [a.astype(np.int64 if exact else object) for a in arrays]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids, exact."""
    points, centroids = _fitting(points, centroids)
    if points.dtype == object or points.shape[1] * (2 * _largest(points, centroids)) ** 2 >= 1 << 53:
        return ((points[:, None, :] - centroids[None]) ** 2).sum(2)
    a, b = points.astype(float), centroids.astype(float)  # whole numbers below 2**53 throughout
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)


class Tree:
    """A kd-tree over integer points, its nodes in breadth-first order; `order` gives the points' rows."""

    def __init__(self, points: np.ndarray, leaf: int = 24):
        order, nodes, at = np.arange(len(points)), [(0, len(points))], 0
        children: list[tuple[int, int]] = []
        while at < len(nodes):
            first, last = nodes[at]
            own = order[first:last]
            part = points[own]
            spread = part.max(0) - part.min(0)
            axis = int(np.argmax(spread))
            if last - first <= leaf or spread[axis] == 0:
                children.append((-1, -1))
            else:
                order[first:last] = own[np.argsort(part[:, axis], kind="stable")]
                middle = (first + last) // 2
                children.append((len(nodes), len(nodes) + 1))
                nodes += [(first, middle), (middle, last)]
            at += 1
        self.order, self.points = order, points[order]
        self.first, self.last = np.array(nodes).T
        self.left, self.right = np.array(children).T
        self.low, self.high = (np.array([f(self.points[a:b]) for a, b in nodes]) for f in (lambda p: p.min(0), lambda p: p.max(0)))
        total = points if len(points) * _largest(points) < 1 << 62 else points.astype(object)
        self.sums = np.array([total[order[a:b]].sum(0) for a, b in nodes])
        self.counts = self.last - self.first

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Levels of (nodes, assigned centroid or -1, candidates left): nodes with one candidate have a centroid; of
        the others leaves end here, and inner nodes pass their candidates on to their children."""
        low, high, z = _fitting(self.low, self.high, centroids)
        nodes, alive = np.array([0]), np.ones((1, len(z)), dtype=bool)
        while len(nodes):
            lo, hi = low[nodes], high[nodes]
            far = distances(lo + hi, 2 * z)
            # Struck-out candidates never win: a value beyond the largest distance, in the array's own kind.
            best = np.argmin(np.where(alive, far, far.max() + 1), axis=1)
            for at in range(0, len(nodes), 256):
                part = slice(at, at + 256)
                step = z[None] - z[best[part]][:, None]
                corner = np.where(step > 0, hi[part][:, None], lo[part][:, None])
                alive[part] &= ~((step * (z[None] + z[best[part]][:, None] - 2 * corner)).sum(2) > 0)
            one = alive.sum(1) == 1
            yield nodes, np.where(one, best, -1), alive
            on = ~one & (self.left[nodes] >= 0)
            nodes, alive = np.concatenate([self.left[nodes[on]], self.right[nodes[on]]]), np.concatenate([alive[on], alive[on]])

    def _leaf(self, node: int, alive: np.ndarray, centroids: np.ndarray) -> tuple[slice, np.ndarray]:
        """A leaf's rows and the nearest of its candidates for each, ties to the smaller number."""
        rows, left = slice(self.first[node], self.last[node]), np.flatnonzero(alive)
        return rows, left[np.argmin(distances(self.points[rows], centroids[left]), axis=1)]

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the points nearest to each centroid."""
        k, dim = centroids.shape
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=self.sums.dtype)
        for nodes, owner, alive in self.filtered(centroids):
            whole = owner >= 0
            np.add.at(counts, owner[whole], self.counts[nodes[whole]])
            np.add.at(sums, owner[whole], self.sums[nodes[whole]])
            for node, left in zip(nodes[~whole], alive[~whole]):
                if self.left[node] < 0:
                    rows, nearest = self._leaf(node, left, centroids)
                    np.add.at(counts, nearest, 1)
                    np.add.at(sums, nearest, self.points[rows].astype(sums.dtype))
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every point, in the order of `order`."""
        out = np.zeros(len(self.points), dtype=np.int64)
        for nodes, owner, alive in self.filtered(centroids):
            for node, own, left in zip(nodes, owner, alive):
                if own >= 0:
                    out[self.first[node] : self.last[node]] = own
                elif self.left[node] < 0:
                    rows, out[rows] = self._leaf(node, left, centroids)
        points, near = _fitting(self.points, centroids)
        return out, ((points - near[out]) ** 2).sum(1)


def _plant(block: int, leaf: int):
    """Record batches of (vec_id, vector of doubles, all of one length) to one row a tree."""

    def row(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, known, values = (np.concatenate(x) for x in zip(*held))
        tree = Tree(as_integers(values), leaf)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((ids[tree.order], known[tree.order], tree))], pa.binary())], ["tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        for batch in batches:
            ids = batch.column("vec_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            at = 0
            while at < len(ids):
                take = slice(at, at + block - n)
                held.append((ids[take], known[take], values[take]))
                n += len(ids[take])
                at += len(ids[take])
                if n == block:
                    yield row(held)
                    held, n = [], 0
        if held:
            yield row(held)

    return trimmed(run)


def _limbs(value: int) -> list[int]:
    """Digits of an integer to the base 2**_LIMB, the sign on each: their sums over many rows stay within 64 bits."""
    out, rest, sign = [], abs(value), -1 if value < 0 else 1
    while rest:
        out.append(sign * (rest & ((1 << _LIMB) - 1)))
        rest >>= _LIMB
    return out


def _sums(centroids: np.ndarray):
    """Trees to (cluster, place, limb, value): a task's sums of each cluster, its count as place -1."""
    kind = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=object)
        for batch in batches:
            for packed in batch.column("tree"):
                counts, own = pickle.loads(packed.as_py())[2].totals(centroids)
                sums[:, 0] += counts
                sums[:, 1:] += own
        found = [(c, place - 1, limb, value) for c, row in enumerate(sums) for place, total in enumerate(row) for limb, value in enumerate(_limbs(int(total)))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kind.types)], schema=kind)

    return run


def _assign(centroids: np.ndarray):
    kind = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("limbs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("tree"):
                ids, known, tree = pickle.loads(packed.as_py())
                cluster, distance = tree.assigned(centroids)
                shown = np.array([min(x, _ENDS[1]) for x in distance.tolist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known), pa.array(cluster.astype(np.int32)), pa.array(shown), pa.array([_limbs(x) for x in distance.tolist()], kind.field("limbs").type)], schema=kind)

    return trimmed(run)


def _valued(rows) -> int:
    return sum(r["value"] << (_LIMB * r["limb"]) for r in rows)


def seeds(usable: DataFrame, k: int, salt: int) -> np.ndarray:
    """The vectors of the k rows with the smallest hex SHA-256 of `salt:vec_id`, in that order."""
    named = usable.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("h", "vector").limit(k).collect()
    return as_integers(np.array([r["vector"] for r in rows], dtype=float)) if rows else np.zeros((0, 0), dtype=np.int64)


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, salt: int = 2, block: int = 8192, leaf: int = 24) -> tuple[DataFrame, list[dict]]:
    """Rows of `vectors` (vec_id, embedding) with their cluster and squared distance, and the final centroids.

    A component x counts as the integer floor(256 * x). The first value is a stored table (vec_id, cluster, distance);
    the second holds per non-empty cluster its number, count, inertia (exact) and centroid. Ties go to the smaller
    number; a centroid without vectors stays as it was.

    Vectors that are null, not of `dim` components, or hold a null or non-finite one take no part. Rows that repeat a
    vec_id or a vector are rows of their own; a row without a vec_id gives no first centroid but is assigned. With
    fewer than k rows that have an id there are fewer centroids; without any, or in an empty table, no rows come out.
    A distance beyond 64 bits is compared by its true value and shown as the largest long."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = usable.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    centroids = seeds(usable, k, salt)
    scratch = Scratch(spark, "clusters")
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    trees = scratch.store(usable.mapInArrow(_plant(block, leaf), "tree binary"), "trees")
    for _ in range(rounds):
        summed = trees.mapInArrow(trimmed(_sums(centroids)), "cluster int, place int, limb int, value long").groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect()
        by: dict[int, dict[int, list]] = {}
        for r in summed:  # a row a component and centroid
            by.setdefault(r["cluster"], {}).setdefault(r["place"], []).append(r)
        moved = centroids.astype(object)
        for c, places in by.items():
            n = _valued(places[-1])
            moved[c] = [_valued(places.get(i, [])) // n for i in range(dim)]
        centroids = moved if _largest(moved) >= 1 << 52 else moved.astype(np.int64)
    assigned = scratch.store(trees.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long, limbs array<long>"), "assigned")
    scratch.drop(trees)
    digits = assigned.select("cluster", F.posexplode_outer("limbs").alias("limb", "value"))
    found: dict[int, list] = {}
    for r in digits.groupBy("cluster", F.coalesce("limb", F.lit(0)).alias("limb")).agg(F.sum(F.coalesce("value", F.lit(0))).alias("value")).collect():
        found.setdefault(r["cluster"], []).append(r)
    sizes = {r["cluster"]: r["count"] for r in assigned.groupBy("cluster").count().collect()}
    return assigned.drop("limbs"), [{"cluster": c, "count": sizes[c], "inertia": _valued(rows), "centroid": [int(x) for x in centroids[c]]} for c, rows in sorted(found.items())]


def report(vectors: DataFrame, **options) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; see `cluster`.
    Inertia beyond 64 bits is shown as the largest long."""
    rows, clusters = cluster(vectors, **options)
    total = sum(c["inertia"] for c in clusters)
    digest = lambda c: hashlib.sha256(",".join(map(str, c["centroid"])).encode()).hexdigest()
    told = [(c["cluster"], min(c["inertia"], _ENDS[1]), min(total, _ENDS[1]), digest(c)) for c in clusters]
    by = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle_sql(k: int = 40, rounds: int = 5, dim: int = 64, salt: int = 2) -> str:
    """The same rounds, each a pair of common tables, for engines with list functions."""
    nearest = """
n{r} as (
  select row_id, vec_id, x, list_min(list_transform(cs, lambda c: struct_pack(d := list_sum(list_transform(list_zip(x, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c))) as b
  from v, (select list(struct_pack(c := c, m := m)) as cs from c{r})
)"""
    moved = """
c{s} as (
  select c.c, coalesce(m.m, c.m) as m from c{r} c left join (
    select c, list(m order by place) as m from (
      select b.c as c, place, cast(floor(sum(x[place]) / count(*)) as bigint) as m
      from n{r}, generate_series(1, {dim}) as g(place) group by b.c, place) group by c) m using (c)
)"""
    parts = [f"""
v as (
  select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""", f"""
c0 as (
  select row_number() over (order by h, x) - 1 as c, x as m from (select x, sha256('{salt}:' || cast(vec_id as varchar)) as h from v where vec_id is not null)
  order by h, x limit {k}
)"""]
    for r in range(rounds):
        parts += [nearest.format(r=r), moved.format(r=r, s=r + 1, dim=dim)]
    return f"""with {",".join(parts + [nearest.format(r=rounds)])}
select n.vec_id, cast(n.b.c as integer) as cluster, cast(n.b.d as bigint) as distance,
  cast(sum(n.b.d) over (partition by n.b.c) as bigint) as cluster_inertia, cast(sum(n.b.d) over () as bigint) as inertia,
  sha256(array_to_string(c.m, ',')) as centroid_sha256
from n{rounds} n join c{rounds} c on c.c = n.b.c
"""
