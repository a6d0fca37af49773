"""Exact removal of repeated substrings by a difference-cover, bucketed suffix construction.

A byte goes when a string of `length` bytes that covers it also starts anywhere else. So it matters which suffixes tie
on their first `length` bytes; they are told blockwise, one bucket of suffixes at a time, and never all at once:

1. Texts are packed into files of about `batch` bytes in shared storage, equal texts of a batch once; a narrow
   table finds texts equal across batches, and one copy of each goes on. Texts never shuffle.
2. Cover sample. Positions whose residue modulo v lies in a perfect difference set D of v = q*q + q + 1 residues:
   whatever the alignment of two suffixes, at one shift below v both their positions are sampled. The sample
   (|D| / v of all positions) is sorted to a depth of length - v + 1 bytes, in buckets by leading bytes, and gets its
   ties. Sorting only tells what to look at, so leading bytes and a short fingerprint do for it.
3. Tied sample suffixes alone go on, by the digest of their `depth` bytes, with the v - 1 bytes before and after. A
   bucket of them holds whole classes, and all suffixes that begin up to v - 1 bytes before a class. Two of those that
   begin at the same shift tie if the bytes up to the sampled position agree, the class of the sampled position is the
   same (so a tie of hundreds of bytes costs one comparison), and the bytes after it agree up to `length`. Bytes are
   compared as bytes, by sorting both contexts.
4. Each batch gets for each of its tied sample suffixes the shifts that tie, as bits, and marks what they cover.

A batch sends each key or context once, so a passage that a third of the texts hold is a row a batch, and buckets are
even whatever repeats; their number follows the bytes to be sorted, so that one fits a task. Classes are told by 128-bit
BLAKE2 digests of their bytes.

Beside bytes, passages of words are reported (never removed): the same cover over word positions tells which stretches of
`words` words other documents may hold too, and those are compared by a 64-bit fingerprint of their words.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, packed, parallelism, read_bytes, texts_of, trimmed, word_hashes, write_bytes

_EMPTY = hashlib.sha256(b"").hexdigest()


@functools.lru_cache
def difference_set(q: int) -> tuple[int, np.ndarray]:
    """(v, D): for a prime q, q + 1 residues modulo v = q*q + q + 1 whose differences meet every residue (Singer):
    the exponents of a primitive element of GF(q**3) that lie in a plane."""
    for a, b, c in ((a, b, c) for c in range(1, q) for b in range(q) for a in range(q)):
        state, plane, n = (0, 0, 1), [], 0
        while True:
            if state[0] == 0:
                plane.append(n)
            x2, x1, x0 = state
            state = ((x1 + a * x2) % q, (x0 + b * x2) % q, c * x2 % q)
            n += 1
            if state == (0, 0, 1) or n > q**3:
                break
        if n == q**3 - 1:
            v = q * q + q + 1
            return v, np.array(sorted({p % v for p in plane}))
    raise ValueError(f"{q} is no prime")


def pack(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", batch: int = 2 << 20) -> DataFrame:
    """The texts in files; per file: path, ids (of its documents), places (their texts), sizes and digests of its texts."""
    folder = scratch.folder("texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary()))])
        codec = pa.Codec("zstd")
        for part in packed(batches, "body", batch):
            places, distinct = [], {}
            for t in texts_of(part.column("body")):
                places.append(distinct.setdefault(t, len(distinct)))
            path, data = f"{folder}/texts-{uuid.uuid4().hex}.zst", b"".join(distinct)
            write_bytes(path, codec.compress(data, asbytes=True))
            yield pa.RecordBatch.from_pylist([{"path": path, "ids": part.column("key").to_pylist(), "places": places, "sizes": [len(t) for t in distinct], "digests": [hashlib.sha256(t).digest() for t in distinct]}], kind)

    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    return scratch.store(rows.mapInArrow(trimmed(run), "path string, ids array<bigint>, places array<int>, sizes array<int>, digests array<binary>"), "batches")


def copies(batches: DataFrame, scratch: Scratch) -> DataFrame:
    """batches with `twins`: for each text that other batches hold too, its place and whether it is the one that goes on."""
    texts = batches.select("path", F.posexplode("digests").alias("place", "digest"))
    same = Window.partitionBy("digest")
    told = texts.withColumn("n", F.count(F.lit(1)).over(same)).withColumn("nth", F.row_number().over(same.orderBy("path", "place"))).where("n > 1")
    twins = told.groupBy("path").agg(F.collect_list(F.struct("place", (F.col("nth") == 1).alias("first"))).alias("twins"))
    return scratch.store(batches.drop("digests").join(twins, "path", "left"), "copies")


class Batch:
    """A batch's texts in one buffer, and the positions that matter in those that are searched."""

    def __init__(self, row: dict, length: int, q: int):
        self.length, (self.v, self.cover) = length, difference_set(q)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.sizes)])
        total = int(self.bases[-1])
        self.data = np.frombuffer(pa.Codec("zstd").decompress(read_bytes(row["path"]), total, asbytes=True) if total else b"", np.uint8)
        twins = {t["place"]: t["first"] for t in row["twins"] or []}
        self.whole = np.array([k in twins for k in range(len(self.sizes))], bool)
        self.live = np.array([twins.get(k, True) for k in range(len(self.sizes))], bool) & (self.sizes >= length)
        self.rolling = Rolling(1)
        self.prefix = self.rolling.prefix(self.data)

    @property
    def depth(self) -> int:
        return self.length - self.v + 1

    def sample(self) -> np.ndarray:
        """Cover positions of the searched texts that `depth` bytes follow."""
        most = int(self.sizes.max(initial=0))
        pattern = (np.arange(most // self.v + 1)[:, None] * self.v + self.cover).ravel()
        out = [self.bases[k] + pattern[: np.searchsorted(pattern, self.sizes[k] - self.depth, side="right")] for k in np.flatnonzero(self.live)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """By which sample positions are sorted: two leading bytes, then 32 bits of a fingerprint of `depth` bytes."""
        lead = self.data[at].astype(np.uint64) << np.uint64(56) | self.data[at + 1].astype(np.uint64) << np.uint64(48)
        return lead | self.rolling.windows(self.prefix, at, self.depth) >> np.uint64(32) << np.uint64(16)

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """A row of bytes for each of these sample positions: digest of its `depth` bytes, how many of the v - 1 bytes
        before and after lie in its text, those before (from the nearest on) and those after, padded with zeros."""
        w = self.v - 1
        text = np.searchsorted(self.bases, at, side="right") - 1
        left, right = np.minimum(at - self.bases[text], w), np.minimum(self.bases[text + 1] - at - self.depth, w)
        out = np.zeros((len(at), 18 + 2 * w), np.uint8)
        whole = self.data.tobytes()
        digests = b"".join(hashlib.blake2b(whole[i : i + self.depth], digest_size=16).digest() for i in at.tolist())
        out[:, :16] = np.frombuffer(digests, np.uint8).reshape(-1, 16)
        out[:, 16], out[:, 17] = left, right
        padded = np.concatenate([np.zeros(w, np.uint8), self.data, np.zeros(w, np.uint8)])
        steps = np.arange(w)
        out[:, 18 : 18 + w] = np.where(steps < left[:, None], padded[at[:, None] + w - 1 - steps], 0)
        out[:, 18 + w :] = np.where(steps < right[:, None], padded[at[:, None] + w + self.depth + steps], 0)
        return out


def _masked(masks: list | None, n: int) -> np.ndarray:
    """The bits of an exchange's masks, in the order of the sorted distinct keys."""
    parts = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]) for m in sorted(masks or [], key=lambda m: m["bucket"])]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError("masks do not fit their batch")
    return out


def spread(batches: DataFrame) -> DataFrame:
    """A batch's row is short and its work long: rows are dealt to tasks by number, not by their bytes."""
    return batches.repartition(parallelism(batches.sparkSession))


def bucket_edges(batches: DataFrame, keys: Callable[[dict], np.ndarray], buckets: int, some: int = 16) -> np.ndarray:
    """Keys that split all keys into about even buckets, by those of a few batches. They decide balance alone."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                found = np.sort(keys(row))
                yield pa.RecordBatch.from_arrays([pa.array(found[:: max(1, len(found) // 4096)].view(np.int64))], ["key"])

    least = batches.orderBy(F.xxhash64("path"), "path").limit(some)
    found = np.sort(np.array([r["key"] for r in spread(least).mapInArrow(trimmed(run), "key long").collect()], np.int64).view(np.uint64))
    if not len(found):
        return np.zeros(0, np.uint64)
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets])


def even_edges(buckets: int) -> np.ndarray:
    """The same for keys that are hashes."""
    step = -(-(1 << 64) // buckets)
    return np.array([k * step for k in range(1, buckets)], dtype=np.uint64)


def exchange(batches: DataFrame, keys: Callable[[dict], np.ndarray], name: str, edges: np.ndarray, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(batches with the column `name`, the stored table behind it): which of a batch's distinct keys, sorted, occur again
    in it or in another batch.

    Keys go out once a batch, `width` leading bytes each, to the bucket between two edges; a bucket is sorted in one task."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n", pa.int32()), ("keys", pa.binary()), ("again", pa.binary())])
        for batch in rows:
            for row in batch.to_pylist():
                distinct, n = np.unique(keys(row), return_counts=True)
                cuts = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
                packed_keys = distinct.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
                out = [{"bucket": b, "path": row["path"], "n": hi - lo, "keys": packed_keys[lo:hi].tobytes(), "again": np.packbits(n[lo:hi] > 1).tobytes()} for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield pa.RecordBatch.from_pylist(out, kind)

    def sort(key, table):
        counts = table.column("n").to_numpy()
        flat = np.zeros((int(counts.sum()), 8), np.uint8)
        flat[:, :width] = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, width)
        values = flat.view(">u8").ravel().astype(np.uint64)
        order = np.argsort(values, kind="stable")
        inside = values[order]
        equal = inside[1:] == inside[:-1]
        tied = np.zeros(len(values), bool)
        tied[order[1:][equal]] = True
        tied[order[:-1][equal]] = True
        cuts = np.concatenate([[0], np.cumsum(counts)])
        tied |= np.concatenate([np.unpackbits(np.frombuffer(again, np.uint8), count=n).astype(bool) for n, again in zip(counts, table.column("again").to_pylist())])
        parts = [tied[a:b] for a, b in zip(cuts, cuts[1:])]
        return pa.table({"path": table.column("path"), "bucket": table.column("bucket"), "n": table.column("n"), "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary()), "tied": pa.array([int(x.sum()) for x in parts], pa.int32())})

    sent = spread(batches).mapInArrow(trimmed(send), "bucket int, path string, n int, keys binary, again binary")
    masks = sent.groupBy("bucket").applyInArrow(sort, "path string, bucket int, n int, bits binary, tied int")
    gathered = scratch.store(masks.groupBy("path").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name), F.sum("tied").alias("n_tied")), "masks")
    return batches.join(gathered.drop("n_tied"), "path", "left"), gathered


def tied_shifts(records: np.ndarray, v: int) -> np.ndarray:
    """For distinct context rows (see Batch.contexts), sorted, with whole classes: at which shifts, as bits, the suffix
    that begins there ties with the one of another row."""
    w, n = v - 1, len(records)
    out = np.zeros(n, np.uint64)
    classes = np.ascontiguousarray(records[:, :16]).view("V16").ravel()
    number = np.cumsum(np.concatenate([[False], classes[1:] != classes[:-1]])) if n else np.zeros(0, np.int64)
    many = np.flatnonzero(np.bincount(number)[number] > 1) if n else np.zeros(0, np.int64)
    if not len(many):
        return out
    number, left, right = number[many], records[many, 16], records[many, 17]

    def names(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order by class and context, at how many bytes each row of it parts from the one before)."""
        rows = np.concatenate([number.astype(">u4").view(np.uint8).reshape(-1, 4), context], axis=1)
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{4 + w}").ravel(), kind="stable")
        apart = rows[order][1:] != rows[order][:-1]
        common = np.where(apart.any(axis=1), apart.argmax(axis=1), 4 + w) - 4  # negative: another class
        return order, np.concatenate([[-1], common])

    (by_left, common_left), (by_right, common_right) = names(records[many, 18 : 18 + w]), names(records[many, 18 + w :])
    key_left, key_right = np.empty(len(many), np.int64), np.empty(len(many), np.int64)
    for shift in range(v):
        key_left[by_left] = np.cumsum(common_left < shift)
        key_right[by_right] = np.cumsum(common_right < w - shift)
        whole = np.flatnonzero((left >= shift) & (right >= w - shift))
        key = key_left[whole] * (len(many) + 1) + key_right[whole]
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        again = np.zeros(len(whole), bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        out[many[whole[again]]] |= np.uint64(1 << shift)
    return out


def resolve(batches: DataFrame, records: Callable[[dict], np.ndarray], name: str, edges: np.ndarray, v: int, scratch: Scratch) -> DataFrame:
    """batches with the column `name`: for a batch's distinct context rows, sorted, the shifts that tie, as bits."""
    size = 18 + 2 * (v - 1)

    def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{size}").ravel(), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
        return rows[first], np.diff(np.append(first, len(rows))), order

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n", pa.int32()), ("rows", pa.binary()), ("again", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                found, n, _ = distinct(records(row))
                lead = np.ascontiguousarray(found[:, :8]).view(">u8").ravel().astype(np.uint64)
                cuts = [0, *np.searchsorted(lead, edges).tolist(), len(found)]
                out = [{"bucket": b, "path": row["path"], "n": hi - lo, "rows": found[lo:hi].tobytes(), "again": np.packbits(n[lo:hi] > 1).tobytes()} for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield pa.RecordBatch.from_pylist(out, kind)

    def sort(key, table):
        counts = table.column("n").to_numpy()
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint8).reshape(-1, size)
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for n, x in zip(counts, table.column("again").to_pylist())])
        found, n, order = distinct(rows)
        which = np.empty(len(rows), np.int64)
        which[order] = np.repeat(np.arange(len(found)), n)
        often = n > 1
        often[which[again]] = True
        # Rows that occur more than once tie at every shift that their texts have room for.
        shifts = tied_shifts(found, v)
        left, right = found[often, 16].astype(np.uint64), np.uint64(v - 1) - found[often, 17].astype(np.uint64)
        one = np.uint64(1)
        shifts[often] |= np.where(right <= left, ((one << left) << one) - one & ~((one << right) - one), np.uint64(0))
        cuts = np.concatenate([[0], np.cumsum(counts)])
        bits = [shifts[which[a:b]].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"path": table.column("path"), "bucket": table.column("bucket"), "shifts": pa.array(bits, pa.binary())})

    sent = spread(batches).mapInArrow(trimmed(send), "bucket int, path string, n int, rows binary, again binary")
    found = sent.groupBy("bucket").applyInArrow(sort, "path string, bucket int, shifts binary")
    gathered = scratch.store(found.groupBy("path").agg(F.collect_list(F.struct("bucket", "shifts")).alias(name)), "shifts")
    return batches.join(gathered, "path", "left")


class Words:
    """A batch's words, and fingerprints of stretches of them. Case of A-Z and the kind of white space do not count."""

    def __init__(self, row: dict, words: int, q: int):
        self.words, (self.v, cover) = words, difference_set(q)
        self.covered = np.isin(np.arange(self.v), cover)
        sizes = np.asarray(row["sizes"], np.int64)
        ends = np.cumsum(np.concatenate([[0], sizes])).tolist()
        data = pa.Codec("zstd").decompress(read_bytes(row["path"]), ends[-1], asbytes=True) if ends[-1] else b""
        self.hashes, self.edges = word_hashes([data[a:b] for a, b in zip(ends, ends[1:])], Rolling(2))
        twins = {t["place"]: t["first"] for t in row["twins"] or []}
        n = len(sizes)
        copies = np.bincount(np.asarray(row["places"], np.int64), minlength=n) > 1
        self.whole = np.array([k in twins for k in range(n)], bool) | copies
        self.n = np.diff(self.edges)
        self.live = np.array([twins.get(k, True) for k in range(n)], bool) & (self.n >= words)
        self.rolling = Rolling(4)
        self.rolling._grow(len(self.hashes) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * self.rolling.up[: len(self.hashes)], dtype=np.uint64)])
        self.owner = np.repeat(np.arange(n), self.n)

    def at(self, pattern: bool, length: int) -> np.ndarray:
        """Word positions of the searched texts that `length` words follow; those of the cover only, if `pattern`."""
        out = [np.arange(self.edges[k], self.edges[k + 1] - length + 1) for k in np.flatnonzero(self.live & (self.n >= length))]
        if pattern:
            out = [at[np.resize(self.covered, len(at))] for at in out]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.rolling.windows(self.prefix, at, length)

    def once(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The keys, each once for a text."""
        order = np.argsort(keys, kind="stable")  # positions ascend, and so do texts among equal keys
        keys, owner = keys[order], self.owner[at[order]]
        return keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])] if len(keys) else keys

    @property
    def depth(self) -> int:
        return self.words - self.v + 1


def passages(batches: DataFrame, scratch: Scratch, total: int, words: int, q: int, buckets: Callable[[int], int]) -> tuple[DataFrame, Callable[[dict], np.ndarray]]:
    """(batches, counts): a function that gives for a batch how many words of each text lie in stretches of `words` words
    that another document holds as well."""

    def sampled(row: dict) -> np.ndarray:
        w = Words(row, words, q)
        at = w.at(True, w.depth)
        return w.once(at, w.keys(at, w.depth))

    def near(row: dict) -> tuple[Words, np.ndarray]:
        """The stretches that hold a tied sample stretch, which every stretch that other documents share does."""
        w = Words(row, words, q)
        at = w.at(True, w.depth)
        keys = w.keys(at, w.depth)
        distinct = np.unique(keys)
        tied = at[_masked(row["word_sample"], len(distinct))[np.searchsorted(distinct, keys)]]
        change = np.zeros(len(w.hashes) + 1, np.int32)
        np.add.at(change, np.maximum(tied - w.v + 1, w.edges[w.owner[tied]]), 1)
        np.add.at(change, tied + 1, -1)
        every = w.at(False, words)
        return w, every[np.cumsum(change)[every] > 0]

    def stretches(row: dict) -> np.ndarray:
        w, at = near(row)
        return w.once(at, w.keys(at, words))

    def counts(row: dict) -> np.ndarray:
        w, at = near(row)
        keys = w.keys(at, words)
        distinct = np.unique(keys)
        hits = at[_masked(row["word_tied"], len(distinct))[np.searchsorted(distinct, keys)]]
        change = np.zeros(len(w.hashes) + 1, np.int32)
        change[hits] += 1
        change[hits + words] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        return np.where(w.whole & (w.n >= words), w.n, covered[w.edges[1:]] - covered[w.edges[:-1]])

    # A word has some six bytes; a key of the sample six, one of a stretch eight.
    batches, masks = exchange(batches, sampled, "word_sample", even_edges(buckets(total // 6 * (q + 1) // difference_set(q)[0] * 6)), 6, scratch)
    n_tied = masks.agg(F.sum("n_tied")).first()[0] or 0
    batches, _ = exchange(batches, stretches, "word_tied", even_edges(buckets(n_tied * 64)), 8, scratch)
    return batches, counts


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, q: int = 7, words: int = 50, bucket_bytes: int = 32 << 20) -> tuple[DataFrame, Callable[[dict], Iterator[tuple]]]:
    """(batches, marks): rows of batches, and a function that gives for a batch each of its documents as
    (id, whole text, mask of the bytes to remove, words in passages of `words` words that other documents hold). `bucket_bytes` bounds what a task sorts, but for one key's rows."""
    spark = docs.sparkSession
    v, cover = difference_set(q)
    word_q = max((p for p in (2, 3, 5) if p * p + p + 1 <= words // 2), default=0)
    if length <= v or v > 64 or not word_q:
        raise ValueError("lengths must exceed the covers' periods, and those of bytes 64 bits")
    scratch = Scratch(spark, "substrings")
    packs = pack(docs, scratch, doc_id=doc_id, text=text)
    batches = copies(packs, scratch)
    scratch.drop(packs)

    def sampled(row: dict) -> np.ndarray:
        b = Batch(row, length, q)
        return b.keys(b.sample())

    def tied(row: dict) -> tuple[Batch, np.ndarray]:
        b = Batch(row, length, q)
        at = b.sample()
        distinct, which = np.unique(b.keys(at), return_inverse=True)
        return b, at[_masked(row["sampled"], len(distinct))[which]]

    def records(row: dict) -> np.ndarray:
        b, at = tied(row)
        return b.contexts(at)

    most = lambda size: max(2 * parallelism(spark), -(-size // bucket_bytes))
    total = batches.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    edges = bucket_edges(batches, sampled, most(total * len(cover) // v * 6))
    batches, masks = exchange(batches, sampled, "sampled", edges, 6, scratch)
    n_tied = masks.agg(F.sum("n_tied")).first()[0] or 0
    batches = resolve(batches, records, "shifts", even_edges(most(n_tied * (18 + 2 * v))), v, scratch)

    batches, shared = passages(batches, scratch, total, words, word_q, most)

    def marks(row: dict) -> Iterator[tuple]:
        n_words = shared(row).tolist()
        b, at = tied(row)
        rows = b.contexts(at)
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        changes = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
        parts = [np.frombuffer(m["shifts"], "<u8") for m in sorted(row["shifts"] or [], key=lambda m: m["bucket"])]
        shifts = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if len(shifts) != changes.sum():
            raise ValueError("shifts do not fit their batch")
        shifts, at = shifts[np.cumsum(changes) - 1], at[order]
        begins = np.zeros(len(b.data), bool)
        for shift in range(v):
            begins[at[shifts >> np.uint64(shift) & np.uint64(1) > 0] - shift] = True
        hits = np.flatnonzero(begins)
        change = np.zeros(len(b.data) + 1, np.int32)
        change[hits] += 1
        change[hits + length] -= 1
        covered = np.cumsum(change[:-1]) > 0
        seen = np.bincount(np.asarray(row["places"], np.int64), minlength=len(b.sizes)) > 1
        covered |= np.repeat((seen | b.whole) & (b.sizes >= length), b.sizes)
        for key, k in zip(row["ids"], row["places"]):
            span = slice(b.bases[k], b.bases[k + 1])
            yield key, b.data[span], covered[span], n_words[k]

    return batches, marks


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; and n_repeated_words, the
    words in passages of `words` words (50) that other documents hold as well, which need not be `length` bytes long.

    Null text is empty; matches never cross texts; repeated rows and equal texts remove each other whole from `length`
    bytes on. Shorter texts lose nothing."""
    batches, marks = repeats(docs, **options)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated_words", pa.int64())])
        for batch in rows:
            for row in batch.to_pylist():
                out = []
                for key, data, gone, n_words in marks(row):
                    n = int(gone.sum())
                    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((key, len(data), n, runs, _EMPTY if n == len(data) else hashlib.sha256(data[~gone].tobytes() if n else data.tobytes()).hexdigest(), n_words))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)

    return spread(batches).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")


def brute_force(docs: list[tuple], length: int = 400) -> list[tuple]:
    """What report() returns, from a dictionary of all strings of that length; for tests."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        padded = np.concatenate([[False], gone])
        out.append((d, len(t), int(gone.sum()), int((padded[1:] & ~padded[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_force_passages(docs: list[tuple], words: int = 50) -> list[tuple]:
    """(doc_id, n_repeated_words) by a dictionary of all stretches of that many words; for tests."""
    import re

    lists = [(d, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))) for d, t in docs]
    seen: dict[tuple, set] = {}
    for n, (_, w) in enumerate(lists):
        for i in range(len(w) - words + 1):
            seen.setdefault(tuple(w[i : i + words]), set()).add(n)
    out = []
    for d, w in lists:
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - words + 1):
            if len(seen[tuple(w[i : i + words])]) > 1:
                hit[i : i + words] = True
        out.append((d, int(hit.sum())))
    return out
