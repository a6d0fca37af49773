"""Document fingerprints: a randomised edit embedding, sampled, banded and verified.

Texts walk over their characters by shared random bits: at output step j the walk shows its character c and goes on to
the next one where bit (j, c) is set. Texts that differ by few edits fall into step again soon after each edit, so edit
distance becomes Hamming distance of what is shown (Chakraborty, Goldenberg and Koucky 2016). The walk is run by
arrival times: a character that is reached at step j stays until its next set bit, so each costs one step of arithmetic.

A fingerprint samples what was shown. Level l has one sample in each run of 2**l output steps, one of the two that level
l - 1 has there, so that samples of different levels can be compared at the coarser one. A text takes the least level
with at most SAMPLES of them. Written, a walk is `level:samples` with a letter of 64 a sample, and walks are joined by
dots. The likeness of two fingerprints is the share of samples that agree, of those that either has, in the better of
their walks.

Near copies (`near_copies`): texts meet where a band, a fixed choice of samples, is the same, and a link is verified by
the exact edit distance of whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, mixed, packed, trimmed
from .components import components

WALKS, SAMPLES = 2, 128
_PERIOD = 1024
_LETTERS = np.frombuffer(b"-+0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)


@lru_cache(maxsize=None)
def _stays() -> np.ndarray:
    """Steps until a character's next set bit, by walk, output step (modulo a period) and character class."""
    bits = np.random.default_rng(1105).integers(0, 2, (WALKS, _PERIOD, 256), dtype=np.uint8)
    bits[:, -1] = 1
    out = np.ones((WALKS, _PERIOD, 256), dtype=np.uint8)
    for j in range(_PERIOD - 2, -1, -1):
        out[:, j] = np.where(bits[:, j] == 1, 1, np.minimum(out[:, j + 1], 254) + 1)
    return out


@lru_cache(maxsize=None)
def _shown() -> np.ndarray:
    """The sample (1 to 64) that a character class shows."""
    return np.random.default_rng(1106).permutation(np.arange(256) % 64).astype(np.uint8) + 1


def classes(text: str) -> np.ndarray:
    """A class from 0 to 255 of every character: Latin letters are told apart, others nearly always."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return ((points + (points >> 8) * 131) & 255).astype(np.uint8)


@lru_cache(maxsize=4096)
def _places(level: int, to: int) -> np.ndarray:
    """Which samples of level `to` are the first SAMPLES of the coarser `level`; of level 0: their output steps."""
    at = np.arange(SAMPLES, dtype=np.uint64)
    for t in range(level, to, -1):
        at = 2 * at + (mixed(at * np.uint64(64) + np.uint64(t)) & np.uint64(1))
    return at.astype(np.int64)


class Walks:
    """The walks of several texts' character classes, one behind another in `data` (the i-th from edges[i] on): for how
    many steps each character is shown, and when each walk began and ended."""

    #: So many walks at once are stepped by numpy; fewer, the tails of the longest texts, one by one.
    FEW, CHUNK = 50, 64

    def __init__(self, data: np.ndarray, edges: np.ndarray, began: np.ndarray | None = None):
        self.data, self.edges = data, edges
        sizes = np.diff(edges)
        self.began = np.zeros((WALKS, len(sizes)), dtype=np.int64) if began is None else began
        self.stays = np.zeros((WALKS, len(data) + 1), dtype=np.uint8)
        order = np.argsort(-sizes, kind="stable")
        #: A walk's row in the table of stays: its step modulo the period, shifted to leave room for a character.
        at = ((self.began[:, order] % _PERIOD) << 8).astype(np.int32) + (np.arange(WALKS, dtype=np.int32)[:, None] * (_PERIOD << 8))
        table, wrap, step = _stays().reshape(-1), np.int32((_PERIOD << 8) - 1), 0
        home = at & ~wrap
        ends = -sizes[order]
        while (m := int(np.searchsorted(ends, -step, side="left"))) * WALKS >= self.FEW:
            places = edges[order[:m]] + np.arange(step, step + self.CHUNK)[:, None]
            inside = places < edges[order[:m] + 1]
            seen, shown = data[np.where(inside, places, 0)].astype(np.int32), np.empty((self.CHUNK, WALKS, m), dtype=np.uint8)
            own, own_home = np.ascontiguousarray(at[:, :m]), home[:, :m]
            for i in range(self.CHUNK):
                stay = table.take(own | seen[i])
                shown[i] = stay
                own += stay.astype(np.int32) << 8
                own &= wrap
                own |= own_home
            at[:, :m] = own
            for w in range(WALKS):
                self.stays[w, places[inside]] = shown[:, w][inside]
            step += self.CHUNK
        for i in range(m):
            for w in range(WALKS):
                self._alone(w, edges[order[i]] + step, edges[order[i] + 1], int(at[w, i] & wrap))
        #: Steps before each character, over all texts.
        self.steps = np.cumsum(np.roll(self.stays, 1, axis=1), axis=1, dtype=np.int32 if len(data) < 1 << 23 else np.int64)
        del self.stays
        self.ends = self.began + np.diff(self.steps[:, edges], axis=1)

    def _alone(self, w: int, first: int, last: int, at: int) -> None:
        table, wrap = _stays()[w].tobytes(), (_PERIOD << 8) - 1
        for a in range(first, last, 1 << 16):
            out = bytearray()
            for c in self.data[a : min(a + (1 << 16), last)].tobytes():
                stay = table[at | c]
                out.append(stay)
                at = (at + (stay << 8)) & wrap
            self.stays[w, a : a + len(out)] = np.frombuffer(out, dtype=np.uint8)

    def times_at(self, place: np.ndarray) -> np.ndarray:
        """When the walks of each of the first texts reach its `place`-th character, or end."""
        at = np.minimum(self.edges[: len(place)] + place, self.edges[1 : len(place) + 1])
        return self.began[:, : len(place)] + self.steps[:, at] - self.steps[:, self.edges[: len(place)]]

    def shown_at(self, w: int, text: np.ndarray, step: np.ndarray) -> np.ndarray:
        """What walk w of each `text` shows at a step after its beginning and before its end."""
        steps = self.steps[w]
        sought = steps[self.edges[text]] + step - self.began[w][text]
        return _shown()[self.data[np.searchsorted(steps, sought.astype(steps.dtype), side="right") - 1]]


def levels(ends: np.ndarray) -> np.ndarray:
    """The least level with at most SAMPLES samples before each end."""
    return np.maximum(np.ceil(np.log2(np.maximum(ends, 1) / SAMPLES)), 0).astype(np.int64)


def sample(parts: list[tuple[Walks, np.ndarray, np.ndarray]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels, samples) of texts by walk. A text is made of parts (walks, number of the text there, step until which the
    part is shown), in turn; `ends` tells when its walks end. Samples are 1 to 64, and 0 beyond the end."""
    n = ends.shape[1]
    level, out = levels(ends), np.zeros((WALKS, n, SAMPLES), dtype=np.uint8)
    for w in range(WALKS):
        steps = np.stack([_places(x, 0) for x in range(level[w].max(initial=0) + 1)])[level[w]]
        rows, columns = np.nonzero(steps < ends[w][:, None])
        s = steps[rows, columns]
        left = np.ones(len(s), dtype=bool)
        for walks, text, until in parts:
            here = left & (s < until[w][rows])
            left &= ~here
            out[w][rows[here], columns[here]] = walks.shown_at(w, text[rows[here]], s[here])
    return level, out


def written(level: np.ndarray, samples: np.ndarray) -> list[str]:
    sizes = (samples > 0).sum(2)
    letters = _LETTERS[samples]
    walk = lambda w, i: f"{level[w, i]}:{letters[w, i, : sizes[w, i]].tobytes().decode()}"
    return [".".join(walk(w, i) for w in range(WALKS)) for i in range(samples.shape[1])]


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(levels, samples) of written fingerprints."""
    back = np.zeros(256, dtype=np.uint8)
    back[_LETTERS] = np.arange(65)
    level, samples = np.zeros((WALKS, len(fingerprints)), dtype=np.int64), np.zeros((WALKS, len(fingerprints), SAMPLES), dtype=np.uint8)
    for i, text in enumerate(fingerprints):
        for w, part in enumerate(text.split(".")):
            l, _, letters = part.partition(":")
            level[w, i] = int(l)
            samples[w, i, : len(letters)] = back[np.frombuffer(letters.encode(), dtype=np.uint8)]
    return level, samples


def coarser(level: np.ndarray, samples: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Samples of one walk at the levels `to`, none finer than their own."""
    out = samples.copy()
    for a, b in {(a, b) for a, b in zip(level.tolist(), to.tolist()) if a < b}:
        rows = np.flatnonzero((level == a) & (to == b))
        places = _places(b, a)
        have = places < SAMPLES
        out[rows] = 0
        out[np.ix_(rows, np.flatnonzero(have))] = samples[np.ix_(rows, places[have])]
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """From 0 to 1, by row of two arrays of fingerprints; two empty texts are alike."""
    best = np.zeros(a[0].shape[1])
    for w in range(WALKS):
        to = np.maximum(a[0][w], b[0][w])
        x, y = coarser(a[0][w], a[1][w], to), coarser(b[0][w], b[1][w], to)
        either, same = ((x > 0) | (y > 0)).sum(1), ((x == y) & (x > 0)).sum(1)
        best = np.maximum(best, np.where(either == 0, 1.0, same / np.maximum(either, 1)))
    return best


def _walked(texts: list[str], began: np.ndarray | None = None) -> Walks:
    data = [classes(t) for t in texts]
    return Walks(np.concatenate(data) if data else np.zeros(0, np.uint8), np.cumsum([0, *map(len, data)]), began)


def fingerprinted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    walks = _walked(texts)
    return sample([(walks, np.arange(len(texts)), walks.ends)], walks.ends)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_SPARK = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], follow: list[int], n: int) -> pa.RecordBatch:
    """Results of the first n texts, each beside the text with the number that `follow` gives."""
    walks = _walked(texts)
    cuts = [len(t) // 3 for t in texts[:n]]
    keep = np.array([len(t) - c for t, c in zip(texts, cuts)], dtype=np.int64)
    heads = [texts[f][:c] for f, c in zip(follow, cuts)]
    own = np.arange(n)
    until = walks.times_at(keep)
    tails = _walked(heads, until)
    whole = sample([(walks, np.arange(len(texts)), walks.ends)], walks.ends)
    edited = sample([(walks, own, until), (tails, own, tails.ends)], tails.ends)
    first, other = tuple(x[:, :n] for x in whole), tuple(x[:, follow] for x in whole)
    digests = [hashlib.sha256((t[:k] + h).encode()).hexdigest() for t, k, h in zip(texts, keep.tolist(), heads)]
    columns = [ids[:n], [len(t) for t in texts[:n]], digests, written(*first), written(*edited), likeness(first, edited), likeness(first, other)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULT.types)], schema=_RESULT)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text) of one partition: each beside the next one. The first row is given as well, as `head`,
    and the last, whose follower is elsewhere, as `open`."""
    edge = pa.schema([("at", pa.int32()), ("role", pa.string()), ("text", pa.string())])
    shape = pa.schema([*_RESULT, *edge])
    at = TaskContext.get().partitionId()

    def row(doc_id, text: str, role: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.nulls(1, f.type) for f in list(_RESULT)[1:]), pa.array([at], pa.int32()), pa.array([role]), pa.array([text])], schema=shape)

    held: list = []
    for part in packed(batches, "text", 8 << 20):
        rows = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()))
        if not held:
            yield row(*rows[0], "head")
        rows = held + rows
        held = rows[-1:]
        if len(rows) > 1:
            ids, texts = map(list, zip(*rows))
            out = compared(ids, texts, list(range(1, len(rows))), len(rows) - 1)
            yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(out.num_rows, f.type) for f in edge)], schema=shape)
    if held:
        yield row(*held[0], "open")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield compared([r["doc_id"]], [r["text"], r["head"]], [1], 1)


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) characters replaced by as many first ones of the next document in
    falling order of doc_id (null ids come last, and the first document follows the last; rows that repeat an id stand in
    the order of their texts' hashes, then of the table). A null text is empty. An empty text's fingerprint has no
    samples and is like that of another empty text alone. An only row follows itself; an empty table gives no rows.

    Texts travel once, in a range exchange whose keys no two rows share, so that no id or text makes a large partition.
    Of each partition the first and the last row are joined to their neighbours afterwards."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.orderBy(F.col("doc_id").desc_nulls_last(), "h", "place").select("doc_id", "text")
    done = scratch.store(ordered.mapInArrow(trimmed(_in_order), f"{_SPARK}, at int, role string, text string"), "done")
    parts = sorted(r["at"] for r in done.where("role = 'head'").select("at").collect())  # a number a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "at int, then int")
    heads = done.where("role = 'head'").select(F.col("at").alias("then"), F.col("text").alias("head"))
    last = done.where("role = 'open'").select("doc_id", "text", "at").join(F.broadcast(after), "at").join(heads, "then")
    return done.where("role is null").select(*_RESULT.names).unionByName(last.select("doc_id", "text", "head").mapInArrow(trimmed(_open), _SPARK))


_SEEDS = np.random.default_rng(1107)
#: Samples that each band reads, of those that a level has.
_BANDS = np.stack([np.sort(_SEEDS.permutation(SAMPLES // 2)[:8]) for _ in range(8)])


def bands(level: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every band of fingerprints, at their own level and the next, as a near copy's may be coarser."""
    texts, keys, n = [], [], samples.shape[1]
    for w in range(WALKS):
        for up in (0, 1):
            own = coarser(level[w], samples[w], level[w] + up).astype(np.uint64)
            for b, columns in enumerate(_BANDS):
                salt = np.uint64((w * len(_BANDS) + b) << 8)
                key = mixed((level[w] + up).astype(np.uint64) + salt + np.uint64(1))
                for c in columns:
                    key = mixed(key ^ own[:, c])
                texts.append(np.arange(n))
                keys.append(key.view(np.int64))
    return np.concatenate(texts), np.concatenate(keys)


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Insertions, deletions and changes of a character that make a of b; None if more than `most`. Furthest reaching
    points by diagonal (Landau and Vishkin), whose runs of equal characters are found by hashes of 64 bits."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) for t in (a, b))
    rolling = Rolling()
    rolling._grow(max(len(x), len(y)) + 1)
    prefix = lambda v: np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(v + np.uint64(1)) * rolling.up[: len(v)])])
    px, py, goal = prefix(x), prefix(y), len(y) - len(x)

    def slid(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), np.minimum(len(x) - i, len(y) - i - d)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = rolling.windows(px, i, mid) == rolling.windows(py, i + d, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return i + low

    if abs(goal) > most:
        return None
    reach = slid(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for e in range(most + 1):
        if abs(goal) <= e and reach[goal + e] >= len(x):
            return e
        d = np.arange(-e - 1, e + 2)
        low = np.full(1, -(1 << 40))
        changed, added, dropped = (np.concatenate(parts) for parts in ((low, reach + 1, low), (low, low, reach), (reach + 1, low, low)))
        i = np.minimum(np.maximum(np.maximum(changed, added), dropped), np.minimum(len(x), len(y) - d))
        valid = (i >= 0) & (i + d >= 0)
        reach = np.where(valid, slid(np.where(valid, i, 0), np.where(valid, d, 0)), -(1 << 40))
    return None


def allowed(a: str, b: str, edits: int, share: float) -> int:
    return min(edits, int(share * max(len(a), len(b))))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in packed(batches, "text", 8 << 20):
        texts, keys = bands(*fingerprinted(part.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([part.column("class").combine_chunks().take(pa.array(texts)), pa.array(keys)], ["class", "key"])


def _verified(edits: int, share: float):
    """Groups of rows (pivot, salt, class, text), each led by the pivot's own (class null): linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ""
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["class"] is None:
                    own = r["text"]
                elif edit_distance(own, r["text"], allowed(own, r["text"], edits, share)) is not None:
                    found.append((r["pivot"], r["class"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], ["a", "b"])

    return run


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edits: int = 64, share: float = 0.2, pivots: int = 16, room: int = 64) -> DataFrame:
    """Per row of `docs`: doc_id and component_id, the smallest doc_id of the texts linked to its own, directly or not.

    Texts that share a band are linked when their edit distance is at most `edits` and `share` of the longer one's
    length. Links are those of all pairs in a band: a band's first text, the pivot, is verified against all others of
    the band; where that leaves texts of several components, up to `pivots` further ones are, until none is left. No
    pair is verified twice by the same pivot, none within a component, and no task holds more than one text beside
    those that it reads; a pivot of many is dealt in groups of about `room`.

    Equal texts are one class and always together. A null text is empty; rows may repeat ids; a null id is never a
    component's smallest, unless all are null. An empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("class"), "text")
    texts = scratch.store(rows.groupBy("class").agg(F.first("text").alias("text")), "texts")
    members = scratch.store(texts.mapInArrow(trimmed(_banded), "class string, key long").distinct(), "members")
    edges, labels, limit = None, None, 1
    while True:
        if labels is None:
            open_ = members.withColumn("label", F.col("class"))
        else:
            open_ = members.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        impure = open_.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        open_ = scratch.store(open_.join(impure, "key", "left_semi"), "open")
        if open_.isEmpty():
            break
        first = open_.groupBy("key").agg(F.min("class").alias("pivot")) if limit == 1 else None
        if first is None:  # the least classes of each band, pre-selected within each task
            kept = open_.withColumn("task", F.spark_partition_id())
            for by in (["key", "task"], ["key"]):
                kept = kept.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("class"))).where(F.col("r") <= limit)
            first = kept.select("key", F.col("class").alias("pivot"))
        first = scratch.store(first, "pivots")
        ours = first.join(open_.select("key", F.col("class").alias("pivot"), F.col("label").alias("p")), ["key", "pivot"])
        pairs = scratch.store(open_.join(ours, "key").where("class <> pivot and label <> p").select("pivot", "class").distinct(), "pairs")
        groups = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / room).alias("groups"))
        dealt = pairs.join(groups, "pivot").select("pivot", "class", F.pmod(F.xxhash64("class"), "groups").alias("salt"))
        others = dealt.join(texts, "class").select("pivot", "salt", "class", "text")
        own = dealt.select("pivot", "salt").distinct().join(texts.withColumnRenamed("class", "pivot"), "pivot").select("pivot", "salt", F.lit(None).cast("string").alias("class"), "text")
        led = own.unionByName(others).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "class")
        found = led.mapInArrow(trimmed(_verified(edits, share)), "a string, b string")
        more = scratch.store(found if edges is None else edges.unionByName(found), "links")
        members = scratch.store(open_.select("class", "key").join(first.withColumnRenamed("pivot", "class"), ["key", "class"], "left_anti").select("class", "key"), "members")
        edges, labels, limit = more, components(more, scratch), pivots
    named = rows.select("doc_id", "class")
    if labels is not None:
        named = named.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("class", F.coalesce("label", "class"))
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "class").select("doc_id", "component_id")
