"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, with exact verification.

A text's set holds its distinct shingles of `words` words. Sets fall into size bands; a band deals shingles by
hash to m segments. Sets as similar as asked differ in at most U shingles, so if a set's segments carry values
that sum to U + 1 (1: the segment itself is a signature; 2: also what is left of it without any one shingle),
some segment of the partner agrees within its value. `allocation` picks m and the number of segments with
deletion neighbourhoods at the least expected number of signatures; a set takes 0 from its empty segments. A set
probes its own band and the lower bands that partners may be in. The rare set whose values fall short is
compared with all sets in blocks instead.

Copies: equal sets are one class, equal texts of a batch are read once, and one batch sends a class's signatures.
Signatures that occur once in the corpus are told by the masked exchange of the substring operator and go no
further. Candidates are first the pairs of each set with the least set of a signature; parity sketches (whose
distance never exceeds the true difference) prune them and exact comparison follows. After contraction, only
signatures that still hold several components are compared across components, in tiles of bounded size, once: a tile
that leaves few pairs open gives them all, and its signature is done; one that leaves many gives each member's nearest,
and only such signatures are looked at again after the next contraction. So a large cluster costs its members, not its
pairs, and no link between components is missed.

Tables in shared storage go as soon as what was made from them is committed.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, mixed, parallelism, read_bytes, trimmed, word_hashes
from .components import components
from .substrings import _masked, even_edges, exchange, pack, spread

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_SKETCH, _TOKEN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
TILE = 512
#: A signature's members are dealt into so many parts at most: larger groups have larger tiles, and a member is in no more.
PARTS = 16
#: Signatures of a member that tell where else a pair meets: the least ones.
LEAST = 16
#: A tile is done at once when it leaves no more pairs open than so many times its rows.
OPEN = 8
#: Shingles of a block of sets that are compared with all sets.
BLOCK = 1 << 20
#: Bytes of signatures that a task sorts at once, about.
BUCKET = 32 << 20


def overlap(n, s, percent: int):
    """The least intersection of linked sets of sizes n and s."""
    return -(-percent * (n + s) // (100 + percent))


def difference(n: int, low: int, high: int, percent: int) -> int:
    """The most shingles in which a set of size n differs from a linked one of a size from low to high; -1 if none can be."""
    low = max(low, -(-percent * n // 100))
    found = [n + s - 2 * overlap(n, s, percent) for s in range(max(low, high - 9), high + 1) if overlap(n, s, percent) <= min(n, s)]
    return max(found, default=-1)


@functools.lru_cache(maxsize=None)
def band(k: int) -> tuple[int, int]:
    """The sizes of band k: from, up to (exclusive)."""
    low = 1 if k == 0 else band(k - 1)[1]
    return low, max(low + 1, int(low * 1.4))


@functools.lru_cache(maxsize=None)
def band_of(n: int) -> int:
    k = 0
    while band(k)[1] <= n:
        k += 1
    return k


@functools.lru_cache(maxsize=None)
def allocation(k: int, percent: int) -> tuple[int, int]:
    """(m, d) of band k: segments, and how many of them (the first) get one-deletion neighbourhoods. The least expected
    number of signatures whose value meets the demand at every size that uses the band, by five standard deviations."""
    low, high = band(k)
    most = (high - 1) * 100 // percent
    demands = [(n, difference(n, low, min(n, high - 1), percent) + 1) for n in sorted({low, (low + high) // 2, high - 1, high, most}) if n >= low]
    best = None
    for m in sorted({max(1, round(max(d for _, d in demands) * x)) for x in np.arange(0.55, 2.0, 0.03)} | {1}):
        for d in sorted({0, m // 8, m // 4, m // 2, m}):
            fits, slack = True, math.inf
            for n, demand in demands:
                if demand <= 0:
                    continue
                empty = (1 - 1 / m) ** n
                several = 1 - empty - n / m * (1 - 1 / m) ** (n - 1)
                mean = m * (1 - empty) + d * several
                spread = math.sqrt(max(m * empty * (1 - empty), 0) + d * several * (1 - several))
                margin = (mean - demand) / max(spread, 1e-9)
                slack = min(slack, margin)
                fits &= margin >= 5 or m == 1 and demand <= 1
            size = (low + high) / 2
            cost = m * (1 - (1 - 1 / m) ** size) + d * size / m
            score = (not fits, cost if fits else -slack)
            if best is None or score < best[0]:
                best = score, (m, d)
    return best[1]


def _texts(row: dict) -> list[bytes]:
    ends = np.cumsum([0, *row["sizes"]]).tolist()
    data = pa.Codec("zstd").decompress(read_bytes(row["path"]), ends[-1], asbytes=True) if ends[-1] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def shingles(texts: list[bytes], rolling: Rolling, words: int = 5) -> list[np.ndarray]:
    """The set of each text as sorted distinct 64-bit hashes. Fewer words than a shingle are one; no words, none."""
    hashes, edges = word_hashes(texts, rolling)
    whole = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for j in range(words):
        whole += hashes[j : j + len(whole)] * _ODD[j % 5] * np.uint64(2 * (j // 5) + 1)
    whole = mixed(whole)
    out = []
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            out.append(mixed((hashes[a:b] * _ODD[np.arange(b - a) % 5]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray, seed: int) -> tuple[int, bytes]:
    """(class, digest) of a set: equal sets have equal classes; the digest tells unequal sets of one class."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=24, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little") >> 1, digest[8:]


def sketch(tokens: np.ndarray) -> bytes:
    """One parity bit for each of the least power of two of at least 2 n (and 64) cells."""
    cells = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((mixed(tokens ^ _SKETCH) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of several sizes, and lower bounds of the differences between their sets."""

    def __init__(self, sketches: list[bytes]):
        self.sizes = np.array([len(x) for x in sketches], np.int64)
        self.at = np.zeros(len(sketches), np.int64)
        self.rows = {}
        for size in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == size)
            self.at[which] = np.arange(len(which))
            self.rows[size] = np.frombuffer(b"".join(sketches[i] for i in which), np.uint64).reshape(len(which), -1)

    def folded(self, size: int, least: int) -> np.ndarray:
        if (size, least) not in self.rows:
            self.rows[size, least] = np.bitwise_xor.reduce(self.rows[size].reshape(len(self.rows[size]), -1, least // 8), axis=1)
        return self.rows[size, least]

    def distances(self, i: np.ndarray, other: Sketches, k: np.ndarray) -> np.ndarray:
        """For the pairs (i of these, k of the other): never more than their true difference."""
        out = np.zeros(len(i), np.int64)
        sizes = np.stack([self.sizes[i], other.sizes[k]])
        for one, two in np.unique(sizes, axis=1).T.tolist():
            pairs = np.flatnonzero((sizes[0] == one) & (sizes[1] == two))
            least = min(one, two)
            mine, theirs = self.folded(one, least), other.folded(two, least)
            for lo in range(0, len(pairs), 4096):
                part = pairs[lo : lo + 4096]
                out[part] = np.bitwise_count(mine[self.at[i[part]]] ^ theirs[other.at[k[part]]]).sum(axis=1)
        return out


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature) of all sets, and which sets' values fall short of a demand."""
    emit: list[tuple[int, int, int]] = []  # set, band, demand
    for i, s in enumerate(sets):
        n = len(s)
        if not n:
            continue
        own = band_of(n)
        emit.append((i, own, difference(n, band(own)[0], n, percent) + 1))
        k, least = own - 1, -(-percent * n // 100)
        while k >= 0 and band(k)[1] > least:
            demand = difference(n, band(k)[0], band(k)[1] - 1, percent) + 1
            if demand > 0:
                emit.append((i, k, demand))
            k -= 1
    short = np.zeros(len(sets), bool)
    if not emit:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), short
    who, bands, demand = (np.array(x, np.int64) for x in zip(*emit))
    m, d = (np.array(x, np.int64) for x in zip(*(allocation(int(k), percent) for k in bands)))
    lengths = np.array([len(sets[i]) for i in who])
    tokens = np.concatenate([sets[i] for i in who])
    e = np.repeat(np.arange(len(who)), lengths)
    mixed_tokens = mixed(tokens ^ _TOKEN)
    segment = ((mixed_tokens >> np.uint64(40)) % m[e].astype(np.uint64)).astype(np.int64)
    key = e * (int(m.max()) + 1) + segment
    order = np.argsort(key, kind="stable")
    key, values = key[order], mixed(mixed_tokens[order])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    content = np.add.reduceat(values, first)
    of, place = e[order][first], segment[order][first]
    salt = mixed((bands[of] * 1_000_003 + place).astype(np.uint64) * _ODD[1] + _ODD[0])
    double = (place < d[of]) & (size >= 2)
    reached = np.bincount(of, 1 + double, len(who))
    short[who[reached < demand]] = True
    # A set in a lower band than its own only probes: its largest segments suffice, as they are the most telling.
    probes = bands[of] != np.array([band_of(len(sets[i])) for i in who], np.int64)[of]
    rank = np.lexsort((-size, of))
    nth = np.empty(len(of), np.int64)
    nth[rank] = np.arange(len(of)) - np.searchsorted(of[rank], of[rank])
    kept = ~probes | (d[of] > 0) | (nth < demand[of])
    owners, found = [who[of[kept]]], [mixed(content[kept] + salt[kept])]
    at = np.repeat(np.arange(len(first)), size)
    inner = double[at]
    owners.append(who[of[at[inner]]])
    found.append(mixed(content[at[inner]] - values[inner] + salt[at[inner]]))
    return np.concatenate(owners), np.concatenate(found), short


def _sets(row: dict, words: int) -> list[np.ndarray]:
    return shingles(_texts(row), Rolling(5), words)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Join:
    """One join: its batches, and the class of every document."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, percent: int):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.scratch = Scratch(self.spark, "nearcopies")
        self.batches = pack(docs, self.scratch, doc_id=doc_id, text=text)
        for seed in range(8):
            self.seed = seed
            self.docs = self.scratch.store(spread(self.batches).mapInArrow(trimmed(self._classes()), "doc_id long, n long, class long, digest binary, body binary, sketch binary, path string, place int"), "docs")
            mixed_up = self.docs.where("n > 0").groupBy("class").agg((F.min("digest") != F.max("digest")).alias("clash")).where("clash")
            if mixed_up.isEmpty():
                self.batches = self.batches.drop("digests")
                return
            self.scratch.drop(self.docs)
        raise ValueError("sets clash under every seed")

    def _classes(self):
        words, seed = self.words, self.seed

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("sketch", pa.binary()), ("path", pa.string()), ("place", pa.int32())])
            for batch in rows:
                for row in batch.to_pylist():
                    sets = _sets(row, words)
                    known = [(*class_of(s, seed), sketch(s)) if len(s) else (None, None, None) for s in sets]
                    out, seen = [], set()
                    for key, p in zip(row["ids"], row["places"]):
                        own = known[p]
                        # One document of each text carries the sketch.
                        out.append((key, len(sets[p]), own[0], own[1], row["digests"][p][:16], None if p in seen else own[2], row["path"], p))
                        seen.add(p)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)

        return run

    def classes(self) -> DataFrame:
        """One row a class: class, n, sketch, path, place."""
        rows = self.docs.where("sketch is not null")
        one = rows.groupBy("class").agg(F.min(F.struct("path", "place")).alias("at")).select("class", "at.path", "at.place")
        return self.scratch.store(rows.join(one, ["class", "path", "place"]).select("class", "n", "sketch", "path", "place"), "classes")

    def tied_signatures(self, classes: DataFrame) -> DataFrame:
        """Distinct (sig, class): the signatures that several classes of the corpus may share; a null sig marks a class
        whose signatures fall short. Only the batch that `classes` names for a class sends its signatures."""
        words, percent = self.words, self.percent
        homes = classes.groupBy("path").agg(F.collect_list(F.struct("place", "class")).alias("homes"))
        batches = self.scratch.store(self.batches.join(homes, "path"), "homes")

        def keys(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            texts = _texts(row)
            owner, found, short = signatures(shingles([texts[x["place"]] for x in row["homes"]], Rolling(5), words), percent)
            own = np.array([x["class"] for x in row["homes"]], np.int64)
            return found, own[owner], own[short]

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for row in batch.to_pylist():
                    found, owners, short = keys(row)
                    distinct, which = np.unique(found, return_inverse=True)
                    tied = _masked(row["tied"], len(distinct))[which]
                    found, owners = found[tied], owners[tied]
                    order = np.lexsort((owners, found))
                    found, owners = found[order], owners[order]
                    # Hashes of two segments of a set may be equal; its signature counts once.
                    once = np.concatenate([[True], (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])]) if len(found) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(found[once].view(np.int64)), pa.array(owners[once])], ["sig", "class"])
                    if len(short):
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(short), pa.int64()), pa.array(short)], ["sig", "class"])

        # About one key of 8 bytes for two shingles; a bucket of keys is one task's.
        n = classes.agg(F.sum("n")).first()[0] or 0
        edges = even_edges(max(2 * parallelism(self.spark), -(-4 * n // BUCKET)))
        masked, masks = exchange(batches, lambda row: keys(row)[0], "tied", edges, 8, self.scratch)
        out = self.scratch.store(spread(masked).mapInArrow(trimmed(run), "sig long, class long"), "signatures")
        self.scratch.drop(batches, masks)
        return out

    def near(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and sketches leave open."""
        percent = self.percent
        a, b = (classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, s = (batch.column(f"n_{x}").to_numpy() for x in "ab")
                bound = n + s - 2 * overlap(n, s, percent)
                one, two = (Sketches(batch.column(f"sketch_{x}").to_pylist()) for x in "ab")
                far = one.distances(np.arange(len(n)), two, np.arange(len(n)))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(far <= bound))

        sized = pairs.join(b, "b").join(a, "a").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        return sized.mapInArrow(trimmed(run), "a long, b long")

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are linked, by their sets."""
        words, percent = self.words, self.percent
        asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        places = asked.join(classes.select("class", "path", "place"), "class").groupBy("path").agg(F.collect_list(F.struct("place", "class")).alias("asked"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    texts = _texts(row)
                    sets = shingles([texts[x["place"]] for x in row["asked"]], Rolling(5), words)
                    yield pa.RecordBatch.from_arrays([pa.array([x["class"] for x in row["asked"]], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"))]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        sets = self.scratch.store(self.batches.join(places, "path").mapInArrow(trimmed(fetch), "class long, tokens binary"), "sets")
        a, b = (sets.select(F.col("class").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
        out = self.scratch.store(pairs.join(b, "b").join(a, "a").mapInArrow(trimmed(compare), "a long, b long"), "links")
        self.scratch.drop(sets)
        return out

    def stragglers(self, marked: DataFrame, classes: DataFrame) -> DataFrame | None:
        """Links of the sets whose signatures fall short: compared with all sets, in blocks."""
        words, percent, spark = self.words, self.percent, self.spark
        few = classes.join(marked.distinct(), "class", "left_semi").select("class", "path", "place", "n")
        total = few.agg(F.sum("n")).first()[0]
        if not total:
            return None
        blocks, links = -(-total // BLOCK), None
        for k in range(blocks):
            block = few.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == k)
            sent = spark.sparkContext.broadcast([(r["class"], r["path"], r["place"]) for r in block.collect()])
            homes = [(r[0], r[2], r[1]) for r in sent.value]
            rows = self.batches.where(F.col("path").isin([p for _, _, p in homes]))
            wanted: dict[str, list] = {}
            for c, place, path in homes:
                wanted.setdefault(path, []).append((place, c))

            def fetch(batches, wanted=wanted):
                for batch in batches:
                    for row in batch.to_pylist():
                        texts = _texts(row)
                        asked = wanted[row["path"]]
                        sets = shingles([texts[p] for p, _ in asked], Rolling(5), words)
                        yield pa.RecordBatch.from_arrays([pa.array([c for _, c in asked], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])

            own = spark.sparkContext.broadcast([(r["class"], bytes(r["tokens"])) for r in rows.mapInArrow(trimmed(fetch), "class long, tokens binary").collect()])

            def compare(batches, own=own, seed=self.seed):
                few_sets = [(c, np.frombuffer(t, np.uint64)) for c, t in own.value]
                for batch in batches:
                    for row in batch.to_pylist():
                        found = []
                        for s in _sets(row, words):
                            if len(s):
                                c = class_of(s, seed)[0]
                                found += [(c, f) for f, t in few_sets if f != c and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and _linked(s, t, percent)]
                        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

            part = self.scratch.store(self.batches.mapInArrow(trimmed(compare), "a long, b long"), "links")
            links = part if links is None else links.unionByName(part)
        return links

    def labels(self) -> DataFrame:
        """(node, label) of the classes that are linked with another."""
        scratch = self.scratch
        classes = self.classes()
        every = self.tied_signatures(classes)
        shared = every.where("sig is not null")
        hubs = scratch.store(shared.groupBy("sig").agg(F.min("class").alias("hub"), F.max("class").alias("last"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(7))).alias("y")).where("hub <> last"), "hubs")
        # Every set with the least set of each of its signatures; the least of those that sketches leave open is compared.
        pairs = shared.join(hubs.select("sig", "hub"), "sig").where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
        first = scratch.store(self.near(pairs, classes).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        links = self.verified(first, classes)
        extra = self.stragglers(every.where("sig is null").select("class"), classes)
        links = links if extra is None else links.unionByName(extra)
        # Signatures with the same members are one group.
        groups = hubs.groupBy("size", "x", "y").agg(F.min("sig").alias("sig")).where("size > 1").select("sig", "size")
        labels = components(links, scratch)
        member = self.impure(shared.withColumnRenamed("class", "c").join(groups, "sig"), labels)
        scratch.drop(every, hubs, first)
        whole = False
        while True:
            found = self.across(member, classes, whole)
            more = self.verified(found.where("sig is null").select("a", "b").distinct(), classes)
            open_ = found.where("sig is not null").select("sig").distinct()
            linked, done = not more.isEmpty(), open_.isEmpty()
            if linked:
                scratch.drop(labels)
                links = links.unionByName(more)
                labels = components(links, scratch)
            if done:
                scratch.drop(member, found)
                return labels
            # What is left of the open signatures; the search over all their pairs ends it when the nearest are no links.
            left = self.impure(member.drop("l_c").join(open_, "sig", "left_semi"), labels)
            scratch.drop(member, found)
            member, whole = left, not linked

    def impure(self, member: DataFrame, labels: DataFrame) -> DataFrame:
        """The members (sig, c, l_c, size), stored, of groups that hold several components."""
        named = member.join(labels.select(F.col("node").alias("c"), F.col("label").alias("l_c")), "c", "left").withColumn("l_c", F.coalesce("l_c", "c"))
        # Written, so that the join below deals members by a signature that it may split.
        several = self.scratch.store(named.groupBy("sig").agg(F.min("l_c").alias("lo"), F.max("l_c").alias("hi")).where("lo <> hi").select("sig"), "several")
        out = self.scratch.store(named.join(several, "sig", "left_semi"), "members")
        self.scratch.drop(several)
        return out

    def across(self, member: DataFrame, classes: DataFrame, whole: bool) -> DataFrame:
        """Pairs (a, b), a < b, with a null sig, of members (sig, c, l_c, size) in different components that sizes and
        sketches leave open: all of them, or, unless `whole`, in a tile with many for each member the nearest one only.
        Then a row (null, null, sig) names the tile's signature."""
        percent = self.percent
        parts = F.least(F.ceil(F.col("size") / TILE), F.lit(PARTS)).cast("int")
        least = member.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, LEAST).alias("sigs"))
        rows = member.join(least, "c").join(classes.select(F.col("class").alias("c"), "n", "sketch"), "c").withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("parts", parts)
        # A member meets every part of its signature in a tile (i, j), i <= j.
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        tiles = rows.withColumn("other", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select("sig", "i", "j", "part", "c", "l_c", "n", "sigs", "sketch")

        names = ["sig", "i", "j", "part", "c", "l_c", "n"]

        def search(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
            sig, i, j, part, c, label, n = (chunk.column(x).to_numpy() for x in names)
            known = Sketches(chunk.column("sketch").to_pylist())
            lists = chunk.column("sigs").combine_chunks()
            told, to_told = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            tile = np.cumsum(np.concatenate([[0], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            limit = OPEN * np.bincount(tile)
            count = np.zeros(len(limit), np.int64)
            best, nearest = np.full(len(sig), -1, np.int64), np.zeros(len(sig), np.int64)

            def keys(at: np.ndarray, own: np.ndarray) -> np.ndarray:
                """(pair, signature) of the least signatures of rows that are less than their tile's."""
                size = starts[at + 1] - starts[at]
                pair = np.repeat(np.arange(len(at)), size)
                value = to_told[np.arange(len(pair)) + np.repeat(starts[at] - np.cumsum(size) + size, size)]
                return (pair * (len(told) + 1) + value)[told[value] < own[pair]]

            def batch(one: np.ndarray, two: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
                for lo in range(0, len(one), 1 << 16):
                    x, y = one[lo : lo + (1 << 16)], two[lo : lo + (1 << 16)]
                    # A pair that meets at a lesser signature as well is told there.
                    met = np.intersect1d(keys(x, sig[x]), keys(y, sig[x]), assume_unique=True) // (len(told) + 1)
                    y[met] = -1
                one, two = one[two >= 0], two[two >= 0]
                pairs = np.unique(np.stack([np.minimum(c[one], c[two]), np.maximum(c[one], c[two])]), axis=1) if len(one) else np.zeros((2, 0), np.int64)
                pad = pa.nulls(len(many), pa.int64())
                columns = [pa.concat_arrays([pa.array(pairs[0], pa.int64()), pad]), pa.concat_arrays([pa.array(pairs[1], pa.int64()), pad]), pa.concat_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(many, pa.int64())])]
                return pa.RecordBatch.from_arrays(columns, ["a", "b", "sig"])

            left, right, held, none = [], [], 0, np.zeros(0, np.int64)
            # Rows ascend by size in a tile: once a row is too large for another, so are those after it.
            at, step = np.arange(len(sig)), 1
            while len(at := at[at + step < len(sig)]):
                to = at + step
                at = at[(tile[at] == tile[to]) & (n[to] * percent <= 100 * n[at])]
                to = at + step
                # Two of one part meet in its own tile.
                mine = at[(label[at] != label[to]) & ((i[at] == j[at]) | (part[at] != part[to]))]
                if len(mine):
                    to = mine + step
                    slack = n[mine] + n[to] - 2 * overlap(n[mine], n[to], percent) - known.distances(mine, known, to)
                    mine, to, slack = mine[slack >= 0], to[slack >= 0], slack[slack >= 0]
                    np.add.at(count, tile[mine], 1)
                    closer = slack > best[mine]
                    best[mine[closer]], nearest[mine[closer]] = slack[closer], to[closer]
                    # What a tile holds is bounded by its rows.
                    kept = whole | (count[tile[mine]] <= limit[tile[mine]])
                    left.append(mine[kept])
                    right.append(to[kept])
                    held += int(kept.sum())
                    if whole and held >= 1 << 18:
                        yield batch(np.concatenate(left), np.concatenate(right), none)
                        left, right, held = [], [], 0
                step += 1
            one, two = (np.concatenate(x) if x else none for x in (left, right))
            many = none
            if not whole:
                full = count > limit
                rest, near = ~full[tile[one]], np.flatnonzero(full[tile] & (best >= 0))
                one, two = np.concatenate([one[rest], near]), np.concatenate([two[rest], nearest[near]])
                many = np.unique(sig[full[tile]])
            yield batch(one, two, many)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            rows = 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= 16 * TILE:
                    table = pa.Table.from_batches(held).combine_chunks()
                    keys = [table.column(x).to_numpy() for x in names[:3]]
                    last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
                    cut = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on in the next batch
                    if cut:
                        yield from search(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = table.num_rows - cut
            if rows:
                yield from search(pa.Table.from_batches(held))

        dealt = tiles.repartition(2 * parallelism(self.spark), "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n")
        return self.scratch.store(dealt.mapInArrow(trimmed(run), "a long, b long, sig long"), "across")

    def named(self) -> DataFrame:
        """Per document: doc_id, n, body (digest of its text), label (of its group; null without a set). Everything
        else that the join has stored is dropped."""
        labels = self.labels().select(F.col("node").alias("class"), "label")
        rows = self.docs.select("doc_id", "n", "body", "class")
        out = self.scratch.store(rows.join(labels, "class", "left").select("doc_id", "n", "body", F.coalesce("label", "class").alias("label")), "named")
        self.scratch.drop(*(t for t, _ in self.scratch.tables if t is not out), self.scratch.root + "/1-texts")
        return out


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles (set size), component_id (the smallest doc_id reachable by links).

    Two rows link when 100 * intersection >= percent * union of their sets. Null text and text without words have
    no set and link with nothing: their component is their own id. Null ids stay null and never name a component
    that has another id. Rows that repeat an id are rows of their own. An empty table gives no rows."""
    work = Join(docs, doc_id, text, words, percent)
    rows = work.named().select("doc_id", "n", "label")
    named = rows.where("label is not null")
    # Written, so that the join below deals named rows by a label that it may split.
    least = work.scratch.store(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    whole = named.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(rows.where("label is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))).withColumnRenamed("doc_id", doc_id)


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, most: int = 250_000) -> DataFrame:
    """One row of `docs` for each group of linked rows, with the columns of `docs`: that with the smallest id (null
    last), and of rows that repeat it the one whose text has the least digest; of rows that repeat id and text, one.
    Rows without a set all stay.

    Rows are told by id and digest of the text. What goes is broadcast up to `most` rows of 24 bytes, else joined."""
    work = Join(docs, doc_id, text, words, percent)
    scratch, key, name = work.scratch, f"key_{uuid.uuid4().hex}", f"id_{uuid.uuid4().hex}"
    rows = work.named().where("label is not null").select("label", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "body").alias("order"))
    best = scratch.store(rows.groupBy("label").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("n")), "best")
    other = rows.join(best.where("n > 1"), "label")
    gone = scratch.store(other.where("order <> best").select(F.col("order.id").alias(name), F.col("order.body").alias(key)).distinct(), "gone")
    again = other.where("order = best").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.first("best").alias("best")).where("n > 1")
    again = scratch.store(again.select(F.col("best.id").alias(name), F.col("best.body").alias(key)), "again")
    told = docs.withColumn(name, F.col(doc_id).cast("long")).withColumn(key, F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32)))
    small = lambda t: F.broadcast(t) if t.count() <= most else t
    same = lambda t: told[name].eqNullSafe(t[name]) & (told[key] == t[key])
    dropped = small(gone)
    kept = told.join(dropped, same(gone), "left_anti")
    if not again.isEmpty():
        twins = small(again)
        rest = kept.join(twins, kept[name].eqNullSafe(again[name]) & (kept[key] == again[key]), "left_anti")
        kept = rest.unionByName(kept.join(twins, kept[name].eqNullSafe(again[name]) & (kept[key] == again[key]), "left_semi").dropDuplicates([name, key]))
    return kept.select(*docs.columns)


def brute_force(docs: list[tuple], words: int = 5, percent: int = 80) -> list[tuple]:
    """What join() returns, by comparing all pairs of sets of word tuples; for tests."""
    import re

    sets = []
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append((d, {tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set()))
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)]
