"""Token-id output: raw id payloads in shards, with a minimal perfect hash index from document keys to offsets.

A shard is two files in shared storage. `.ids` holds the ids of its documents back to back, little-endian,
two bytes an id where the vocabulary allows and else four. `.mph` holds the document table (keys and starts,
in order) and the index: leveled bit arrays (a key sits at the first level where no other key of that level
hashes to its bit; its slot is the rank of the bit) and, by slot, a fingerprint of the key, the position of
its first document and their number. A lookup reads one slot and tells foreign keys by the fingerprint.

Documents are range-partitioned by key, so shards follow each other in key order; a key that a great many
rows share spreads over several shards by a hash of the text. Files carry the name of the attempt that wrote
them and count only once the manifest, a table that Spark commits, names them: a lost executor or a repeated
task leaves at most files that nobody reads.
"""

from __future__ import annotations

import bisect
import functools
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, packed, parallelism, read_bytes, shared_dir, storage, texts_of, trimmed, write_bytes

MAGIC = b"GMTOK001"
_LEVELS = 48
_GAMMA = 2


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(values + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        for level in range(_LEVELS):
            if not len(values):
                break
            size = _GAMMA * len(values)
            at = cls.place(values, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            values = values[~alone[at]]
        if len(values):
            raise ValueError("keys of a shard must be distinct")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, values: np.ndarray) -> np.ndarray:
        """The slot of each value; -1 where no level takes it."""
        out = np.full(len(values), -1, np.int64)
        open_ = np.arange(len(values))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.base[level] + self.place(values[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out


def _values(keys: np.ndarray) -> np.ndarray:
    """Keys as distinct hash inputs."""
    return mixed(keys.astype(np.uint64))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: list[int | None], counts: list[int], width: int) -> bytes:
    """The `.mph` file of documents with these keys (equal keys adjacent) and id counts."""
    null = np.array([k is None for k in keys], dtype=bool)
    flat = np.array([k or 0 for k in keys], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.uint64))]).astype("<u8")
    first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (null[1:] != null[:-1])]) if len(flat) else np.zeros(0, bool))
    # Null keys, which no hash value is left for, come first; their number tells where they are.
    first = first[~null[first]]
    own = flat[first]
    found = PerfectHash.build(_values(own))
    slots = found.slots(_values(own))
    prints, places, repeats = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    prints[slots], places[slots], repeats[slots] = _fingerprints(own), first, np.diff(np.append(first, len(flat)))
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<IQQI", width, len(flat), len(own), len(found.sizes)))
    for part in (np.asarray(found.sizes, "<u8"), np.packbits(found.bits), prints, places, repeats, flat.astype("<i8"), np.packbits(null), starts):
        out.write(part.tobytes())
    return out.getvalue()


class Shard:
    """A shard opened for keyed access."""

    def __init__(self, path: str):
        data = read_bytes(path + ".mph")
        if data[:8] != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.path = path
        self.width, self.n_docs, n_keys, n_levels = struct.unpack_from("<IQQI", data, 8)
        at = 8 + struct.calcsize("<IQQI")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        sizes = take("<u8", n_levels).astype(int).tolist()
        bits = np.unpackbits(take("u1", -(-sum(sizes) // 8)), count=sum(sizes)).astype(bool)
        self.hash = PerfectHash(sizes, bits)
        self.prints, self.places, self.repeats = (take("<u4", n_keys) for _ in range(3))
        self.keys = take("<i8", self.n_docs)
        self.null = np.unpackbits(take("u1", -(-self.n_docs // 8)), count=self.n_docs).astype(bool)
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; 0 documents where the shard lacks it."""
        slots = np.where(null, -1, self.hash.slots(_values(keys)))
        known = slots >= 0
        known[known] = self.prints[slots[known]] == _fingerprints(keys)[known]
        place, n = np.zeros(len(keys), np.int64), np.where(null, int(self.null.sum()), 0)
        place[known], n[known] = self.places[slots[known]], self.repeats[slots[known]]
        return place, n

    def ids(self, first: int, last: int | None = None) -> np.ndarray:
        """The ids of documents first to last (exclusive), read from the payload alone."""
        a, b = self.starts[first], self.starts[first + 1 if last is None else last]
        return np.frombuffer(read_bytes(self.path + ".ids", int(a) * self.width, int(b - a) * self.width), f"<u{self.width}")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The id sequences of the documents with this key."""
        null = np.array([key is None])
        place, n = self.find(np.array([key or 0], dtype=np.int64), null)
        return [self.ids(int(place[0]) + i) for i in range(int(n[0]))]


#: Kinds of bytes, as the pre-tokeniser's pattern tells them apart: white space, letters, digits, signs. What it may
#: take otherwise is UNSURE: apostrophes (contractions), control characters, and all beyond Latin letters.
_SPACE, _LETTER, _DIGIT, _SIGN, _UNSURE = range(5)
_KIND = np.full(256, _UNSURE, np.uint8)
_KIND[[9, 10, 12, 13, 32]] = _SPACE
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _UNSURE
#: Last bytes of white space beyond ASCII in UTF-8, and control characters: a cut after these might split white space.
_LAST_OF_SPACE = np.zeros(256, bool)
_LAST_OF_SPACE[[*range(0, 32), 127, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a piece that can be encoded alone: a pre-token never goes on into white space, nor from
    letters, digits or signs into another of the three; white space stays with what follows it."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    lead = lead[lead + 1 < len(data)]
    after = data[lead + 1]
    lead = lead[(after & 0xC0 == 0x80) & ~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)))]
    kind[lead] = kind[lead + 1] = _LETTER  # Latin letters of two bytes
    out = np.ones(len(data), bool)
    before, own = kind[:-1], kind[1:]
    space = (own == _SPACE) & (before != _SPACE) & ~((before == _UNSURE) & _LAST_OF_SPACE[data[:-1]])
    out[1:] = space | (own != before) & (before != _SPACE) & (own != _SPACE) & (before != _UNSURE) & (own != _UNSURE)
    return out


class Encoder:
    """A tokenizer file's encode(text, add_special_tokens=False), with a bounded memory of encoded pieces where the
    pre-tokeniser lets a text be cut.

    Texts are cut and their pieces told apart in vectors; each distinct piece of a batch is looked up once, and only
    new ones reach the tokenizer."""

    LONG = 64  # longer pieces are not remembered

    def __init__(self, path: str, most: int = 500_000):
        # A task has one core: threads of the library's own would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = spec.get("added_tokens") or []
        plain = plain and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in added)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.lengths, self.added = None, [t["content"].encode() for t in added]
        if plain:
            self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            own = {t["id"]: len(t["content"].encode()) for t in added}
            for token, k in vocabulary.items():
                self.lengths[k] = own.get(k, len(token))
        self._forget()

    def _forget(self) -> None:
        """`ids` holds those of all known pieces, `from_` and `upto` where each piece's are."""
        self.known: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, f"<u{self.width}"), 0
        self.from_, self.upto = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Encodes pieces and appends them, in an order of its own. Those from white space to something else are
        encoded in one text, as the pre-tokeniser cuts between them."""
        blank = lambda c: _KIND[c] == _SPACE
        apart = [blank(x[0]) and not blank(x[-1]) and not _LAST_OF_SPACE[x[-1]] for x in new]
        joined = [x for x, a in zip(new, apart) if a]
        rest = [x for x, a in zip(new, apart) if not a]
        parts, sizes = [], []
        if joined:
            ids = np.asarray(self.tokenizer.encode_batch_fast([b"".join(joined).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in joined])) + 1
            if ends[-1] != len(ids):  # bytes that are no UTF-8 have other lengths
                rest, joined = rest + joined, []
            else:
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)]
            parts.append(np.array([i for e in found for i in e], np.int64))
            sizes.append(np.array([len(e) for e in found], np.int64))
        flat, lengths = np.concatenate(parts), np.concatenate(sizes)
        at, k = self.n_ids, len(self.known)
        while len(self.ids) < at + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.from_) < k + len(lengths):
            self.from_, self.upto = (np.concatenate([x, np.zeros_like(x)]) for x in (self.from_, self.upto))
        self.ids[at : at + len(flat)] = flat
        self.upto[k : k + len(lengths)] = at + np.cumsum(lengths)
        self.from_[k : k + len(lengths)] = self.upto[k : k + len(lengths)] - lengths
        self.n_ids = at + len(flat)
        self.known.update(zip(joined + rest, range(k, k + len(lengths))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, how many of them each text has). Bytes that are no UTF-8 are replaced."""
        if self.lengths is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for e in found for i in e], f"<u{self.width}"), np.array([len(e) for e in found], np.int64)
        if len(self.known) > self.most:
            self._forget()
        edges = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return self.ids[:0], np.zeros(len(texts), np.int64)
        begins = piece_starts(data)
        for k, t in enumerate(texts):  # an added token may go from one kind into another: such a text is one piece
            if any(a in t for a in self.added):
                begins[edges[k] : edges[k + 1]] = False
        begins[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(begins)
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.known]
        new.sort(key=len)
        short = bisect.bisect_right(new, self.LONG, key=len)
        if short:
            self._learn(new[:short])
        held = self.n_ids
        if new[short:]:
            self._learn(new[short:])
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        first, n = self.from_[place], self.upto[place] - self.from_[place]
        upto = np.cumsum(n)
        out = self.ids[np.repeat(first - upto + n, n) + np.arange(upto[-1])]
        for x in new[short:]:
            del self.known[x]
        self.n_ids = held
        before = np.concatenate([[0], upto])[np.searchsorted(starts, edges)]
        return out, np.diff(before)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write(folder: str, tokenizer: str, end: int):
    kind = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, path, out = encoder(tokenizer), TaskContext.get().partitionId(), f"{folder}/shard-{uuid.uuid4().hex}", None
        keys: list = []
        counts: list[int] = []
        for part in packed(batches, "body", 2 << 20):
            ids, n = coder.encode(texts_of(part.column("body")))
            if out is None:
                system, at = storage(path)
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(at + ".ids", compression=None)
            out.write(np.insert(ids, np.cumsum(n), end).tobytes())
            keys += part.column("key").to_pylist()
            counts += (n + 1).tolist()
        if out is not None:
            out.close()
            write_bytes(path + ".mph", pack_index(keys, counts, coder.width))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(keys), "n_tokens": sum(counts), "first_key": keys[0], "last_key": keys[-1]}], kind)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 0, shard_bytes: int = 128 << 20) -> DataFrame:
    """Writes the shards under `folder` and returns the manifest: shard (its place in key order), path, n_docs,
    n_tokens, first_key, last_key.

    Null keys come first, null text is empty; every document ends with the id `end`. Documents with equal keys keep
    an order by a hash of their text. An empty table writes no shard. Ids are integers. There are as many shards as
    shuffle partitions, and more where that would be over `shard_bytes` of text for each."""
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body")).withColumn("tie", F.xxhash64("body"))
    order = (F.col("key").asc_nulls_first(), F.col("tie").asc())
    shards = parallelism(docs.sparkSession)
    # The plan's estimate (files as they are packed, or more) tells whether the texts need be measured at all.
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > shards * shard_bytes // 4:
        size = rows.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
        shards = max(shards, -(-size // shard_bytes))
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "body")
    manifest = ranged.mapInArrow(trimmed(_write(folder, tokenizer, end)), "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(r["path"])
            places, repeats = shard.find(shard.keys, shard.null)
            # Equal keys are adjacent: the i-th document of a key is the i-th from where the index says it begins.
            nth = np.arange(shard.n_docs) - places
            if ((nth < 0) | (nth >= repeats)).any():
                raise ValueError(f"{r['path']}: the index does not lead to its documents")
            at = places + nth
            lo = 0
            while lo < shard.n_docs:  # documents of about a million ids at once
                hi = min(max(lo + 1, int(np.searchsorted(shard.starts, shard.starts[lo] + (1 << 20), side="right")) - 1), shard.n_docs)
                ids, base = shard.ids(lo, hi), shard.starts[lo]
                cuts = (shard.starts[at[lo:hi]] - base, shard.starts[at[lo:hi] + 1] - base)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(*(c.tolist() for c in cuts))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys[lo:hi], mask=shard.null[lo:hi]), pa.array(r["base"] + shard.starts[at[lo:hi]]), pa.array(cuts[1] - cuts[0]), pa.array(crc, pa.int64())], schema=kind)
                lo = hi


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = placed.repartition(parallelism(manifest.sparkSession))
    return spread.mapInArrow(trimmed(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: list, key: int | None) -> list[np.ndarray]:
    """Id sequences of a key, by the collected rows of a manifest: the shards whose key range holds it, then one slot each."""
    low = lambda k: -(1 << 64) if k is None else k
    return [ids for r in manifest if low(r["first_key"]) <= low(key) <= low(r["last_key"]) for ids in Shard(r["path"]).get(key)]


def report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes `docs` to a fresh folder of shared storage and reads the files back, per document."""
    return read(write(docs, shared_dir(docs.sparkSession, "tokens"), tokenizer, **options))


def brute_force(docs: list[tuple], tokenizer: str) -> list[tuple]:
    """What report() returns, by encoding every text whole; for tests."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer)
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*coder.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    starts = [0, *accumulate(map(len, ids))]
    return [(d, s, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for (d, _), s, x in zip(rows, starts, ids)]
