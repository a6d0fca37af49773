"""What the corpus operators share: shared-storage folders, table reads, Arrow plumbing, word hashing.

Conventions of the subpackage: null text is empty text; rows keep their own identity (repeated or
null ids never merge rows); an operator selects the columns it names and ignores any other column.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and Python, and the setting's default.
BATCH, _BATCH_SETTING, _BATCH_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Texts are large: where the session leaves the size of Arrow batches at its default, it is
    lowered, as an executor holds several on both sides of each task."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has named in shared storage and not dropped; pipelines clear what earlier stages left.
_named: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the cluster's checkpoint folder. Where none is named, a session on one machine gets
    a temporary folder; on a cluster, whose executors could not see that, this raises."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        top = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(top)
    _named.append(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _named[-1]


def named() -> list[str]:
    """The folders named so far and not dropped."""
    return list(_named)


def drop(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of shared storage."""
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if folder in _named:
            _named.remove(folder)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The frame written once to shared storage and read back: later stages neither recompute it nor
    depend on an executor that may be gone."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables and file folders of one run of an operator in shared storage. The operator drops each once what was
    made from it is committed, so that the disk holds what is still to be read and no more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables, self.n = spark, shared_dir(spark, name), [], 0

    def folder(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        out = stored(df, name, path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame | str | None) -> None:
        """Deletes tables of this store, and folders; other frames and None are left alone."""
        gone = [p for t in tables for x, p in self.tables if x is t] + [t for t in tables if isinstance(t, str)]
        self.tables = [(x, p) for x, p in self.tables if p not in gone]
        drop(self.spark, *gone)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.lru_cache(maxsize=8)
def _filesystem(uri: str):
    from pyarrow import fs

    # Names that Hadoop has for stores, and those that Arrow has for the same.
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("wasb://", "abfs://")):
        if uri.startswith(hadoop):
            uri = arrow + uri.removeprefix(hadoop)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def storage(uri: str):
    """(pyarrow file system, path) of a folder or file URI, usable in any task."""
    return _filesystem(uri)


def write_bytes(uri: str, *parts: bytes) -> None:
    """Writes one file whole. Callers use names no other attempt uses and publish them through a table."""
    system, path = storage(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = storage(uri)
    with system.open_input_file(path) as f:
        return f.read_at((f.size() if length is None else length) if length != 0 else 0, start)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `most` bytes of `column` (binary or string) each."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
            yield batch.slice(at, n)
            at += n


def packed(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.Table]:
    """Rows of successive record batches gathered into tables of about `most` bytes of `column`."""
    held, size = [], 0
    for batch in pieces(batches, column, most):
        n = int(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0)
        if held and size + n > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def as_bytes(column):
    """A string column as its UTF-8 bytes, without a copy."""
    return column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column


def texts_of(column) -> list[bytes]:
    """The values of a binary column; null is empty."""
    return [x or b"" for x in column.to_pylist()]


def trimmed(run: Callable) -> Callable:
    """`run`, after which the Python worker, which lives on for other tasks, gives its free memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of every substring asked for, from prefix sums.

    `seed` picks the byte values; a second seed gives an independent hash."""

    BASE = 0xD1342543DE82EF95
    #: Powers of the base and of its inverse, the same for all seeds, kept in the worker up to KEPT of them.
    KEPT = 1 << 22
    up = down = np.ones(1, dtype=np.uint64)

    def __init__(self, seed: int = 0):
        self.values = np.random.default_rng(977 + seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = n + (1 << 18)
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(Rolling if size <= self.KEPT else self, name, np.cumprod(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, at: np.ndarray, length) -> np.ndarray:
        return mixed((prefix[at + length] - prefix[at]) * self.down[at])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes], rolling: Rolling, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^ \\t-\\r]+` of all texts (of their first `most` bytes), A-Z lower-cased, and
    where each text's words begin (len(texts) + 1 positions)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = _BLANK[data]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(data) and not blank[0]:
        starts = np.concatenate([[0], starts])
    prefix = rolling.prefix(_LOWER[data])
    if most:
        ends = np.minimum(ends, starts + most)
    hashes = rolling.windows(prefix, starts, ends - starts) ^ mixed((ends - starts).astype(np.uint64))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, edges)
