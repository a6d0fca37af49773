"""WARC archives: writing pages with payload-identical revisits, and reading by boundary-chain verification.

Writing. Payload digests come first, in a narrow table; of rows with equal payloads of at least `least` bytes
the largest id is the response and the others revisit it. What a revisit refers to is a table of the revisits
alone, joined by its measured size; payloads themselves never shuffle when it is small. Files carry the
attempt's name and count once the manifest, committed by Spark, names them.

Reading. Files are split into byte ranges. A task finds every record magic in its range, in headers and
payloads alike, and emits (offset, exit): where the chain of record lengths from that candidate leaves the
range. Pointer jumping over these edges, from offset 0 of each file, keeps the entries that a real chain
reaches, in as many rounds as the logarithm of a file's ranges. Only from those entries are records read, so
magic inside a payload never becomes a record.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, parallelism, read_bytes, shared_dir, storage, stored, texts_of

MAGIC = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
#: Bytes that the reader looks ahead for the end of a header, at first; longer headers make it look further.
HEADER = 1 << 16
#: What stands for a null and for an empty URL, as a response needs a target.
_NO_URL, _EMPTY_URL = "urn:x-no-url:null", "urn:x-no-url:empty"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.IGNORECASE)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, names)))}>"


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, shared: bool, place: str) -> bytes:
    """A record. A response that revisits refer to is named by its page and payload, which no other response shares
    (`shared`); every other record is named by its place in the archives."""
    uri = _NO_URL if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or _EMPTY_URL
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, told = http if revisit else http + payload, digest(payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page, told) if shared and not revisit else _urn(place)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        *([f"Page-Id: {page}"] if page is not None else []),
        f"WARC-Payload-Digest: sha1:{told}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"WARC-Refers-To: {_urn(refers_to, told)}", f"Refers-To-Page-Id: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return MAGIC + "\r\n".join(lines).encode() + _END + block + _END


def _write(folder: str):
    kind = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, n = f"{folder}/pages-{uuid.uuid4().hex}.warc", None, 0, 0
        for part in packed(batches, "body", 2 << 20):
            columns = [texts_of(part.column(c)) if c == "body" else part.column(c).to_pylist() for c in ("page", "url", "body", "refers_to", "revisit", "shared")]
            rows = [_record(*r, f"{path} {n + k}") for k, r in enumerate(zip(*columns))]
            if out is None:
                system, at = storage(path)
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(at, compression=None)
            data = b"".join(rows)
            out.write(data)
            size, n = size + len(data), n + len(rows)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}], kind)

    return run


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row of `pages` under `folder` and returns the manifest: path, bytes, records.

    Null html is an empty payload; a URL is written whole, whatever its length, and null and empty ones read back as
    they were. Every record has an id of its own, and a revisit names its response's. Of rows with equal payloads and the same largest id (repeated rows) one is the
    response and the others revisit it. A null id is below every id; if all ids of a payload are null, every row is
    a response. An empty table writes no file."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), body.alias("body")).withColumn("key", F.unhex(F.sha2("body", 256)))
    keys = rows.select("page", "key", F.length("body").alias("n"))
    groups = keys.groupBy("key").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")).where(f"copies > 1 and last is not null and n >= {least}")
    # Only payloads that several rows share: as a rule a small part of all, so this table decides how the payloads are joined.
    shared = stored(groups.select("key", "last"), "warc-shared")
    told = rows.join(shared, "key", "left")
    # Rows that repeat the response's id and payload: all but one become revisits.
    twins = stored(keys.join(shared, "key").where("page = last").groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("twin")), "warc-twins")
    told = told.join(twins, "key", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last"))
    columns = ["page", "url", "body", "last", "revisit"]
    every = told.where("twin is null or not page <=> last").withColumn("revisit", revisit).select(*columns)
    if not twins.isEmpty():
        every = every.unionByName(_once(told.where("twin and page = last")).select(*columns))
    out = every.select("page", "url", "body", F.when(F.col("revisit"), F.col("last")).alias("refers_to"), "revisit", F.col("last").isNotNull().alias("shared"))
    manifest = out.mapInArrow(_write(folder), "path string, bytes long, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _once(same: DataFrame, run: int = 4096) -> DataFrame:
    """Rows that agree in key and page with `revisit`: false for one of each key, of the least URL, and true for the
    others. They are counted by key and URL before anything is dealt, so a task holds a payload once, and made rows
    again in runs that many tasks share."""
    counted = stored(same.groupBy("key", "url").agg(F.first("page").alias("page"), F.first("last").alias("last"), F.first("body").alias("body"), F.count(F.lit(1)).alias("copies")), "warc-same")
    least = counted.groupBy("key").agg(F.min(F.struct(F.col("url").isNotNull().alias("named"), "url")).alias("least")).select("key", F.col("least.url").alias("least"))
    runs = counted.join(least, "key").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / run))))
    if (counted.agg(F.max("copies")).first()[0] or 0) > run:
        runs = runs.repartition(parallelism(same.sparkSession), "key", "url", "run")
    nth = F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, "copies") - 1))
    return runs.withColumn("nth", nth).withColumn("revisit", ~(F.col("url").eqNullSafe(F.col("least")) & (F.col("nth") == 0)))


def successor(data: bytes, at: int) -> int | None:
    """Where the record that begins at `at` ends, by its header; None where no whole header follows."""
    end = data.find(_END, at)
    if end < 0:
        return None
    length = _LENGTH.search(data, at, end + 2)
    return None if length is None else end + 4 + int(length[1]) + 4


def _from(path: str, start: int, length: int, at: int, size: int) -> bytes:
    """Bytes of the file from `start`: `length` of them, and so many more that they hold the end of a header that begins
    at `at` of them, if there is one."""
    length = min(length, size - start)
    data = read_bytes(path, start, length)
    while data.find(_END, at) < 0 and length < size - start:
        length = min(2 * length, size - start)
        data = read_bytes(path, start, length)
    return data


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, out): each magic in the range and where its chain leaves the range; out is null where it breaks."""
    kind = pa.schema([("path", pa.string()), ("at", pa.int64()), ("out", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            a, b, size = r["from"], r["upto"], r["bytes"]
            data = read_bytes(r["path"], a, min(b + HEADER, size) - a)
            found, at = [], data.find(MAGIC)
            while 0 <= at < b - a:
                found.append(at)
                at = data.find(MAGIC, at + 1)
            if found:  # the last header may end beyond what was read
                data = _from(r["path"], a, len(data), found[-1], size) if data.find(_END, found[-1]) < 0 else data
            exits: dict[int, int | None] = {}
            for at in reversed(found):
                to = successor(data, at)
                if to is not None and to < b - a:
                    to = exits.get(to, -1)
                    exits[at] = None if to == -1 else to
                else:
                    exits[at] = None if to is None or a + to > size else a + to
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found), pa.string()), pa.array([a + x for x in found], pa.int64()), pa.array([exits[x] for x in found], pa.int64())], schema=kind)


def _headers(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block.split(b"\r\n")[1:])}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each chain from its entry to the range's end; payload figures from the bytes where they are there."""
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for r in batch.to_pylist():
            a, b = r["at"], r["upto"]
            data, at, out = read_bytes(r["path"], a, b - a), 0, []
            while at < b - a:
                end, to = data.find(_END, at), successor(data, at)
                if to is None or to > len(data):  # the record goes past the range
                    more = _from(r["path"], a + at, HEADER, 0, r["bytes"])
                    end, to = more.find(_END), successor(more, 0)
                    whole = read_bytes(r["path"], a + at, to)
                    head, block, to = whole[:end], whole[end + 4 : to - 4], at + to
                else:
                    head, block = data[at:end], data[end + 4 : to - 4]
                fields = _headers(head)
                http, _, payload = block.partition(_END)
                told = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                kind_of = fields[b"warc-type"].decode()
                if kind_of == "response" and digest(payload) != told:
                    raise ValueError(f"{r['path']} at {a + at}: payload does not match its digest")
                n = len(payload) if kind_of == "response" else int(_headers(http)[b"content-length"])
                url = fields[b"warc-target-uri"].decode()
                url = None if url == _NO_URL else "" if url == _EMPTY_URL else url
                out.append((number(fields.get(b"page-id")), n, told, kind_of, number(fields.get(b"refers-to-page-id")), url))
                at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)


def reachable(edges: DataFrame, rounds: int) -> DataFrame:
    """(path, at): what is reached from offset 0 of each path over the edges (path, at, out), by pointer jumping:
    after round k, `reached` holds everything within 2**k edges and `jumps` leads 2**k edges on."""
    # Paths repeat, so the edges' files are far smaller than their rows: a broadcast chosen by file size would grow with them.
    jumps = edges.where("out is not null").hint("merge")
    reached = stored(edges.where("at = 0").select("path", "at"), "warc-reached")
    for k in range(rounds):
        step = reached.join(jumps, ["path", "at"]).select("path", F.col("out").alias("at"))
        reached = stored(reached.unionByName(step).distinct(), "warc-reached")
        if k + 1 < rounds:
            on = jumps.select("path", F.col("at").alias("out"), F.col("out").alias("far"))
            jumps = stored(jumps.join(on, ["path", "out"]).select("path", "at", F.col("far").alias("out")), "warc-jumps").hint("merge")
    return reached


def read(manifest: DataFrame, *, split: int = 8 << 20) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = manifest.sparkSession
    n = parallelism(spark)
    cuts = F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split)))
    ranges = manifest.where("bytes > 0").withColumn("cut", cuts).select("path", "bytes", (F.col("cut") * split).alias("from"), F.least((F.col("cut") + 1) * split, "bytes").alias("upto"))
    edges = stored(ranges.repartition(n).mapInArrow(_candidates, "path string, at long, out long"), "warc-edges")
    longest = manifest.agg(F.max("bytes")).first()[0] or 0
    # A chain enters a range at most once, so it has at most as many edges as a file has ranges.
    rounds = max(1, math.ceil(math.log2(max(2, -(-longest // split) + 1))))
    entries = reachable(edges, rounds)
    begun = entries.join(manifest.select("path", "bytes"), "path").where("at < bytes").withColumn("upto", F.least((F.floor(F.col("at") / split) + 1) * split, "bytes"))
    return begun.repartition(n).mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def report(pages: DataFrame, **options) -> DataFrame:
    """Writes `pages` to a fresh folder of shared storage and reads the archives back, per page."""
    return read(write(pages, shared_dir(pages.sparkSession, "warc"), **options))
