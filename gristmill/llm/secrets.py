"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a document is a path with a blob, named by the SHA-256 of its bytes. The ledger is a table
(blob, rules, findings) in shared storage: a scan reads which (blob, rule version) pairs it lacks, scans one
copy of each of those and appends their findings; then findings are joined back to every path that holds
the blob. Scanning again costs nothing for blobs already scanned under the same rules, and a new rule
version scans each distinct blob once.

Copies of a blob collapse on the map side before the shuffle, so a blob that a third of the paths hold
is one row a task; the join back to the paths is an equi-join that adaptive execution splits where skewed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Name of the rule set: it changes with any pattern, limit or kind above.
RULES = "base-" + hashlib.sha256("\n".join([*KINDS, "8", *(p.pattern + str(p.flags) for p in (_ASSIGN, _ACCESS, _HEX))]).encode()).hexdigest()[:12]
_KEYWORDS = ("passw", "secret", "token", "api")
_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField("spans", T.StringType())])


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed in KINDS; code points, end exclusive."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def findings(text: str) -> dict:
    found = spans(text)
    counts = {f"n_{k}": sum(x[2] == k for x in found) for k in KINDS}
    return counts | {"spans": ",".join(f"{k}:{a}:{b}" for a, b, k in found)}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("blob", pa.binary()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("spans", pa.string())])
    for batch in batches:
        rows = [findings(t or "") for t in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_pylist([{"blob": b} | r for b, r in zip(batch.column("blob").to_pylist(), rows)], kind)


def ledger(spark, path: str) -> DataFrame:
    """The findings kept at `path`; empty where there are none yet."""
    schema = T.StructType([T.StructField("blob", T.BinaryType())] + _FOUND.fields + [T.StructField("rules", T.StringType())])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def update(docs: DataFrame, path: str, *, text: str = "text", rules: str = RULES) -> None:
    """Scans each blob of `docs` that the ledger lacks under these rules, once, and appends its findings.

    The append is Spark's own job commit: an attempt that dies adds nothing, and the next call scans what is missing."""
    blobs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("blob", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    known = ledger(docs.sparkSession, path).where(F.col("rules") == rules).select("blob")
    unseen = blobs.dropDuplicates(["blob"]).join(known, "blob", "left_anti")
    kind = T.StructType([T.StructField("blob", T.BinaryType())] + _FOUND.fields)
    unseen.mapInArrow(_scan, kind).withColumn("rules", F.lit(rules)).write.mode("append").option("compression", "zstd").parquet(path)


def scan(docs: DataFrame, *, path_column: str = "doc_id", text: str = "text", ledger_path: str | None = None, rules: str = RULES) -> DataFrame:
    """Per row of `docs`: the path column, blob (SHA-256), n_assign, n_access, n_hex and spans ('kind:start:end,...').

    Null text is the empty blob; a null path stays null; repeated rows each get their row. Without `ledger_path` a
    fresh ledger is begun in the shared folder."""
    spark = docs.sparkSession
    at = ledger_path or shared_dir(spark, "secrets-ledger")
    update(docs, at, text=text, rules=rules)
    paths = docs.select(F.col(path_column).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("blob"))
    found = ledger(spark, at).where(F.col("rules") == rules).drop("rules")
    # Two updates at a time may both append a blob; their findings are the same, and one counts. Without such blobs the
    # join reads the ledger as it is and may split the rows of a blob that many paths hold.
    if not found.groupBy("blob").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["blob"])
    return paths.join(found, "blob").select(F.col("path").alias(path_column), "blob", "n_assign", "n_access", "n_hex", "spans")


def report(docs: DataFrame, **options) -> DataFrame:
    """scan() with base_sha256, the digest of the base spans; this method adds no spans of its own."""
    out = scan(docs, **options)
    return out.select(*(c for c in out.columns if c not in ("blob", "spans")), F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


def brute_force(text: str | None) -> tuple:
    """The figures of one text by the rules as stated, without their shortcuts; for tests."""
    text = text or ""
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", _ASSIGN, 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32))):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
    return (*(sum(x[3] == k for x in out) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined)
