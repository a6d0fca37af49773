"""Catalogue tables: CSV, XLSX and JSON-lines scans, and a six-column view over order tables."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from . import sheets

#: The input contract over `part` and `supplier`: one text for any SQL engine.
BRIDGE = """
select p_partkey as row_index,
       concat('PN', lpad(cast(p_partkey as string), 6, '0')) as Mfg_Part_Num,
       concat('PN', lpad(cast(p_partkey as string), 6, '0'), ' ', p_name, ' ', cast(p_size as string), '"x', cast(2 * (p_partkey % 4) + 1 as string), '/8" ', p_type,
              case when p_partkey % 7 = 0 then ' - Display Only' when p_partkey % 7 = 1 then ' 6pc' else '' end) as Part_Desc,
       case when p_partkey % 5 = 0 then p_brand else '-- Unbranded --' end as E1_Brand,
       '-- No Unilog Brand --' as Unilog_Brand,
       case when p_partkey % 4 = 0 then p_brand else '-- No DIB Brand --' end as DIB_Brand,
       concat(s_name, ' (', lpad(cast(s_suppkey as string), 4, '0'), ')') as Part_Manuf
from part join supplier on s_suppkey = p_partkey % (select count(*) from supplier)
"""


#: Rows of a part of dealt() at most, about.
DEALT = 50_000


def dealt(rows: DataFrame, key: str, n: int, most: int = DEALT) -> DataFrame:
    """The n rows by a key over as many partitions as exchanges have, more where a part would hold more than `most` rows.
    Tables of millions of rows may be one split of a file, and all work on its rows one task."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // most)), key)


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the tables: joined first, dealt by row while they are narrow, texts made after that."""
    part, supplier = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("part", "supplier"))
    made, source = BRIDGE.replace("(select count(*) from supplier)", str(supplier.count())).split("\nfrom ")
    joined = spark.sql("select p_partkey, p_name, p_size, p_type, p_brand, s_name, s_suppkey from " + source.replace("part join supplier", "{part} join {supplier}"), part=part, supplier=supplier)
    return spark.sql(made + " from {joined}", joined=dealt(joined, "p_partkey", part.count()))


def headers(spark: SparkSession, path: str) -> list[str]:
    """The first line of a CSV file, trimmed, without a byte-order mark."""
    line = spark.read.option("lineSep", "\n").text(path).first()
    return [h.strip() for h in next(csv.reader(io.StringIO((line[0] if line else "").lstrip("﻿"))))]


def in_files(df: DataFrame) -> DataFrame:
    """df, read from files, with _file, _line (from 0, as the file's lines go) and _before (rows of earlier files by name).

    Files may be read in splits: a first pass counts the rows of each split, sums over a file's splits tell where each
    begins, and numbering is a join to one row a split. No task holds the rows of a file."""
    at = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_from", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id())
    splits = at.groupBy("_file", "_from").agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_first"))
    earlier = lambda w: F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("_file").agg(F.sum("_rows").alias("_rows"))
    files = files.select("_file", earlier(Window.partitionBy(F.lit(0)).orderBy("_file")).alias("_before"))  # one row a file
    begins = splits.select("_file", "_from", (earlier(Window.partitionBy("_file").orderBy("_from")) - F.col("_first")).alias("_shift"))
    return at.join(begins.join(files, "_file"), ["_file", "_from"]).select(*df.columns, "_file", (F.col("_n") + F.col("_shift")).alias("_line"), "_before")


def in_file_order(df: DataFrame) -> DataFrame:
    """df with row_index: rows as the files' names and lines go."""
    return in_files(df).select((F.col("_before") + F.col("_line")).alias("row_index"), *df.columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_index and the file's columns as strings, names trimmed, null as ''. Row numbers follow the file's order."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    numbered = in_file_order(raw)
    return numbered.toDF("row_index", *(c.lstrip("\ufeff").strip() for c in raw.columns)).na.fill("")


def read_payload(spark: SparkSession, payload: bytes, limit: int | None = None) -> DataFrame:
    """An uploaded CSV file, as read_csv() reads it; `limit` keeps the first rows. The payload is the driver's already."""
    table = [r for r in csv.reader(io.StringIO(payload.decode("utf-8-sig"))) if r]
    names = [n.strip() for n in table[0]] if table else []
    rows = [(i, *(r + [""] * (len(names) - len(r)))[: len(names)]) for i, r in enumerate(table[1:][:limit])]
    return spark.createDataFrame(rows, T.StructType([T.StructField("row_index", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]))


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder, or a workbook; `path/*.xlsx` names the workbooks of a folder."""
    return sheets.read(spark, path) if path.lower().endswith((".xlsx", ".xlsm")) else read_csv(spark, path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.select("row_index", *(F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns[1:]))


def jsonl_faults(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1), text of the lines that are no JSON objects of the schema; blank lines count as lines only."""
    lines = in_files(spark.read.text(path))
    placed = lines.select(F.col("_file").alias("file"), (F.col("_line") + 1).alias("line"), "value").where(F.trim("value") != "")
    told = placed.withColumn("j", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return told.where("j is null or j._corrupt_record is not null").select("file", "line", F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones go. `strict` raises on a bad line and names it, else `_corrupt_record` holds it."""
    if strict:
        bad = jsonl_faults(spark, path, schema).orderBy("file", "line").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['file']}, line {bad[0]['line']}: {bad[0]['text'][:80]!r} is no JSON object")
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key and response of an append-only reply log: the last line of a key counts."""
    return last_replies(spark.read.schema("key string, response string, line_no long").json(path))


def last_replies(rows: DataFrame) -> DataFrame:
    """key, response of (key, response, line_no): the last line of each key."""
    return rows.groupBy("key").agg(F.max_by("response", "line_no").alias("response"))


def require_columns(df: DataFrame) -> list[str]:
    return [c for c in fixed.PASSTHROUGH if c not in df.columns]
