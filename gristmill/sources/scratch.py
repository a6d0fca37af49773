"""Tables that a run writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has named and not dropped.
_named: list[str] = []


def named() -> list[str]:
    return list(_named)


def drop(spark: SparkSession, *folders: str) -> None:
    """Deletes folders; frames that read them can be used no more."""
    for path in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _named:
            _named.remove(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new name under spark.checkpoint.dir. Where no folder is named, a session on one machine gets a temporary one; a
    cluster, whose executors could not see that, is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        top = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    _named.append(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _named[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written in a folder() and read back: what uses it several times neither recomputes it nor carries its
    plan."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
