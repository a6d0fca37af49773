"""The learned vocabulary as one JSON document, read into tables by a fixed schema and written from them in order.

The document holds one object a section, whose keys are in order of first sight: that order decides between names that
are equally close, so tables carry it as `ord`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BRAND = ("canonical string", "aliases array<string>", "groups array<string>", "support bigint", "linkage string", "confidence double", "attested boolean", "mean_position double", "rejection string")
_PRODUCT = ("canonical string", "support bigint", "groups array<string>", "variants array<string>")

#: Sections in their order: the key's column, and the fields of an entry, one field named `=` for a plain value, or `name:`
#: for an object of numbers by name.
SECTIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "brands": ("key", _BRAND),
    "brand_candidates": ("key", _BRAND),
    "alias_index": ("alias", ("=canonical string",)),
    "product_types": ("key", _PRODUCT),
    "series": ("name", ("=n bigint",)),
    "groups": ("grp", ("name string", "code string")),
    "unknown_units": ("suffix", ("=n bigint",)),
    "observed_families": ("canonical", ("family:n bigint",)),
    "value_vocab": ("kind", ("value:n bigint",)),
    "stats": ("name", ("=value double",)),
}


def _kind(fields: tuple[str, ...]) -> str:
    if fields[0].startswith("="):
        return fields[0].split(" ", 1)[1]
    if ":" in fields[0].split(" ")[0]:
        return f"map<string,{fields[0].split(' ', 1)[1]}>"
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields) + ">"


SCHEMA = "n_rows bigint, " + ", ".join(f"{name} map<string,{_kind(fields)}>" for name, (_, fields) in SECTIONS.items())


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each section (ord, the key, its fields), and `n_rows` (n_rows). Sections that the document lacks are
    empty tables; what it has beside them is left out; a document that is no JSON raises."""
    whole = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = {"n_rows": whole.select(F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))}
    for name, (key, fields) in SECTIONS.items():
        entries = whole.select(F.posexplode(F.map_entries(name)).alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), F.col("e.key").alias(key), F.col("e.value").alias("v"))
        first = fields[0].split(" ")[0]
        if first.startswith("="):
            out[name] = entries.withColumnRenamed("v", first[1:])
        elif ":" in first:
            out[name] = entries.select("ord", key, F.explode("v").alias(*first.split(":")))
        else:
            out[name] = entries.select("ord", key, "v.*")
    return out


def _json(value: Column) -> Column:
    """A value as JSON text."""
    inside = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def write_vocabulary(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the document, one entry a line, to one file in the folder `path`: lines are sorted by all tasks, and the last
    one only concatenates them. `tables` are as read_vocabulary() gives them; sections not among them are empty."""
    spark = next(iter(tables.values())).sparkSession
    line = "part int, ord long, line string"
    fixed = [(-2, 0, "{"), (10_000, 0, "}")]
    parts = [tables["n_rows"].select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit('"n_rows": '), F.col("n_rows").cast("string"), F.lit(",")).alias("line"))] if "n_rows" in tables else []
    for i, (name, (key, fields)) in enumerate(SECTIONS.items()):
        fixed += [(10 * i, -1, f'"{name}": {{'), (10 * i + 9, 0, "}" + "," * (i + 1 < len(SECTIONS)))]
        if name not in tables:
            continue
        df, first = tables[name], fields[0].split(" ")[0]
        if first.startswith("="):
            made = df.select("ord", F.col(key).alias("k"), _json(F.col(first[1:])).alias("v"))
        elif ":" in first:
            inner = F.map_from_entries(F.sort_array(F.collect_list(F.struct(*first.split(":")))))
            made = df.groupBy(F.col(key).alias("k")).agg(F.min("ord").alias("ord"), inner.alias("m")).select("ord", "k", _json(F.col("m")).alias("v"))
        else:
            made = df.select("ord", F.col(key).alias("k"), _json(F.struct(*(f.split(" ")[0] for f in fields))).alias("v"))
        lead = made.agg(F.min(F.struct("ord", "k")).alias("lead"))  # one row
        said = F.concat(F.when(F.struct("ord", "k") == F.col("lead"), "").otherwise(","), _json(F.col("k")), F.lit(": "), F.col("v"))
        parts.append(made.join(F.broadcast(lead)).select(F.lit(10 * i + 1).alias("part"), "ord", said.alias("line")))
    lines = reduce(DataFrame.unionByName, parts, spark.createDataFrame(fixed, line))
    lines.orderBy("part", "ord", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
