"""Sources, sinks, the whole engine and its stream on small inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gristmill.operators import cells, score
from gristmill.plans import enrich
from gristmill.sources import catalogue, rules, sinks
from gristmill.streaming import enrich as streaming

DATA = "/root/testdata/sf0.001"


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes('﻿Mfg_Part_Num , Part_Desc\nA1,"14""x1/8"" Disc"\n\nB2,\nC3,"two\nlines"\n'.encode())
    rows = catalogue.read_csv(spark, str(path)).orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [(0, "A1", '14"x1/8" Disc'), (1, "B2", ""), (2, "C3", "two\nlines")]
    assert catalogue.headers(spark, str(path)) == ["Mfg_Part_Num", "Part_Desc"]


def test_jsonl_and_cache(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"key": "a", "response": "1", "line_no": 1}\n\n{"key": "a", "response": "2", "line_no": 2}\n')
    assert catalogue.read_cache(spark, str(tmp_path / "x.jsonl")).collect()[0]["response"] == "2"
    (tmp_path / "y.jsonl").write_text('{"a": 1}\nnot json\n')
    lenient = catalogue.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int", strict=False).collect()
    assert [r["_corrupt_record"] for r in lenient if r["_corrupt_record"]] == ["not json"]
    with pytest.raises(Exception):
        catalogue.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int").collect()


def test_line_numbers_of_split_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    bad = {"b": {1, 7, 900, 1999}, "a": {3, 600}}
    for name, numbers in bad.items():
        rows = [f"bad {name} {i} " + "x" * (i % 97) if i in numbers else "" if i % 50 == 0 else json.dumps({"a": i, "t": "y" * (i % 83)}) for i in range(1, 2001)]
        (folder / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        found = catalogue.jsonl_faults(spark, str(folder), "a int, t string").collect()
        assert {(r["file"].rsplit("/")[-1][0], r["line"]) for r in found} == {(n, i) for n, numbers in bad.items() for i in numbers}
        assert all(r["text"].startswith(f"bad {r['file'].rsplit('/')[-1][0]} {r['line']} ") for r in found)
        with pytest.raises(ValueError, match="a.jsonl, line 3:"):
            catalogue.read_jsonl(spark, str(folder), "a int, t string")
        order = catalogue.in_file_order(spark.read.text(str(folder))).orderBy("row_index").collect()
        lines = [x for n in "ab" for x in (folder / f"{n}.jsonl").read_text().splitlines()]
        assert [r["row_index"] for r in order] == list(range(4000)) and [r["value"] for r in order] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rules_round_trip(tmp_path):
    spec = {"categories": [{"classpath": "A > B", "must": ["b"], "implies": [["Material", "Steel"]]}], "contracts": {"generic": [{"label": "Color", "kind": "lov", "lov": ["Red"]}]}, "dimensions": {"generic": {"2": ["Width", "Length"]}}}
    (tmp_path / "r.json").write_text(json.dumps(spec))
    loaded = rules.load(str(tmp_path / "r.json"))
    assert loaded.categories[0].leaf == "B" and loaded.contract("none")[0].lov == ("Red",) and loaded.order("x", 2) == ("Width", "Length")


@pytest.fixture(scope="module")
def run(spark):
    rows = catalogue.bridge(spark, DATA).where("row_index < 60").persist()
    out, made, verdict, vocabulary = enrich.run(rows, rules.demo())
    return rows, out.persist(), made.persist(), verdict.persist(), vocabulary


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")
def test_rows_are_enriched_once_a_run(run):
    """Cells of all kinds and verdicts read the rows that a run has written; none makes them again."""
    for made in run[2:4]:
        leaves = made._jdf.queryExecution().analyzed().collectLeaves()
        read = [x.relation().location().rootPaths().mkString() for x in map(leaves.apply, range(leaves.size())) if x.nodeName().startswith("LogicalRelation")]
        assert read and all("/enriched-" in path for path in read)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")
def test_engine(spark, run, tmp_path):
    rows, out, made, verdict, vocabulary = run
    assert out.count() == rows.count() == verdict.count()
    assert out.where(F.length("INVOICE_DESC") > 40).count() == 0
    assert score.lov_violations(made.where("header = 'x'").select("row_index", F.col("header").alias("label"), "value"), rules.demo().lov_table(spark)).count() == 0
    headers = ["Mfg_Part_Num", "BRAND_NAME", "SHORT_DESC", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_UOM 1", "UPC"]
    sinks.write_delivery_csv(made.where(F.col("header").isin(headers)), headers, str(tmp_path / "sheet"))
    assert catalogue.read_csv(spark, str(tmp_path / "sheet")).columns == ["row_index", *headers]
    sinks.write_provenance(made, verdict, str(tmp_path / "provenance"))
    assert spark.read.json(str(tmp_path / "provenance")).count() == rows.count()
    # What a cell shows is in the text that it names.
    shown = made.where("evidence is not null").join(out.select("row_index", "body"), "row_index").select("evidence.*", "body").collect()
    assert shown and all(r["base"] == "body" and r["body"][r["start"] : r["end"]] == r["snippet"] for r in shown)
    assert made.where("source = 'not_derivable' and detail is null and rule like 'not-derivable:%'").count() == 0
    vocabulary.write(str(tmp_path / "vocabulary"))
    assert enrich.Vocabulary.read(spark, str(tmp_path / "vocabulary")).aliases.count() == vocabulary.aliases.count()
    as_json, as_text = sinks.report({"rows": 3, "triage": {"auto": 1}})
    assert json.loads(as_json)["rows"] == 3 and "| auto | 1 |" in as_text


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")
def test_stream_equals_batch(spark, run, tmp_path):
    rows, _, made, _, vocabulary = run
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.stream(source, rules.demo(), vocabulary, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    columns = ["row_index", "header", "value", "source"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert got.exceptAll(made.select(columns)).count() == 0 and made.select(columns).exceptAll(got).count() == 0


def test_schema_families():
    schema = cells.Schema([*(f"ATTRIBUTE_{x} {i}" for i in (1, 2, 3) for x in ("LABEL", "VALUE", "UOM")), "Ref URL 1", "Alternate Image 2"])
    assert schema.n_attributes == 3 and schema.families["ref_url"] == [1] and schema.families["alternate_image"] == [2]


def test_rows_of_one_split_are_work_of_many_tasks(spark):
    """The tables of a folder are one split each here; what is made of each row is dealt over all partitions, and over
    more where rows are many."""
    from gristmill.plans import queries

    for rows in (catalogue.bridge(spark, DATA), queries.channelled(spark, DATA), *queries._tokens(spark, DATA)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    many = catalogue.dealt(spark.range(1000), "id", 400_000)
    assert many.select(F.spark_partition_id().alias("p")).distinct().count() == 8
