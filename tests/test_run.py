"""Sources, sinks, the proposer, evaluation and the command line, on small inputs."""

import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from gristmill import __main__ as command
from gristmill.operators import cells as C
from gristmill.operators import propose, render, score
from gristmill.plans import enrich
from gristmill.sources import catalogue, scratch, sheets, sinks
from gristmill.sources.rules import Rules, Slot, demo

HEADER = "Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf\n"


def lines(n, start=0):
    return "".join(f'PN{i},"PN{i} {"large bolt red" if i % 2 else "anvil 3""x1/8"""} steel",Acme,,{"Acme" if i % 3 else ""},Acme Tools ({1000 + i % 4})\n' for i in range(start, start + n))


def test_numbers_follow_files_and_lines(spark, tmp_path):
    """Files of very unlike sizes, so that a scan does not take them in the order of their names."""
    sizes = (3, 400, 1, 50)
    (tmp_path / "in").mkdir()
    for k, n in enumerate(sizes):
        (tmp_path / "in" / f"part-{k}.csv").write_text(HEADER + lines(n, 1000 * k))
    rows = catalogue.read_csv(spark, str(tmp_path / "in")).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(sum(sizes)))
    assert [r["Mfg_Part_Num"] for r in rows] == [f"PN{1000 * k + i}" for k, n in enumerate(sizes) for i in range(n)]


def test_payload(spark):
    out = catalogue.read_payload(spark, ("﻿" + HEADER + lines(5) + "\n" + "short\n").encode(), limit=6).orderBy("row_index").collect()
    assert [r["Mfg_Part_Num"] for r in out] == [*(f"PN{i}" for i in range(5)), "short"] and out[5]["Part_Manuf"] == ""


def test_jsonl_names_the_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nnot json\n{"a": 3}\n')
    with pytest.raises(ValueError, match="line 4"):
        catalogue.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert [(r["line"], r["text"]) for r in catalogue.jsonl_faults(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [(4, "not json")]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in catalogue.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int").collect() if r["a"]) == [1, 2]


def test_sheets_go_on(spark, tmp_path):
    cells = spark.createDataFrame([(i, "A", str(i), "input_copy", "r", 1.0) for i in range(7)], C.CELL)
    verdict = spark.createDataFrame([(i, 0.3 if i == 2 else 0.9, i == 5) for i in range(7)], "row_index long, confidence double, needs_review boolean")
    n = sinks.write_delivery_xlsx(cells, verdict, ["A"], str(tmp_path / "x"), sheet_rows=4)
    books = [zipfile.ZipFile(p) for p in sorted((tmp_path / "x").iterdir())]
    parts = [ElementTree.fromstring(b.read("xl/worksheets/sheet1.xml")) for b in books]
    rows = [[(c.get("s"), "".join(c.itertext())) for c in row.iter(sheets._tag("c"))] for part in parts for row in part.iter(sheets._tag("row"))]
    assert n == 7 and len(books) >= 3 and rows.count([("1", "A")]) == len(books)
    assert all(len(list(part.iter(sheets._tag("row")))) <= 4 for part in parts)
    assert [r[0] for r in rows if r != [("1", "A")]] == [(None, "0"), (None, "1"), ("3", "2"), (None, "3"), (None, "4"), ("2", "5"), (None, "6")]
    back = catalogue.read_input(spark, str(tmp_path / "x" / "*.xlsx")).orderBy("row_index").collect()
    assert [tuple(r) for r in back] == [(i, str(i)) for i in range(7)]



SLOTS = (Slot("Color", "lov", lov=("Red", "Blue")), Slot("Width", "measure", family="length", lo=1, hi=10), Slot("Pack Quantity", "count", lo=1, hi=5), Slot("Note", "text"), Slot("Additional Information", "additional"))


def test_proposals_are_checked(spark):
    rules = Rules((), {"generic": SLOTS})
    slot = "struct<label:string,value:string,uom:string,kind:string,source:string,rule:string,confidence:double>"
    blank = [(s.label, "", "", s.kind, "", "", 0.0) for s in SLOTS]
    filled = [(s.label, "kept", "", s.kind, "regex_extract", "x", 0.9) for s in SLOTS]
    rows = spark.createDataFrame([(0, "a", None, "generic", blank), (1, "b", None, "generic", blank), (2, "c", None, "generic", filled), (3, "d", None, "other", blank), (4, "e", None, "generic", blank)], f"row_index long, body string, classpath string, contract string, slots array<{slot}>")
    replies = {
        "a": {"attributes": {"Color": "Red", "Width": {"value": "3", "uom": "inches"}, "Pack Quantity": "9", "Nothing": "x"}, "marketing_description": " Fine. "},
        "b": {"attributes": {"Color": "Mauve", "Width": {"value": "3", "uom": "lb"}, "Note": "N/A", "Additional Information": "no"}},
        "d": {"attributes": {"Color": "Blue"}},
    }

    def client(request):
        said = json.loads(request)["description"]
        if said == "e":
            raise OSError("gone")
        return "Sure:\n```json\n" + json.dumps(replies[said]) + "\n```"

    out = {r["row_index"]: r for r in propose.proposed(rows, rules, client).collect()}
    value = lambda i, label: next((s["value"], s["uom"], s["source"]) for s in out[i]["slots"] if s["label"] == label)
    assert value(0, "Color") == ("Red", "", "llm") and value(0, "Width")[0] == "3" and value(0, "Width")[2] == "llm" and value(0, "Pack Quantity")[0] == ""
    assert out[0]["marketing"] == "Fine." and out[1]["marketing"] == ""
    assert all(s["value"] == "" for s in out[1]["slots"]) and {(o["label"], o["outcome"]) for o in out[1]["outcomes"]} == {("Color", "not in list"), ("Width", "out of bounds")}
    assert all(s["value"] == "kept" for s in out[2]["slots"]) and value(3, "Color") == ("Blue", "", "llm") and all(s["value"] == "" for s in out[4]["slots"])
    told = propose.stats(propose.proposed(rows, rules, client)).first()
    assert tuple(told) == (3, 1, 2, 1)
    none = propose.proposed(rows, rules, None)
    assert none.drop("marketing", "outcomes").exceptAll(rows).count() == 0 and tuple(propose.stats(none).first()) == (0, 0, 0, 0)


def test_client_is_off_unless_named():
    assert propose.build(propose.Config.from_env({})) is None and not propose.probe(None)
    assert propose.Config.from_env({"PROPOSER_MODEL": "m", "PROPOSER_MAX_CALLS": "3"}).max_calls == 3
    assert propose.probe(lambda r: "{}") and not propose.probe(lambda r: 1 / 0)


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text(HEADER + lines(40))
    (tmp_path / "header.csv").write_text("Mfg_Part_Num,BRAND_NAME,SHORT_DESC\n")
    earlier = scratch.named()
    payload = command.main([str(tmp_path / "in.csv"), "--out", str(tmp_path / "out"), "--limit", "24", "--schema", str(tmp_path / "header.csv")])
    assert scratch.named() == earlier
    for sheet in ("delivery", "workbooks/*.xlsx"):
        delivered = catalogue.read_input(spark, str(tmp_path / "out" / sheet)).orderBy("row_index")
        assert delivered.columns == ["row_index", "Mfg_Part_Num", "BRAND_NAME", "SHORT_DESC"]
        assert [r["Mfg_Part_Num"] for r in delivered.collect()] == [f"PN{i}" for i in range(24)]
    assert payload["run"]["rows"] == 24 and sum(payload["triage"].values()) == 24
    for name in ("provenance", "review", "vocabulary/brands", "report.json", "report.md", "cells"):
        assert (tmp_path / "out" / name).is_dir()
    cells = spark.read.parquet(str(tmp_path / "out" / "cells"))
    implied = cells.where("rule like 'taxonomy:implied-by:%'").select("value").distinct().collect()
    assert {r["value"] for r in implied} <= {"Steel"}
    gold = spark.createDataFrame([(0, "PN1", "wrong", ""), (1, "PN2", "", "")], "row_index long, Mfg_Part_Num string, SHORT_DESC string, Dept string")
    verdict = spark.read.parquet(str(tmp_path / "out" / "verdicts"))
    told = score.evaluate(cells, verdict, gold)
    assert told["channels"] == {"SHORT_DESC": "0 of 1"} and told["fields"]["SHORT_DESC"]["exact"] == 0
    queue = score.review_queue(score.queue_rows(cells, verdict))
    assert queue.columns == ["row_index", "confidence", "Mfg_Part_Num", "Part_Desc", "BRAND_NAME", "MANUFACTURER_NAME", "Classpath", "SHORT_DESC", "INVOICE_DESC", "invoice_chars", "MOBILE_DESC", "mobile_chars", "review_reasons"]


def test_build_refuses_other_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        enrich.build(spark, str(tmp_path / "in.csv"))


def test_blank_record_and_rescoring(spark):
    schema = C.Schema(["A", "B"])
    assert tuple(spark.range(1).select(*schema.blank().values()).first()) == ("", "")
    made = spark.range(1).select(C.rescored(C.cell("A", F.lit("x"), "llm", "r", 0.5), F.lit(1.7)).alias("c")).first()["c"]
    assert made["confidence"] == 1.0 and made["value"] == "x"
    assert demo().contract("hardware")


def test_packing_is_told(spark):
    packed = render.pack(F.lit("head"), F.array(F.lit("a"), F.lit("far too long to fit"), F.lit("b")), lo=20, hi=20)
    assert spark.range(1).select(render.audit(packed, 20)).first()[0] == "2 of 3 candidates used | dropped: 'far too long to fit' | window NOT satisfied"


def test_report_is_tables_in_order():
    as_json, as_text = sinks.report({"triage": {"auto": 1}, "fields": {"Dept": {"compared": 2, "exact": 1}}, "run": {"a|b": 3}, "reasons": {}, "seconds": 2, "notes": ["one", "two"]})
    assert json.loads(as_json)["fields"]["Dept"]["exact"] == 1
    assert as_text.split("\n")[0] == "# Enrichment report" and "- **seconds**: 2" in as_text
    assert as_text[as_text.index("## ") :] == (
        "## Run\n\n| Metric | Value |\n|---|---|\n| a\\|b | 3 |\n\n## Triage\n\n| Bucket | Rows |\n|---|---|\n| auto | 1 |\n\n"
        "## Fields\n\n| Item | compared | exact |\n|---|---|---|\n| Dept | 2 | 1 |\n\n## Notes\n\n- one\n- two\n"
    )
