"""Workbooks read and written by tasks, against what was put into them."""

import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.sources import catalogue, sheets

SHEET = f'<worksheet xmlns="{sheets.MAIN}"><sheetData>%s</sheetData></worksheet>'


def foreign(path, rows, shared=(), formats=()):
    """A workbook as other programs write it: shared strings, styles, the first sheet under a name of its own."""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{sheets.MAIN}" xmlns:r="{sheets.RELATIONS}"><sheets><sheet name="b" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{sheets.PACKAGE}/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/own.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", SHEET % '<row r="1"><c r="A1"><v>1</v></c></row>')
        book.writestr("xl/worksheets/own.xml", SHEET % rows)
        if shared:
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.MAIN}">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')
        if formats:
            own = "".join(f'<numFmt numFmtId="{i}" formatCode="{c}"/>' for i, c in formats)
            book.writestr("xl/styles.xml", f'<styleSheet xmlns="{sheets.MAIN}"><numFmts>{own}</numFmts><cellXfs><xf numFmtId="0"/>{"".join(f"""<xf numFmtId="{i}"/>""" for i, _ in formats)}<xf numFmtId="14"/></cellXfs></styleSheet>')


def test_kinds_of_cells(spark, tmp_path):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> Part_Desc </t></is></c><c r="D1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>5</v></c><c r="B2"><v>5.0</v></c><c r="C2"><v>9</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="3"><c r="A3" s="0"/></row>'
        '<row r="6"><c r="D6" t="str"><f>A1</f><v>made</v></c><c r="A6" s="3"><v>43831.5</v></c><c r="B6" s="1"><v>2</v></c></row>'
        '<row><c t="e"><v>#N/A</v></c><c s="2"><v>7</v></c></row>'
    )
    shared = ("<t>Mfg_Part_Num</t>", "<r><t>Fr</t></r><r><t>ee_x0041_</t></r><rPh><t>no</t></rPh>")
    foreign(tmp_path / "x.xlsx", rows, shared, ((164, "yyyy-mm"), (165, "0.00&quot;day&quot;")))
    out = catalogue.read_input(spark, str(tmp_path / "x.xlsx")).orderBy("row_index")
    assert out.columns == ["row_index", "Mfg_Part_Num", "Part_Desc", "FreeA"]
    assert [tuple(r) for r in out.collect()] == [(0, "5", "5.0", "True"), (4, "2020-01-01 12:00:00", "1900-01-01 00:00:00", "made"), (5, "#N/A", "7", "")]


def test_workbooks_of_a_folder_follow_each_other(spark, tmp_path):
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    foreign(tmp_path / "a.xlsx", f'<row r="1">{cell("A1", "p")}{cell("B1", "q")}</row><row r="2">{cell("A2", "1")}</row><row r="4">{cell("B4", "2")}</row>')
    foreign(tmp_path / "b.xlsx", f'<row r="1">{cell("A1", "q")}{cell("B1", "extra")}</row><row r="2">{cell("A2", "3")}{cell("B2", "4")}</row>')
    foreign(tmp_path / "c.xlsx", "")
    (tmp_path / "notes.txt").write_text("not a workbook")
    out = sheets.read(spark, str(tmp_path)).orderBy("row_index")
    assert out.columns == ["row_index", "p", "q", "extra"]
    assert [tuple(r) for r in out.collect()] == [(0, "1", "", ""), (2, "", "2", ""), (3, "", "3", "4")]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.text(st.characters(exclude_categories=("Cs",)), max_size=12), st.sampled_from(["", "_x0041_", " a\r\nb\t", "<&>\"'", "=1+1", "\x00\x1f", "7"])), max_size=12))
def test_round_trip(spark, tmp_path_factory, made):
    top = tmp_path_factory.mktemp("book")
    rows = spark.createDataFrame([(3 * i, a, b) for i, (a, b) in enumerate(made)], "row_index long, `a b` string, c string")
    headers = ["a b", "c", *(f"more {i}" for i in range(30))]
    wide = rows.select("*", *(F.lit("z" if i == 29 else "").alias(f"more {i}") for i in range(30)))
    assert sheets.write(wide, headers, str(top / "out"), sheet_rows=5) == len(made)
    back = sheets.read(spark, str(top / "out")).orderBy("row_index")
    assert back.columns == ["row_index", *headers]
    assert [(r["a b"], r["c"], r["more 0"], r["more 29"]) for r in back.collect()] == [(a, b, "", "z") for a, b in made]
    assert [p.name for p in top.iterdir()] == ["out"]


def test_a_fault_leaves_what_was_there(spark, tmp_path):
    one = spark.createDataFrame([(0, "x")], "row_index long, a string")
    sheets.write(one, ["a"], str(tmp_path / "out"))
    with pytest.raises(Exception, match="32767 characters"):
        sheets.write(one.withColumn("a", F.repeat("a", 40_000)), ["a"], str(tmp_path / "out"))
    assert [tuple(r) for r in sheets.read(spark, str(tmp_path / "out")).collect()] == [(0, "x")] and [p.name for p in tmp_path.iterdir()] == ["out"]
