"""Workbooks (.xlsx) as tables: tasks read and write whole workbooks, no row passes through the driver.

A workbook is a zip of XML parts and cannot be split, so one is one task's work, streamed: a worksheet has 1,048,576 rows
at most, and a table of more is many workbooks in one folder. Only what a flat table needs is read and written: values of
the first worksheet, a header, a tint a row.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a worksheet, characters of a cell, and what the file format calls its parts.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Number formats that show a date or a time, and the day from which days are counted.
DATE_FORMATS, DAY_ZERO = (*range(14, 23), *range(45, 48)), datetime(1899, 12, 30)
#: Fills of a header and of rows that a person must see or that may not go out.
TINTS = {"header": "1F2937", "review": "FEF3C7", "blocked": "FEE2E2"}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder's URI or absolute local name; Arrow has other names than Hadoop for the same stores."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("wasb://", "abfs://")):
        path = arrow + path.removeprefix(hadoop) if path.startswith(hadoop) else path
    return fs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it; a local one without."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "/", whole)


# Reading


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _text(node) -> str:
    """The text of a string: its runs, without phonetic ones; _xHHHH_ is a character that XML cannot hold."""
    if node is None:
        return ""
    runs = [node] if node.tag == _tag("t") else [t for part in node if part.tag in (_tag("t"), _tag("r")) for t in part.iter(_tag("t"))]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in runs))


def _elements(part, name: str) -> Iterator:
    """The part's elements of that name in turn; each is forgotten when the next is read."""
    events = ElementTree.iterparse(part, events=("start", "end"))
    _, root = next(events)
    for event, node in events:
        if event == "end" and node.tag == _tag(name):
            yield node
            root.clear()
            node.clear()


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_tag('sheets')}/{_tag('sheet')}")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(f"{{{RELATIONS}}}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show their number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
    own = {int(f.get("numFmtId")) for f in styles.iter(_tag("numFmt")) if re.search("[dmyhs]", bare(f.get("formatCode", "")))}
    formats = styles.find(_tag("cellXfs"))
    return {i for i, f in enumerate(() if formats is None else formats) if int(f.get("numFmtId", 0)) in own.union(DATE_FORMATS)}


def _column(reference: str) -> int:
    """0 for 'A7', 26 for 'AA7'."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell, strings: list[str], dates: set[int]) -> str | None:
    kind, raw = cell.get("t", "n"), cell.findtext(_tag("v"))
    if kind == "inlineStr":
        return _text(cell.find(_tag("is")))
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return str(raw == "1")
    if kind != "n":
        return raw
    number = float(raw) if re.search("[.eE]", raw) else int(raw)
    return str(DAY_ZERO + timedelta(days=number)) if int(cell.get("s", 0)) in dates else str(number)


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """The first worksheet's rows from its first, rows that the file leaves out as empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = [], _date_styles(book)
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                strings = [_text(s) for s in _elements(part, "si")]
        at = 0
        with book.open(_first_sheet(book)) as part:
            for row in _elements(part, "row"):
                number = int(row.get("r", at + 1))
                yield from ([] for _ in range(at + 1, number))
                at, values = number, []
                for cell in row.iter(_tag("c")):
                    place = _column(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (place + 1 - len(values))
                    values[place] = _value(cell, strings, dates)
                yield values


def _header(rows: Iterator[list[str | None]]) -> list[str]:
    return [(name or "").strip() for name in next(rows, [])]


def read(spark: SparkSession, path: str, batch: int = 5_000) -> DataFrame:
    """row_index and, as strings, the columns of the first worksheet of a workbook, or of all workbooks of a folder, which
    follow each other by name. Rows that are all null go, but keep their number; null is ''; columns without a name go;
    of equal names the last counts; a column that a workbook lacks is ''. Tasks parse whole workbooks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content")

    def heads(batches):
        for b in batches:
            told = [(p, i, n) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist()) for i, n in enumerate(_header(rows_of(c))) if n]
            columns = list(zip(*told)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["path", "pos", "name"])

    found = files.mapInArrow(heads, "path string, pos int, name string").groupBy("name").agg(F.min(F.struct("path", "pos")).alias("first"))
    names = [r["name"] for r in found.orderBy("first").collect()]  # one row a column

    def parsed(batches):
        kinds = [pa.string(), pa.int64(), *(pa.string() for _ in names)]
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                rows = rows_of(content)
                place = {n: i for i, n in enumerate(_header(rows))}
                places = [place.get(n) for n in names]
                held, last = [], -1
                for last, values in enumerate(rows):
                    if any(v is not None for v in values):
                        held.append((name, last, *(values[p] if p is not None and p < len(values) and values[p] is not None else "" for p in places)))
                    if len(held) == batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["_file", "_at", *names])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["_file", "_at", *names])

    schema = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_at", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    rows = files.mapInArrow(parsed, schema)
    sizes = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    order = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    begins = sizes.select("_file", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return rows.join(begins, "_file").select((F.col("_before") + F.col("_at")).alias("row_index"), *(F.col(_quoted(n)) for n in names))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Writing


def _safe(value: str) -> str:
    """Text as XML: what XML cannot hold, and what looks like its replacement, as _xHHHH_."""
    value = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", value)
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", value))


def _letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _styles() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{rgb}"/></patternFill></fill>' for rgb in TINTS.values())
    styled = "".join(f'<xf fontId="{int(name == "header")}" fillId="{i}" borderId="0" numFmtId="0" applyFill="1" applyFont="1"/>' for i, name in enumerate(TINTS, 2))
    fonts = '<fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
    plain = '<fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    return f'<styleSheet xmlns="{MAIN}">{fonts}{plain}{fills}</fills><borders count="1"><border/></borders><cellXfs count="4"><xf fontId="0" fillId="0" borderId="0" numFmtId="0"/>{styled}</cellXfs></styleSheet>'


class Workbook:
    """A workbook of one worksheet, written row by row into a stream that need not be seekable."""

    def __init__(self, stream, headers: list[str], sheet: str = "Delivery Format"):
        self.stream, self.letters, self.at = stream, [_letters(i) for i in range(len(headers))], 0
        self.book = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        link = f"{RELATIONS}/"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            + "".join(f'<Override PartName="/xl/{p}" ContentType="{KINDS}.{k}+xml"/>' for p, k in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("styles.xml", "styles")))
            + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{link}officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{link}worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{link}styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": _styles(),
        }
        for name, xml in parts.items():
            self.book.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{xml}')
        self.part = self.book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        frozen = '<pane xSplit="1" ySplit="1" topLeftCell="B2" activePane="bottomRight" state="frozen"/>'
        self._put(f'<worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0">{frozen}</sheetView></sheetViews><sheetData>')
        self.row(headers, "header")

    def _put(self, xml: str) -> None:
        self.part.write(xml.encode("utf-8"))

    def row(self, values, tone: str = "") -> None:
        self.at += 1
        style = f' s="{list(TINTS).index(tone) + 1}"' if tone else ""
        made = []
        for letters, value in zip(self.letters, values):
            if value and len(value) > CELL_CHARS:
                raise ValueError(f"row {self.at}, column {letters}: a cell holds {CELL_CHARS} characters, the value has {len(value)}")
            if value:
                made.append(f'<c r="{letters}{self.at}"{style} t="inlineStr"><is><t xml:space="preserve">{_safe(value)}</t></is></c>')
            elif tone:
                made.append(f'<c r="{letters}{self.at}"{style}/>')
        self._put(f'<row r="{self.at}">{"".join(made)}</row>')

    def close(self) -> None:
        self._put("</sheetData></worksheet>")
        self.part.close()
        self.book.close()
        self.stream.close()


def _task(folder: str, headers: list[str], most: int) -> Callable:
    """Writes a partition's rows (headers in order, then the tone) as workbooks of at most `most` rows; tells each one's
    final name, the attempt's name and its rows. Names carry the attempt, so a repeated task harms nothing."""

    def write(batches):
        task, told, book = TaskContext.get(), [], None
        store, top = _store(folder)

        def begun():
            final = f"part-{task.partitionId():06d}-{len(told):05d}.xlsx"
            name = f"{task.taskAttemptId()}-{final}"
            told.append([final, name, 0])
            return Workbook(store.open_output_stream(f"{top}/{name}"), headers)

        for batch in batches:
            for *values, tone in zip(*(c.to_pylist() for c in batch.columns)):
                if book is None:
                    book = begun()
                book.row(values, tone)
                told[-1][2] += 1
                if told[-1][2] == most:
                    book.close()
                    book = None
        if book is not None:
            book.close()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told]) for i in range(3)], ["final", "name", "n"])

    return write


def write(rows: DataFrame, headers: list[str], path: str, key: str = "row_index", tone: str | None = None, sheet_rows: int = SHEET_ROWS) -> int:
    """The rows as a folder of workbooks in the order of `key`, each under the header and with at most `sheet_rows` rows,
    the header's included; returns the number of rows. `tone` names a column of '', 'review' or 'blocked'.

    Rows are dealt by ranges of the key; each task writes its own workbooks beside the folder, and those of the attempts
    that counted are moved into it. `path` is one that all executors can write; what it holds goes."""
    most = sheet_rows - 1
    if most < 1:
        raise ValueError("a worksheet needs a row beside the header")
    path = _qualified(rows.sparkSession, path)
    store, top = _store(path)
    beside = f"{path.rstrip('/')}.attempts-{uuid.uuid4().hex}"
    attempts = _store(beside)[1]
    store.create_dir(attempts, recursive=True)
    try:
        parts = -(-rows.count() // most) or 1
        dealt = rows.repartitionByRange(parts, key).sortWithinPartitions(key) if parts > 1 else rows.repartition(1).sortWithinPartitions(key)
        flat = dealt.select(*(F.coalesce(F.col(_quoted(h)).cast("string"), F.lit("")).alias(f"c{i}") for i, h in enumerate(headers)), (F.lit("") if tone is None else F.coalesce(tone, F.lit(""))).alias("tone"))
        made = flat.mapInArrow(_task(beside, list(headers), most), "final string, name string, n long").collect()  # one row a workbook
        if not made:  # an empty table is a header
            made = [{"name": "empty.xlsx", "final": "part-000000-00000.xlsx", "n": 0}]
            Workbook(store.open_output_stream(f"{attempts}/empty.xlsx"), headers).close()
        if store.get_file_info(top).type != fs.FileType.NotFound:
            store.delete_dir(top)
        store.create_dir(top, recursive=True)
        for m in made:
            store.move(f"{attempts}/{m['name']}", f"{top}/{m['final']}")
    finally:
        store.delete_dir(attempts)
    return sum(m["n"] for m in made)
