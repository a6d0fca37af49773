"""Sinks: the delivery sheet, provenance lines, the review queue and the run report."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import score
from . import sheets


def write_delivery_csv(cells: DataFrame, headers: list[str], path: str, strict: bool = True) -> None:
    """The wide sheet in header order, rows in theirs over the part files; `strict` refuses rows with structural faults."""
    wide = C.wide(cells, headers)
    if strict:
        bad = wide.select(F.explode(C.Schema(headers).problems(wide)).alias("p")).limit(1).collect()
        if bad:
            raise ValueError(bad[0]["p"])
    wide.orderBy("row_index").drop("row_index").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_delivery_xlsx(cells: DataFrame, verdict: DataFrame, headers: list[str], path: str, sheet_rows: int = sheets.SHEET_ROWS, tinted: bool = True) -> int:
    """The wide sheet as a folder of workbooks, rows tinted by verdict, in order over the files; returns its number of rows.
    Tasks write them: rows that a worksheet cannot take go on in the next workbook, under the same header."""
    tone = verdict.select("row_index", score.row_tone(F.col("confidence"), F.col("needs_review")).alias("_tone"))
    return sheets.write(C.wide(cells, headers).join(tone, "row_index", "left"), headers, path, tone="_tone" if tinted else None, sheet_rows=sheet_rows)


def write_provenance(cells: DataFrame, verdict: DataFrame, path: str) -> None:
    """One JSON object a row: its verdict and every cell worth keeping."""
    told = [c for c in ("header", "value", "source", "rule", "confidence", "detail", "evidence") if c in cells.columns]
    kept = C.audit(cells).groupBy("row_index").agg(F.sort_array(F.collect_list(F.struct(*told))).alias("cells"))
    kept.join(verdict, "row_index").write.mode("overwrite").json(path)


def write_review_queue(rows: DataFrame, path: str) -> None:
    """The queue in its order, over the part files."""
    score.review_queue(rows).write.mode("overwrite").option("header", True).csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines of training rows, a folder for each value of `split`."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


#: The report's sections by name, with the heads of their columns; other parts are titled by their name.
SECTIONS = {
    "run": ("Run", "Metric", "Value"),
    "compliance": ("Compliance", "Metric", "Value"),
    "sources": ("Cells by source", "Source", "Cells"),
    "blanks": ("Blanks by reason", "Reason", "Cells"),
    "triage": ("Triage", "Bucket", "Rows"),
    "reasons": ("Top review reasons", "Reason", "Rows"),
    "vocabulary": ("Vocabulary induced", "Item", "Count"),
}


def _table(title: str, heads: tuple[str, ...], rows: list[tuple]) -> list[str]:
    said = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return [f"## {title}", "", said(heads), "|" + "---|" * len(heads), *map(said, rows), ""]


def report(payload: dict) -> tuple[str, str]:
    """(JSON, Markdown) of a run's small figures: the known sections in their order, then the others, each a table (of
    several columns where its values are dicts); `notes` as a list at the end. Empty sections are left out."""
    stamped = {"generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds")} | payload
    plain = {k: v for k, v in stamped.items() if not isinstance(v, dict) and k != "notes"}
    lines = ["# Enrichment report", "", *(f"- **{k}**: {v}" for k, v in plain.items()), ""]
    for name in [*(k for k in SECTIONS if k in stamped), *(k for k in stamped if k not in SECTIONS)]:
        part = stamped[name]
        if not isinstance(part, dict) or not part:
            continue
        title, *heads = SECTIONS.get(name, (name.replace("_", " ").capitalize(), "Item", "Value"))
        first = next(iter(part.values()))
        if isinstance(first, dict):
            lines += _table(title, (heads[0], *first), [(k, *v.values()) for k, v in part.items()])
        else:
            lines += _table(title, tuple(heads), list(part.items()))
    if stamped.get("notes"):
        lines += ["## Notes", "", *(f"- {n}" for n in stamped["notes"]), ""]
    return json.dumps(stamped, indent=2, ensure_ascii=False), "\n".join(lines)
