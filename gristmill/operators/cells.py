"""Output cells in long form: row_index, header, value, source, rule, confidence, detail (why, in words) and evidence
(the stretch of which text that shows it); the wide sheet is a pivot at the end."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

CELL = "row_index long, header string, value string, source string, rule string, confidence double"
EVIDENCE = "struct<base:string,start:int,end:int,snippet:string>"
#: Repeating families of output columns.
FAMILIES = {
    "attribute_label": r"^ATTRIBUTE_LABEL (\d+)$",
    "attribute_value": r"^ATTRIBUTE_VALUE (\d+)$",
    "attribute_uom": r"^ATTRIBUTE_UOM (\d+)$",
    "item_feature": r"^ITEM_FEATURES_(\d+)$",
    "ref_url": r"^Ref URL (\d+)$",
    "alternate_image": r"^Alternate Image (\d+)$",
}


class Schema:
    """The output header, read at run time, and the families in it."""

    def __init__(self, headers: list[str]):
        self.headers = tuple(headers)
        self.families = {f: sorted(int(m[1]) for h in headers if (m := re.match(p, h))) for f, p in FAMILIES.items()}

    @property
    def n_attributes(self) -> int:
        return len(set.intersection(*(set(self.families[f]) for f in ("attribute_label", "attribute_value", "attribute_uom"))))

    def attribute_headers(self, slot: int) -> tuple[str, str, str]:
        return tuple(f"ATTRIBUTE_{x} {slot}" for x in ("LABEL", "VALUE", "UOM"))

    def blank(self) -> dict[str, Column]:
        """An empty record: every header with ''."""
        return {h: F.lit("").alias(h) for h in self.headers}

    def problems(self, wide: DataFrame) -> Column:
        """Structural faults of each wide row, as an array: absent and unknown columns, values without a label."""
        absent = [h for h in self.headers if h not in wide.columns]
        unknown = [c for c in wide.columns if c not in self.headers and c != "row_index"]
        found = [F.lit(f"{len(absent)} header(s) absent: {', '.join(absent[:5])}")] * bool(absent) + [F.lit(f"{len(unknown)} unknown header(s): {', '.join(unknown[:5])}")] * bool(unknown)
        for n in self.families["attribute_value"]:
            label, value, uom = self.attribute_headers(n)
            if label in wide.columns:
                said = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "" for c in (value, uom) if c in wide.columns]
                if said:
                    bad = (F.trim(F.coalesce(F.col(f"`{label}`"), F.lit(""))) == "") & (said[0] if len(said) == 1 else said[0] | said[1])
                    found.append(F.when(bad, f"slot {n}: value/UOM present with no label"))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def first_items(items: Column, most: int = 4) -> Column:
    """The first `most` of an array in order, as a message lists them."""
    return F.array_join(F.slice(F.array_sort(items), 1, most), ", ")


def absent(required: Column, present: Column) -> Column:
    """What of `required` is not in `present`, as a message lists it."""
    return F.array_join(F.array_except(required, present), "|")


def evidence(base: str, text: Column, start: Column, end: Column) -> Column:
    """The stretch from start to end of a text (`base` says which: raw, clean or body); null where it is empty."""
    made = F.struct(F.lit(base).alias("base"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(text, start + 1, end - start).alias("snippet"))
    return F.when(end > start, made).cast(EVIDENCE)


def cell(header: str | Column, value: Column, source: str | Column, rule: str | Column, confidence: float | Column, detail: str | Column | None = None, shown: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(header).alias("header"), value.cast("string").alias("value"), as_column(source).alias("source"), as_column(rule).alias("rule"), as_column(confidence).cast("double").alias("confidence"),
        as_column(detail).cast("string").alias("detail"), (F.lit(None) if shown is None else shown).cast(EVIDENCE).alias("evidence"),
    )


def rescored(cell: Column, confidence: Column) -> Column:
    """The cell with another confidence, within 0 and 1."""
    return cell.withField("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence.cast("double"))))


def is_intentional_blank(source: Column, value: Column) -> Column:
    """Whether a cell is empty on purpose."""
    return (F.trim(F.coalesce(value, F.lit(""))) == "") & source.isin("not_derivable", "placeholder_dropped", "contract_template")


def exploded(rows: DataFrame, *cells: Column, array: Column | None = None) -> DataFrame:
    made = F.array(*cells) if array is None else array
    return rows.select("row_index", F.explode(made).alias("c")).select("row_index", "c.*")


def passthrough(rows: DataFrame) -> DataFrame:
    """The input columns as cells, placeholders included."""
    return exploded(rows, *(cell(c, F.trim(F.coalesce(c, F.lit(""))), "input_copy", "passthrough", 1.0) for c in fixed.PASSTHROUGH))


def not_derivable(rows: DataFrame, populated: DataFrame | None = None, headers: tuple[str, ...] | None = None) -> DataFrame:
    """A blank cell for each column that no input gives, unless the row has a value there."""
    names = [h for h in fixed.NOT_DERIVABLE if headers is None or h in headers]
    blanks = exploded(rows, *(cell(h, F.lit(""), "not_derivable", f"not-derivable:{fixed.NOT_DERIVABLE[h]}", 1.0, f"held by the {fixed.NOT_DERIVABLE[h]}, not by the input") for h in names))
    return blanks if populated is None else blanks.join(filled(populated).select("row_index", "header"), ["row_index", "header"], "left_anti")


def attribute_cells(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Label, value and unit cells of `slots` (structs) in contract order: labels always, blanks as blanks."""
    told = "source" in rows.schema["slots"].dataType.elementType.names

    def triple(s: Column, i: Column) -> Column:
        n, has = (i + 1).cast("string"), F.trim(s["value"]) != ""
        source = F.when(has, s["source"] if told else F.lit("regex_extract")).otherwise("contract_template")
        confidence = F.when(has, s["confidence"] if told else F.lit(0.92)).otherwise(1.0)
        rule = F.when(has, s["rule"]).otherwise("contract:value") if told else F.lit("contract:value")
        name = lambda x: F.concat(F.lit(f"ATTRIBUTE_{x} "), n)
        detail = F.when(~has, F.lit("the contract's label without a value in the text"))
        if told:
            detail = detail.when(s["source"] == "derived", "entailed by the category, not read from the text").when(s["source"] == "llm", "proposed by a model and checked against the slot, not read from the text")
        shown = evidence("body", F.col("body"), s["start"], s["end"]) if told and "body" in rows.columns else None
        return F.array(cell(name("LABEL"), s["label"], "derived", "contract:label", 1.0), cell(name("VALUE"), s["value"], source, rule, confidence, detail, shown), cell(name("UOM"), s["uom"], source, F.lit("contract:uom"), confidence, detail, shown))

    return exploded(rows, array=F.flatten(F.transform(F.slice("slots", 1, limit), triple)))


def filled(cells: DataFrame) -> DataFrame:
    return cells.where(F.trim("value") != "")


def generative(cells: DataFrame) -> DataFrame:
    return filled(cells).where(F.col("source").isin("llm", "local_model"))


def audit(cells: DataFrame) -> DataFrame:
    """The cells worth keeping: those with a value and the deliberate blanks."""
    return cells.where((F.col("value") != "") | (F.col("source") != "unresolved"))


def wide(cells: DataFrame, headers: list[str] | tuple[str, ...]) -> DataFrame:
    """One row a row_index with every header in order; '' where there is no cell."""
    return cells.groupBy("row_index").pivot("header", list(headers)).agg(F.first("value")).na.fill("", list(headers)).select("row_index", *(F.col(f"`{h}`") for h in headers))
