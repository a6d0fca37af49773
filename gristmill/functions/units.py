"""Units, fractions and measurements: lookups and arithmetic as column functions, spans in Arrow functions."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .text import let, lexicon


@lru_cache
def aliases() -> dict[str, fixed.Unit]:
    """Lower-cased spelling to unit; the first unit that declares a spelling keeps it."""
    out: dict[str, fixed.Unit] = {}
    for unit in fixed.UNITS:
        for spelling in (unit.canonical, *unit.aliases):
            out.setdefault(spelling.strip().lower(), unit)
    return out


def lookup(token: str) -> fixed.Unit | None:
    key = token.strip().lower()
    bare = re.sub(r"[.\s]+$", "", key)
    return aliases().get(key) or aliases().get(bare) or aliases().get(re.sub(r"\s+", " ", bare))


def unit_table(spark: SparkSession) -> DataFrame:
    rows = [(k, u.canonical, u.family, u.fractional, u.scan_excluded) for k, u in aliases().items()]
    return spark.createDataFrame(rows, "alias string, canonical string, family string, fractional boolean, scan_excluded boolean")


def unit_of(token: Column, field: str = "canonical") -> Column:
    """A field of the unit a spelling stands for; null for none."""
    known = lexicon({k: str(getattr(u, field)) for k, u in aliases().items()})
    found = lambda key, bare: F.coalesce(F.element_at(known, key), F.element_at(known, bare), F.element_at(known, F.regexp_replace(bare, r"\s+", " ")))
    return let(F.lower(F.trim(token)), lambda key: found(key, F.regexp_replace(key, r"[.\s]+$", "")))


def canonical(token: Column) -> Column:
    return F.coalesce(unit_of(token), F.trim(token))


_DECIMAL = r"^\s*(\d+)\.(\d+)\s*$"


def to_fraction(magnitude: Column) -> Column:
    """A decimal that is a whole number of 64ths as a trade fraction; all else as it is."""
    text = F.trim(magnitude)
    whole, digits = F.regexp_extract(text, _DECIMAL, 1), F.regexp_extract(text, _DECIMAL, 2)
    tail = F.rtrim(digits, F.lit("0"))
    # Six digits hold every 64th exactly; longer ones are none.
    sixty = F.when(F.length(tail) <= 6, F.rpad(tail, 6, "0").cast("long") * 64)
    n = F.when(sixty % 1_000_000 == 0, (sixty / 1_000_000).cast("long"))
    step = F.when(n % 32 == 0, 32).when(n % 16 == 0, 16).when(n % 8 == 0, 8).when(n % 4 == 0, 4).when(n % 2 == 0, 2).otherwise(1)
    part = F.concat((n / step).cast("long").cast("string"), F.lit("/"), (F.lit(64) / step).cast("long").cast("string"))
    shown = F.when(tail == "", whole).when(n.isNull(), text).when(whole == "0", part).otherwise(F.concat(whole, F.lit("-"), part))
    return F.when(text.rlike(_DECIMAL), shown).otherwise(text)


def to_decimal(magnitude: Column) -> Column:
    """The number that a magnitude states, mixed fractions included; null for none."""
    text = F.trim(magnitude)
    mixed = r"^(?:(\d+)[-\s])?(\d+)\s*/\s*(\d+)$"
    whole, top, bottom = (F.regexp_extract(text, mixed, k) for k in (1, 2, 3))
    value = F.coalesce(whole.try_cast("double"), F.lit(0.0)) + top.try_cast("double") / F.nullif(bottom.try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(mixed), value).when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))


def normalise_magnitude(magnitude: Column, fractional: Column) -> Column:
    text = F.ltrim(F.trim(magnitude), F.lit("+"))
    text = F.when(fractional, to_fraction(text)).otherwise(text)
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text.rlike(_DECIMAL), F.when(trimmed == "", "0").otherwise(trimmed)).otherwise(text)


def render(magnitude: Column, unit: Column, glued: bool = False) -> Column:
    return F.concat(magnitude, F.upper(unit)) if glued else F.concat_ws(" ", magnitude, unit)


def render_dimensions(parts: Column, labels: Column) -> Column:
    """Rendered parts joined by ' x ', each with its label where there is one."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat_ws(" ", p, F.nullif(F.get(labels, i), F.lit("")))), " x ")


def glued_unit(text: Column) -> Column:
    """Whether a number and a unit stand without a space."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)\d(?:in|ft|mm|cm|lb|oz|gal|qt|hr|min|sec)\b")


@lru_cache
def _scan(glued: bool) -> re.Pattern:
    spellings = "|".join(re.escape(k) for k in sorted(aliases(), key=len, reverse=True))
    magnitude = r"\d(?:[\d./-]*\d)?" if glued else r"(?:\d+(?:\.\d+)?(?:[-\s]\d+/\d+)?|\d+/\d+)\s*"
    first = "".join(re.escape(c) for c in sorted({k[0] for k in aliases()}))  # most numbers are followed by nothing that begins a unit
    return re.compile(f"(?P<mag>{magnitude})(?=[{first}])(?P<unit>{spellings})", re.IGNORECASE)


def _stands_alone(text: str, m: re.Match, unit: fixed.Unit) -> bool:
    """Whether a hit is a measurement and no piece of an identifier: 'x' alone may touch it on either side."""
    if unit.scan_excluded:
        return False
    before, after = text[: m.start()][-1:], text[m.end() :][:2]
    if before.isalpha() and before not in "xX":
        return False
    inside_word = m["unit"][-1].isalpha() and after[:1].isalpha()
    return not inside_word or (after[0] in "xX" and (after[1:].isdigit() or after[1:] == "."))


@lru_cache(maxsize=65536)
def fraction(text: str) -> str:
    """to_fraction() of one string, for the span functions."""
    m = re.match(r"^(\d+)\.(\d+)$", text.strip())
    if not m:
        return text.strip()
    n, rest = divmod(int(m[2]) * 64, 10 ** len(m[2]))
    if rest:
        return text.strip()
    if n == 0:
        return m[1]
    step = n & -n
    part = f"{n // step}/{64 // step}"
    return part if m[1] == "0" else f"{m[1]}-{part}"


def measurements(text: str) -> list[dict]:
    """Every number with a unit in a text: magnitude, unit, family, start, end, raw."""
    out = []
    for m in _scan(False).finditer(text):
        unit = lookup(m["unit"])
        if unit and _stands_alone(text, m, unit):
            magnitude = m["mag"].strip().lstrip("+")
            magnitude = fraction(magnitude) if unit.fractional else magnitude
            if "/" not in magnitude and re.fullmatch(r"\d+\.\d+", magnitude):
                magnitude = magnitude.rstrip("0").rstrip(".") or "0"
            out.append({"magnitude": magnitude, "unit": unit.canonical, "family": unit.family, "start": m.start(), "end": m.end(), "raw": m[0]})
    return out


MEASUREMENT = "struct<magnitude:string,unit:string,family:string,start:int,end:int,raw:string>"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end") else T.StringType()) for n in ("magnitude", "unit", "family", "start", "end", "raw")])))
def find_measurements(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: measurements(t or ""))


def dimension_run(measures: Column, text: Column) -> Column:
    """The longest run (two parts at least, the earliest of equals) of measurements joined by 'x': an array."""
    gap = lambda acc, m: F.substring(text, acc["end"] + 1, m["start"] - acc["end"])
    kind = f"array<{MEASUREMENT}>"
    none = F.array().cast(kind)
    begin = F.struct(none.alias("run"), none.alias("best"), F.lit(0).alias("end"))
    better = lambda run, best: F.when((F.size(run) >= 2) & (F.size(run) > F.size(best)), run).otherwise(best)

    def step(acc: Column, m: Column) -> Column:
        joined = (F.size(acc["run"]) > 0) & gap(acc, m).rlike(r"(?i)^\s*[x×]\s*$")
        return F.struct(
            F.when(joined, F.concat(acc["run"], F.array(m))).otherwise(F.array(m)).alias("run"),
            F.when(joined, acc["best"]).otherwise(better(acc["run"], acc["best"])).alias("best"),
            m["end"].alias("end"),
        )

    return F.aggregate(measures, begin, step, lambda acc: better(acc["run"], acc["best"]))


def spaced(text: str, protect: tuple[str, ...] = ()) -> str:
    """A text with a space between every number and unit, and around an 'x' between measurements; the strings of
    `protect` stay as they are."""
    kept = []
    for p in filter(None, protect):
        begin = text.find(p)
        while begin >= 0:
            kept.append((begin, begin + len(p)))
            begin = text.find(p, begin + 1)
    out, at = [], 0
    for m in _scan(True).finditer(text):
        unit = lookup(m["unit"])
        if not unit or not _stands_alone(text, m, unit) or any(m.start() < b and m.end() > a for a, b in kept):
            continue
        out += [text[at : m.start()], f"{m['mag']} {unit.canonical}"]
        at = m.end()
        if text[at : at + 1] in ("x", "X") and (text[at + 1 : at + 2].isdigit() or text[at + 1 : at + 2] == "."):
            out.append(" x ")
            at += 1
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def enforce_spacing(texts: pd.Series, protect: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else spaced(t, (p,) if p else ()) for t, p in zip(texts, protect)])
