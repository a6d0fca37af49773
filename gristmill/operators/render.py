"""The five description channels, from filled slots.

A row carries `slots`: an array of structs (label, value, uom, style, kind, rank, title_rank, in_title, in_invoice,
in_long) in contract order. Phrases, orders and the two-sided packer are higher-order functions; only the last spacing
repair is an Arrow function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, units
from ..sources.rules import Rules

SLOT = "struct<label:string,value:string,uom:string,style:string,kind:string,rank:int,title_rank:int,in_title:boolean,in_invoice:boolean,in_long:boolean>"


def label_head(label: Column) -> Column:
    return F.regexp_replace(label, r"(?i)(?<=\S)\s+(?:type|rating|level|style|option|class|grade)$", "")


def phrase(slot: Column, plural: bool = False) -> Column:
    """A filled slot in prose, by its style; '' for nothing to say."""
    value, uom, label = F.trim(slot["value"]), F.trim(slot["uom"]), slot["label"]
    noun = F.trim(F.regexp_replace(label, r"(?i)^number\s+of\s+", ""))
    one = F.when(F.lower(noun).endswith("s"), F.regexp_replace(noun, r"s\b", "")).otherwise(noun)
    measured = F.trim(F.replace(F.concat_ws(" ", value, uom, label), F.lit("  "), F.lit(" ")))
    style = slot["style"]
    return F.when((value == "") | (style == "hidden"), "").otherwise(
        F.when(style == "series", F.when(value.rlike(r"(?i)\bseries\b"), value).otherwise(F.concat(value, F.lit(" Series"))))
        .when(style == "value_label_head", F.concat_ws(" ", value, label_head(label)))
        .when(style == "value_only_uom", F.trim(F.concat_ws(" ", value, uom)))
        .when(style.isin("value_uom_label", "value_uom_full_label"), measured)
        .when(style == "count_hyphen", F.concat_ws(" ", value, noun) if plural else F.concat_ws("-", value, one))
        .when(style == "suffix_list", F.concat(label, F.lit(": "), value))
        .otherwise(value)
    )


def invoice_token(slot: Column) -> Column:
    """A filled slot for the invoice line: the unit glued on, or the value abbreviated."""
    value, uom = F.trim(slot["value"]), F.trim(slot["uom"])
    return F.when(value == "", "").when(uom != "", F.upper(F.concat(value, units.canonical(uom)))).otherwise(text.contract_for_invoice(value))


def by_channel(slots: Column) -> Column:
    """Slots in the order of titles: those with a title rank first, then by rank; equals keep their order."""
    keyed = F.transform(slots, lambda s, i: F.struct(F.when(s["title_rank"] > 0, s["title_rank"]).otherwise(s["rank"] + 1000).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["i"] - b["i"])), lambda x: x["s"])


def shares_words(one: Column, other: Column) -> Column:
    """Whether two texts share a word of letters and digits, case ignored: then one of them is redundant."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"([a-z0-9]+)"), F.lit(0))
    return F.arrays_overlap(words(one), words(other))


def by_rank(slots: Column) -> Column:
    keyed = F.transform(slots, lambda s, i: F.struct(s["rank"].alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["i"] - b["i"])), lambda x: x["s"])


def _said(slots: Column, plural: bool = False) -> Column:
    return F.filter(F.transform(slots, lambda s: phrase(s, plural)), lambda p: p != "")


def pack(head: Column, candidates: Column, *, lo: int, hi: int, joiner: str = ", ", required: Column | int = 0) -> Column:
    """struct(text, used, dropped): candidates join the head while the text is short of `lo` (the first `required`
    always try); one that would pass `hi` is left out and later ones still try."""
    required = F.lit(required) if isinstance(required, int) else required
    none = F.array().cast("array<string>")
    start = F.struct(F.trim(head).alias("text"), none.alias("used"), none.alias("dropped"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        c = F.trim(c)
        trial = F.when(acc["text"] != "", F.concat(acc["text"], F.lit(joiner), c)).otherwise(c)
        done = (acc["i"] >= required) & (F.length(acc["text"]) >= lo)
        fits = (c != "") & ~done & (F.length(trial) <= hi)
        return F.struct(
            F.when(fits, trial).otherwise(acc["text"]).alias("text"),
            F.when(fits, F.concat(acc["used"], F.array(c))).otherwise(acc["used"]).alias("used"),
            F.when(~fits & (c != ""), F.concat(acc["dropped"], F.array(c))).otherwise(acc["dropped"]).alias("dropped"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(candidates, start, step)


def audit(packed: Column, lo: int) -> Column:
    """What pack() did, in a line: how many candidates were used, the first dropped ones, and a text that stayed short."""
    n = F.size(packed["used"])
    dropped = F.when(F.size(packed["dropped"]) > 0, F.concat(F.lit("dropped: "), F.array_join(F.transform(F.slice(packed["dropped"], 1, 4), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), "; ")))
    short = F.when(F.length(packed["text"]) < lo, "window NOT satisfied")
    return F.concat_ws(" | ", F.format_string("%d of %d candidates used", n, n + F.size(packed["dropped"])), dropped, short)


def _joined(head: Column, phrases: Column) -> Column:
    return F.concat(head, F.array_join(F.transform(phrases, lambda p: F.concat(F.lit(", "), p)), ""))


def _words(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def channels(rows: DataFrame) -> DataFrame:
    """rows with SHORT_DESC, LONG_DESC1, RETAIL_DESC, MOBILE_DESC and INVOICE_DESC.

    Needs product_name, brand, brand_plain, manufacturer, mpn, series, with_phrase, leaf, klass and slots."""
    filled = F.filter("slots", lambda s: F.trim(s["value"]) != "")
    # Each text is made once and named: expressions that use it twice then do not repeat it.
    out = rows.withColumn("_f", filled).withColumn("_line", F.coalesce(F.nullif(F.element_at(F.concat(F.transform(F.filter("_f", lambda s: s["label"] == "Series"), lambda s: phrase(s)), F.array(F.lit(""))), 1), F.lit("")), F.coalesce("series", F.lit(""))))
    is_series = lambda s: s["kind"] == "series"
    brand = F.coalesce(F.nullif("brand", F.lit("")), F.col("brand_plain"))
    title = _said(by_channel(F.filter("_f", lambda s: s["in_title"] & ~is_series(s))))
    long = by_rank(F.filter("_f", lambda s: s["in_long"]))
    listed = lambda s: s["style"] == "suffix_list"
    told = F.concat(_said(F.filter(long, is_series)), _said(F.filter(long, lambda s: ~is_series(s) & ~listed(s)), True), _said(F.filter(long, listed)))
    out = out.withColumn("_title", title).withColumn("_long", _joined(_words(brand, F.col("product_name"), F.col("with_phrase")), told))
    out = out.withColumn("_short", _joined(_words(brand, F.col("_line"), F.col("mpn"), F.col("product_name"), F.col("with_phrase")), F.col("_title")))
    out = out.withColumn("_retail", _joined(_words(F.col("_line"), F.col("product_name")), F.col("_title")))
    tokens = F.filter(F.transform(by_channel(F.filter("_f", lambda s: s["in_invoice"])), invoice_token), lambda t: t != "")
    line = pack(text.contract_for_invoice(F.col("product_name")), tokens, lo=fixed.INVOICE_MAX, hi=fixed.INVOICE_MAX, joiner=" ", required=F.size(tokens))
    out = out.withColumn("_invoice", line).withColumn("INVOICE_DESC", F.rtrim(F.substring(F.upper(F.trim(F.regexp_replace(F.col("_invoice.text"), r"\s{2,}", " "))), 1, fixed.INVOICE_MAX)))
    # The maker joins the brand unless they share a word.
    plain = F.coalesce(F.nullif("brand_plain", F.lit("")), F.col("brand"))
    maker = F.coalesce("manufacturer", F.lit(""))
    both = _words(maker, plain)
    head = F.when((maker == "") | shares_words(plain, maker), F.when(plain == "", maker).otherwise(plain)).otherwise(both)
    core = F.filter(F.array("product_name", "_line", "mpn"), lambda c: F.coalesce(c, F.lit("")) != "")
    extras = F.array_distinct(_said(by_channel(F.filter("_f", lambda s: ~is_series(s) & (s["style"] != "hidden") & ~listed(s)))))
    tail = F.filter(F.array("leaf", "klass"), lambda c: F.coalesce(c, F.lit("")) != "")
    out = out.withColumn("_core", core).withColumn("_all", F.concat(F.col("_core"), extras, tail)).withColumn("_head", head)
    attempt = lambda h: pack(h, F.col("_all"), lo=fixed.MOBILE_MIN, hi=fixed.MOBILE_MAX, required=F.size("_core"))
    out = out.withColumn("_one", attempt(F.col("_head"))).withColumn("_two", attempt(both))
    one, two = F.col("_one.text"), F.col("_two.text")
    again = (F.length(one) < fixed.MOBILE_MIN) & (maker != "") & ~F.contains("_head", maker) & (F.length(two) > F.length(one)) & (F.length(two) <= fixed.MOBILE_MAX)
    out = out.withColumn("_mobile", F.when(again, two).otherwise(one))
    for name, source in (("SHORT_DESC", "_short"), ("LONG_DESC1", "_long"), ("RETAIL_DESC", "_retail"), ("MOBILE_DESC", "_mobile")):
        out = out.withColumn(name, units.enforce_spacing(text.clean(F.col(source)), F.coalesce("mpn", F.lit(""))))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def slot_table(rules: Rules) -> Column:
    """Map of contract name to its slots, unfilled, as structs in contract order."""
    def one(s):
        values = (s.label, "", "", s.style, s.kind, s.rank, s.title_rank, s.in_title, s.in_invoice, s.in_long)
        names = ("label", "value", "uom", "style", "kind", "rank", "title_rank", "in_title", "in_invoice", "in_long")
        return F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values)))

    return F.create_map(*(x for name, slots in rules.contracts.items() for x in (F.lit(name), F.array(*map(one, slots)))))


def with_slots(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows with `slots`: all slots of `contract`, those of `filled` with their value, unit, source, rule, confidence and
    place in the body."""
    table = slot_table(rules)
    slots = F.coalesce(F.element_at(table, F.col("contract")), F.element_at(table, F.lit("generic")))
    empty = {"value": F.lit(""), "uom": F.lit(""), "source": F.lit(""), "rule": F.lit(""), "confidence": F.lit(0.0), "start": F.lit(0), "end": F.lit(0)}

    def told(s: Column) -> Column:
        found = F.filter("filled", lambda f: f["label"] == s["label"])
        for name, none in empty.items():
            s = s.withField(name, F.coalesce(F.get(found, F.lit(0))[name], none))
        return s

    return rows.withColumn("slots", F.transform(slots, told))


def with_implied(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows (classpath, confidence, slots) with the values that a row's category implies in its blank slots."""
    implied = {c.classpath: dict(c.implies) for c in rules.categories if c.implies}
    if not implied:
        return rows
    values = text.lexicon({f"{path}\n{label}": value for path, told in implied.items() for label, value in told.items()})
    leaf = F.trim(F.element_at(F.split("classpath", ">"), -1))

    def filled(s: Column) -> Column:
        value = F.element_at(values, F.concat(F.col("classpath"), F.lit("\n"), s["label"]))
        made = s.withField("value", value).withField("uom", F.lit("")).withField("source", F.lit("derived")).withField("rule", F.concat(F.lit("taxonomy:implied-by:"), leaf)).withField("confidence", F.greatest(F.lit(0.6), 0.9 * F.col("confidence")))
        return F.when((F.trim(s["value"]) == "") & value.isNotNull(), made).otherwise(s)

    return rows.withColumn("slots", F.when(F.col("classpath").isin(*implied), F.transform("slots", filled)).otherwise(F.col("slots")))
