"""The five channels against fully worked rows, and spot checks of what feeds them."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text, units
from gristmill.operators import render

#: Attribute slots of one category: label, style, kind, rank, title rank, in title, in invoice, in long.
SLOTS = [
    ("Series", "series", "series", 1, 0, True, False, True),
    ("Number of Wash Cycles", "count_hyphen", "count", 2, 2, True, True, True),
    ("Voltage Rating", "value_only_uom", "measure", 3, 4, False, True, True),
    ("Amperage Rating", "value_only_uom", "measure", 4, 5, False, True, True),
    ("Mounting Type", "value_label_head", "lov", 5, 1, True, True, True),
    ("Size", "value", "dimension", 6, 0, False, False, True),
    ("Depth With Door Open", "value_uom_label", "measure", 7, 6, False, True, True),
    ("Sound Level", "value_uom_label", "measure", 10, 7, False, True, True),
    ("Material", "value", "lov", 11, 3, True, True, True),
    ("Color", "value", "lov", 12, 3, True, True, True),
    ("Additional Information", "suffix_list", "additional", 99, 0, False, False, True),
]
ONE = {"Series": ("Professional Series", ""), "Number of Wash Cycles": ("5", ""), "Voltage Rating": ("120", "V"), "Amperage Rating": ("15", "A"), "Mounting Type": ("Leg", ""), "Size": ("24 in W x 24-1/4 in D", ""), "Depth With Door Open": ("50-1/4", "in"), "Sound Level": ("47", "dBA"), "Material": ("Stainless Steel", ""), "Additional Information": ("240 kW-hr Annual Energy", "")}
TWO = {"Series": ("Eco Series", ""), "Voltage Rating": ("120", "V"), "Amperage Rating": ("10", "A"), "Mounting Type": ("Built-in", ""), "Depth With Door Open": ("50-3/16", "in"), "Sound Level": ("41", "dBA"), "Material": ("Stainless Steel", ""), "Color": ("Stainless Steel", "")}


@pytest.fixture(scope="module")
def channels(spark):
    def slots(values):
        return [(a, *values.get(a, ("", "")), b, c, d, e, f, g, h) for a, b, c, d, e, f, g, h in SLOTS]

    rows = [
        (1, "Dishwasher", "FRIGIDAIRE®", "FRIGIDAIRE", "Rheem Manufacturing", "PDSH4816AF", "Professional Series", "With CleanBoost™", "", "", slots(ONE)),
        (2, "Dishwasher", "Whirlpool®", "Whirlpool", "Whirlpool Corporation", "WDTS7024RZ", "Eco Series", "", "", "", slots(TWO)),
        (3, "Lamp", "", "", "", "X1", "", "", "", "", slots({})),
    ]
    df = spark.createDataFrame(rows, f"row_index long, product_name string, brand string, brand_plain string, manufacturer string, mpn string, series string, with_phrase string, leaf string, klass string, slots array<{render.SLOT}>")
    return {r["row_index"]: r for r in render.channels(df).collect()}


def test_short(channels):
    assert channels[1]["SHORT_DESC"] == "FRIGIDAIRE® Professional Series PDSH4816AF Dishwasher With CleanBoost™, Leg Mounting, 5-Wash Cycle, Stainless Steel"
    assert channels[2]["SHORT_DESC"] == "Whirlpool® Eco Series WDTS7024RZ Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel"


def test_invoice(channels):
    assert channels[1]["INVOICE_DESC"] == "DISHWASHER LEG 5 SST 120V 15A 50-1/4IN"
    assert channels[2]["INVOICE_DESC"] == "DISHWASHER BLTLN SST SST 120V 10A 41DBA"
    assert all(len(r["INVOICE_DESC"]) <= 40 and r["INVOICE_DESC"] == r["INVOICE_DESC"].upper() for r in channels.values())


def test_mobile(channels):
    assert channels[1]["MOBILE_DESC"] == "Rheem Manufacturing FRIGIDAIRE, Dishwasher, Professional Series, PDSH4816AF"
    assert channels[2]["MOBILE_DESC"] == "Whirlpool, Dishwasher, Eco Series, WDTS7024RZ, Built-in Mounting"
    assert [len(channels[k]["MOBILE_DESC"]) for k in (1, 2)] == [75, 64]


def test_retail(channels):
    assert channels[1]["RETAIL_DESC"] == "Professional Series Dishwasher, Leg Mounting, 5-Wash Cycle, Stainless Steel"
    assert channels[2]["RETAIL_DESC"] == "Eco Series Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel"


def test_long_keeps_contract_order(channels):
    assert channels[1]["LONG_DESC1"] == "FRIGIDAIRE® Dishwasher With CleanBoost™, Professional Series, 5 Wash Cycles, 120 V, 15 A, Leg Mounting, 24 in W x 24-1/4 in D, 50-1/4 in Depth With Door Open, 47 dBA Sound Level, Stainless Steel, Additional Information: 240 kW-hr Annual Energy"


def test_assets_and_marks(spark):
    row = spark.range(1).select(text.asset_names(F.lit("FRIGIDAIRE®"), F.lit("PDSH4816AF")).alias("a"), text.clean(F.lit("  With CleanBoost™ 24″ —"), fold=True).alias("c"), text.decorate(F.lit("bosch"), F.lit(True)).alias("d")).first()
    assert row["a"]["Product Image"] == "FRIGIDAIRE_PDSH4816AF.jpg" and row["a"]["Alternate Image 4"] == "FRIGIDAIRE_PDSH4816AF_4.jpg"
    assert row["c"] == 'With CleanBoost™ 24"' and row["d"] == "bosch®"


@pytest.mark.parametrize("raw,shown", [("50.25", "50-1/4"), ("0.5", "1/2"), ("3.7", "3.7"), ("3.14", "3.14"), ("5.0", "5"), ("1.015625", "1-1/64"), ("7", "7"), ("1/2", "1/2")])
def test_fractions(spark, raw, shown):
    assert units.fraction(raw) == shown
    assert spark.range(1).select(units.to_fraction(F.lit(raw))).first()[0] == shown


@pytest.mark.parametrize(
    "said,found",
    [('14"x1/8"x1" Disc', [("14", "in"), ("1/8", "in"), ("1", "in")]), ("3M 775L TV2000WN DCB518ASTS06G", []), ("120V 15 amps", [("120", "V"), ("15", "A")]), ("4'x10' panel", [("4", "ft"), ("10", "ft")]), ("50.25 inches 3pk", [("50-1/4", "in"), ("3", "pk")])],
)
def test_measurements(said, found):
    assert [(m["magnitude"], m["unit"]) for m in units.measurements(said)] == found


def test_spacing():
    assert units.spaced('14"x1/8" disc 24in PN24IN', ("PN24IN",)) == "14 in x 1/8 in disc 24 in PN24IN"
    assert units.spaced("DCB518ASTS06G") == "DCB518ASTS06G"
