"""Text and unit rules against plain versions, on the catalogue view's rows and on texts made to be awkward."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.functions import fixed, text, units
from gristmill.operators import learn, training

WORDS = ["Blk", "ss", "SS", "fixt", "lt", "Board", "Deck-ing", "x", "T", "Led", "PVC", "the", "12", '14"', "1/8", "3.5in", "2x4", "-", "|", ";", " - ", "6pc", "Display Only", "(Display Only)", "20'", "5 lb", "10A", "café", "®", "#2", "it's"]
PLACES = re.compile(rf"({text.TOKEN})|.", re.DOTALL)


def awkward():
    rng = random.Random(14)
    texts = ["".join(rng.choice(WORDS) + rng.choice((" ", " ", "", "  ", ", ")) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    return [(i, f"PN{i}", (f"PN{i} " if i % 3 == 0 else "") + t) for i, t in enumerate(texts)] + [(900, "", None), (901, "PN901", "PN901"), (902, "P", "")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(awkward(), "row_index long, Mfg_Part_Num string, Part_Desc string").persist()


def clean(t):
    t = re.sub(r"\s+", " ", (t or "").translate(str.maketrans("“”″′‘’´—– ", "\"\"\"''''-- ")))
    return re.sub(r"^[\s\-,;:]+", "", re.sub(r"[\s\-,;:]+$", "", t.strip(" ")))


def expand(t):
    words = {k: v for k, v in fixed.EXPANSIONS.items() if v.lower() != k}
    return clean("".join(words.get(m[0].lower(), m[0]) for m in PLACES.finditer(t or "")))


def lines(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 2 else r[1] for r in df.select(*columns).collect()}


def test_expand(rows):
    got = lines(rows.select("row_index", text.expand(F.col("Part_Desc")).alias("x")), "row_index", "x")
    assert got == {i: expand(t) for i, _, t in awkward()}


def test_head_phrase_and_fallback(rows):
    made = rows.withColumn("body", text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num"))).withColumn("m", units.find_measurements("body"))
    made = made.select("row_index", "body", learn.head_phrase(F.col("body"), F.col("m"), F.array(F.lit("board"))).alias("phrase"), text.fallback_name(F.col("body")).alias("name"))
    for r in made.collect():
        cut = r["body"]
        for m in sorted(units.measurements(cut), key=lambda m: -m["start"]):
            cut = cut[: m["start"]] + " " + cut[m["end"] :]
        phrase = ""
        for segment in reversed(re.split(r"\s+-\s+|\s*[|;]\s*", cut)):
            found = [w for w in re.findall(r"[A-Za-z][A-Za-z'\-]*", segment) if w.lower() != "board" and (len(w) > 1 or w.lower() == "t")]
            if found:
                phrase = " ".join(found[-4:])
                break
        assert r["phrase"] == phrase, r["body"]
        last = [w for w in re.findall(r"[A-Za-z][A-Za-z'\-]*", r["body"]) if len(w) > 1][-3:]
        assert r["name"].lower() == expand(" ".join(last)).lower()


def test_prepared_text(rows):
    made = rows.select("row_index", text.clean(F.col("Part_Desc")).alias("full"), text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num")).alias("body"), text.prepare_text(F.col("Part_Desc"), F.col("Mfg_Part_Num")).alias("prepared"))
    for r in made.collect():
        parts = [r["full"]]
        for more in (r["body"], expand(r["body"])):
            if more and more.lower() not in [p.lower() for p in parts]:
                parts.append(more)
        assert r["prepared"] == " | ".join(parts)


def test_measurements(rows):
    got = {r["row_index"]: r["m"] for r in rows.select("row_index", units.find_measurements("Part_Desc").alias("m")).collect()}
    some = 0
    for i, _, t in awkward():
        end = 0
        for m in got[i]:
            assert t[m["start"] : m["end"]] == m["raw"] and m["start"] >= end and m["raw"][0] in "0123456789.+-"
            unit = units.lookup(re.sub(r"^[\d\s./+-]+", "", m["raw"]))
            assert unit is not None and (unit.canonical, unit.family) == (m["unit"], m["family"]) and not unit.scan_excluded
            end, some = m["end"], some + 1
    assert some > 100


@pytest.mark.parametrize(
    ("said", "found"),
    [("14\"x1/8\"x1\" Disc", [("14", "in"), ("1/8", "in"), ("1", "in")]), ("2.5in and 20'", [("2-1/2", "in"), ("20", "ft")]), ("no numbers", []), ("AB12in", []), ("5 lb 3.50A", [("5", "lb"), ("3.5", "A")]), ("", [])],
)
def test_single_measurements(said, found):
    assert [(m["magnitude"], m["unit"]) for m in units.measurements(said)] == found


def test_spacing_changes_units_only(rows):
    got = {r["row_index"]: r["s"] for r in rows.select("row_index", units.enforce_spacing("Part_Desc", F.lit("")).alias("s")).collect()}
    for i, _, t in awkward():
        if t is None:
            assert got[i] is None
            continue
        assert units.spaced(got[i]) == got[i], "spacing again changes nothing"
        # Outside measurements the text is untouched.
        rest, at = [], 0
        for m in units._scan(True).finditer(t):
            rest.append(t[at : m.start()])
            at = m.end()
        for piece in rest:
            assert all(w in got[i] for w in piece.split() if not re.search(r"^[xX]$", w))


def test_product_types(spark, rows):
    docs = rows.withColumn("Part_Manuf", F.when(F.col("row_index") % 2 == 0, "A").otherwise(""))
    got = {r["canonical"]: (r["support"], tuple(r["groups"]), tuple(r["variants"])) for r in learn.product_types(docs).collect()}
    named = learn.named(docs).where("phrase <> ''").select("canonical", "phrase", "Part_Manuf").collect()
    want = {}
    for name, n in Counter(r["canonical"] for r in named).items():
        own = [r for r in named if r["canonical"] == name]
        if n >= 2:
            want[name] = (n, tuple(sorted({r["Part_Manuf"] or "<ungrouped>" for r in own})), tuple(sorted({r["phrase"] for r in own if r["phrase"].lower() != name.lower()})))
    assert got == want and want


def test_training_rows(spark):
    rng = random.Random(2)
    source = [(i, f"PN{i} {rng.choice(('White', 'Black'))} Light Fixture - 12\" {rng.choice('abcdefgh')}", f"PN{i}", f"c{i % 3 if i < 200 else 9}", 0.9 if i % 5 else 0.5) for i in range(210)] + [(500, "x", "", None, 0.9)]
    df = spark.createDataFrame(source, "row_index long, text string, mpn string, label string, confidence double")
    out = training.silver(df, floor=40).collect()
    sure = {i: label for i, _, _, label, c in source if label and c >= 0.7}
    assert {r["row_index"] for r in out} <= set(sure) and all(r["label"] == sure[r["row_index"]] for r in out)
    assert len({(r["row_index"], r["split"]) for r in out}) == len({r["row_index"] for r in out}), "variants of a row stay together"
    train = Counter(r["label"] for r in out if r["split"] == "train")
    assert all(n >= 40 for n in train.values()) and set(train) == set(sure.values())
    val = [(r["text"].lower(), r["label"]) for r in out if r["split"] == "val"]
    assert len(val) == len(set(val))
    assert sorted(map(tuple, out)) == sorted(map(tuple, training.silver(df, floor=40).collect())), "reruns agree"
    assert training.silver(df.limit(0), floor=5).count() == 0
