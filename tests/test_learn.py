"""Learning over whole texts of all scripts, against brute force."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from gristmill.operators import extract, learn
from gristmill.sources.rules import Rules, Slot, demo

RUN = r"\b([A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|[IVX]+|\d+|[A-Z]\+?))+)"
TEXTS = [
    "x " * 1500 + "Pebble Beach Grooved 12",
    "caf\u00e9 Trex Enhance, \u00c9Blue Ridge, Blue Ridge\u00e9 Blue\u00a0Ridge",
    "Pebble Beach\nGrooved II \u0663\u0664 \u00bdTrex Enhance_ Trex Enhance A+ e\u0301Trex Enhance",
    "\u65e5\u672c Trex Enhance\u3000Plus \u65e5Pebble Beach Pebble Beach\u00b2 \U0001f600Pebble Beach",
    "Run " + "Aa B2 I 7 C+ " * 2000,
    "",
    None,
]


def test_title_runs_of_whole_texts(spark):
    rows = list(enumerate(TEXTS))
    got = [tuple(r) for r in learn.title_runs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "run").collect()]
    assert sorted(got) == sorted((i, run) for i, t in rows for run in re.findall(RUN, t or ""))
    assert (0, "Pebble Beach Grooved 12") in got and {1, 2, 3} <= {i for i, _ in got}


def test_every_series_fills_a_slot(spark):
    letters = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnopqrst", repeat=4), 100_000)]
    names = [f"Zone Q{x}" if i % 2 else f"Q{x} Zone II" for i, x in enumerate(letters)]
    table = spark.createDataFrame([(x, 2 + i % 3) for i, x in enumerate(names)], "name string, n long")
    rng = random.Random(9)
    bodies = [(i, " ".join(rng.choice((x, x.upper(), x.replace(" ", "-"), x.replace(" ", "") + "s", x.replace(" ", "\u00a0"))) for x in rng.sample(names, 2))) for i in range(40)]
    bodies += [(100, "Decking"), (101, ""), (102, None), (103, f"x{names[5]} {names[7]}x")]
    rows = spark.createDataFrame([(i, b, "generic") for i, b in bodies], "row_index long, body string, contract string")
    listed = extract.listed_words(demo().contract("generic"))
    want = {}
    for i, b in bodies:
        flat = re.sub(r"[\s-]", "", b or "").lower()
        met = sorted((-len(n), -(2 + k % 3), n) for k, n in enumerate(names) if n.replace(" ", "").lower() in flat and extract._pattern(n).search(b))
        want[i] = [extract.trim_words(met[0][2], listed)] if met else []
    told = extract.extract(rows, demo(), table).select("row_index", F.expr("transform(filter(filled, f -> f.label = 'Series'), f -> f.value)").alias("v")).collect()
    assert {r["row_index"]: r["v"] for r in told} == want and sum(map(len, want.values())) == 40


def test_phrases_found_in_a_text_are_all_that_match():
    rng = random.Random(6)
    words, joints = ["Red", "Bolt", "Rod", "Es", "S", "II", "4", "Bus"], [" ", "-", "", "  ", "/", "\u00a0", "\u00e9", " - "]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(150)}
    known = extract.Phrases(names)
    for _ in range(300):
        text = "".join(rng.choice((str.lower, str.upper, str))(rng.choice(words)) + rng.choice(("", "", "s", "es", "\u017f")) + rng.choice(joints) for _ in range(rng.randint(0, 7)))
        assert {n for n in names if extract._pattern(n).search(text)} <= known.found(text)


def test_one_matcher_reads_what_all_patterns_read():
    """Slots filled through the matcher, against every pattern tried in turn; and its time with many more values."""
    rng = random.Random(16)
    words = ["red", "blue", "oak", "steel", "matte", "black", "so", "cord", "pc", "way", "ss"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    joints = (" ", "-", "", "  ", "/", "s ", "es ")
    for _ in range(60):
        lov = tuple(dict.fromkeys(phrase() for _ in range(6)))
        slots = (Slot("A", "lov", lov=lov, lov_aliases=tuple((phrase(), rng.choice(lov)) for _ in range(4))), Slot("B", "count", cues=tuple(phrase() for _ in range(3)), lo=2), Slot("C", "text", cues=tuple(phrase() for _ in range(3))), Slot("D", "measure", family="length", cues=(phrase(),)))
        rules = Rules((), {"generic": slots})
        for _ in range(20):
            text = "".join(rng.choice((*words, "3", "12 in", "1")) + rng.choice(joints) for _ in range(rng.randint(0, 9)))
            row = extract._Row(text, extract.Contract(slots), [])
            row.dimensions(rules, "generic")
            row.found = {c for s in slots for c in s.cues}
            for s in slots:
                if s.label not in row.out:
                    row.measure(s) if s.kind == "measure" else row.read(extract.readings_of(s), s)
            assert extract.fill_contract(text, "generic", rules) == [row.out[s.label] for s in slots if s.label in row.out]
    took = []
    for n in (50, 5_000):
        slots = (Slot("A", "lov", lov=tuple(f"value {i} of many" for i in range(n))),)
        rules = Rules((), {"generic": slots})
        extract.fill_contract("warm value 7 of many", "generic", rules)
        began = time.perf_counter()
        for _ in range(300):
            extract.fill_contract("a plain text with value 7 of many words", "generic", rules)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]
