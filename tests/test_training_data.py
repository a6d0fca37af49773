"""Span examples and the checks of a training set, against plain versions."""

import random
import re

from gristmill.operators import training

FILLED = "array<struct<label:string,value:string,start:int,end:int>>"


def plain_spans(text, filled):
    made = []
    for f in filled:
        snippet = text[f[2] : f[3]]
        if f[3] > f[2] and snippet and f[1].strip():
            made.append((text.index(snippet), text.index(snippet) + len(snippet), re.sub("[^A-Za-z]+", "_", f[0]).strip("_").upper(), f[1]))
    kept = []
    for s in sorted(made, key=lambda s: (s[0], -s[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def test_span_examples(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(14)))
        filled = [(rng.choice(["Size (in)", "Colour", "2nd Name"]), rng.choice(["v", "w", " "]), a, a + rng.randrange(-1, 5)) for a in (rng.randrange(12) for _ in range(rng.randrange(6)))]
        rows.append((i, text, [f for f in filled if f[3] <= len(text) or rng.random() < 0.5]))
    out = training.span_examples(spark.createDataFrame(rows, f"row_index long, text string, filled {FILLED}")).collect()
    told = {}
    for r in out:
        told.setdefault(r["id"], []).append((r["start"], r["end"], r["label"], r["value"]))
    assert {i: sorted(t) for i, t in told.items()} == {i: k for i, t, f in rows if (k := plain_spans(t, f))}


CLASSES, SPANS = "split string, text string, label string", "split string, text string, entities array<struct<start:int,end:int,label:string>>"


def checked(spark, classes, spans):
    out = training.validation(spark.createDataFrame(classes, CLASSES), spark.createDataFrame(spans, SPANS), spark.createDataFrame([("A",), (None,)], "label string"), spark.createDataFrame([("S",), ("S",)], "label string"))
    return sorted(tuple(r) for r in out.collect())


def test_a_good_set_has_no_faults(spark):
    assert checked(spark, [("train", "x", "A"), ("val", "y", "A")], [("train", "x", [(0, 1, "S")]), ("val", "y", [])]) == []


def test_faults_of_a_set(spark):
    classes = [("train", "\u00a0\t", "A"), ("train", None, "A"), ("train", "Bolt", None), ("train", "bolt", "A"), ("val", "BOLT", "A"), *(("train", f"n{i}", f"L{i}") for i in range(7)), ("train", "n1", "L1")]
    spans = [("train", "a b", [(1, 2, "S"), (0, 4, "no"), (2, 2, "S"), (None, 1, "S"), (0, 1, None), (0, 1, "T")]), ("train", None, [(0, 1, "S")]), ("train", "x", None)]
    assert checked(spark, classes, spans) == [
        ("classes", "all", "text of both splits", 1, ""),
        ("classes", "train", "empty text", 2, ""),
        ("classes", "train", "unknown label", 9, "<none>, L0, L1, L2, L3"),
        ("spans", "train", "blank span", 1, ""),
        ("spans", "train", "offset out of range", 4, ""),
        ("spans", "train", "unknown label", 2, "<none>, T"),
        ("spans", "val", "no rows", 1, ""),
    ]


def test_an_empty_set(spark):
    assert [r[:3] for r in checked(spark, [], [])] == [(p, s, "no rows") for p in ("classes", "spans") for s in ("train", "val")]
