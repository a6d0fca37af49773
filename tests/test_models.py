"""The count-based classifier and tagger against plain versions, and on held-out rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from gristmill.operators import models, score, training

FIELDS = "row_index long, text string, label string"


def plain_classes(train, texts, smoothing=1.0):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    train = [r for r in train if r[2] is not None]
    by = {}
    for _, t, label in train:
        by.setdefault(label, Counter()).update(words(t))
    vocabulary = {w for c in by.values() for w in c}
    rows = Counter(label for *_, label in train)
    out = []
    for t in texts:
        scores = {}
        for label in sorted(by):
            total = sum(by[label].values()) + smoothing * len(vocabulary)
            scores[label] = math.log(rows[label] / len(train)) + sum(math.log((by[label][w] + smoothing) / total) for w in words(t) if w in vocabulary)
        best = max(scores.values())
        out.append((min(x for x in scores if scores[x] >= best - 1e-12), best))
    return out


def test_classifier(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = {"a": ["red", "bolt", "steel"], "b": ["lamp", "steel", "white"], "c": ["deck", "board", "red"]}
    text = lambda label: " ".join(rng.choice(vocabulary[label] + ["the", "of"]) for _ in range(rng.randint(0, 8)))
    train = [(i, text(label), label) for i, label in enumerate(rng.choice("aabbc") for _ in range(80))] + [(900, "bolt", None), (901, None, "a")]
    asked = [(i, text(rng.choice("abc")) + rng.choice(("", " unheard", " The BOLT!"))) for i in range(60)] + [(70, None), (71, ""), (72, "unheard of"), (73, "zzz")]
    model = models.train_classifier(spark.createDataFrame(train, FIELDS))
    model.write(str(tmp_path / "model"))
    model = models.Classifier.read(spark, str(tmp_path / "model"))
    got = {r["row_index"]: r for r in models.classified(spark.createDataFrame(asked, "row_index long, text string"), model).collect()}
    assert len(got) == len(asked)
    for (i, _), (label, best) in zip(asked, plain_classes(train, [t for _, t in asked])):
        assert got[i]["pred"] == label and abs(got[i]["score"] - best) < 1e-9
    assert models.classified(spark.createDataFrame(asked[:0], "row_index long, text string"), model).count() == 0


def test_classifier_on_held_out_silver_rows(spark):
    """Trained on the silver rows of one fold, told by the metrics of the other."""
    rng = random.Random(5)
    noun = {"Bolts": ("bolt", "hex bolt"), "Lamps": ("led lamp", "ceiling light"), "Decking": ("grooved decking", "deck board")}
    rows = [(i, f"{rng.choice(('red', 'black', 'white'))} {rng.choice(noun[x])} {rng.randint(1, 9)}\"", "", x, 0.9) for i, x in enumerate(rng.choice(list(noun)) for _ in range(300))]
    silver = training.silver(spark.createDataFrame(rows, "row_index long, text string, mpn string, label string, confidence double"))
    model = models.train_classifier(silver.where("split = 'train'"))
    held = spark.createDataFrame([(i, r["text"], r["label"]) for i, r in enumerate(silver.where("split = 'val'").collect())], FIELDS)
    told = models.classified(held.select("row_index", "text"), model).join(held.select("row_index", "label"), "row_index")
    metrics = score.classification_metrics(told).first()
    assert metrics["accuracy"] > 0.97 and metrics["macro_f1"] > 0.97


def sequences(rng, n):
    out = []
    for i in range(n):
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(("SIZE", "COLOR", "O"))
            if kind == "SIZE":
                words += [str(rng.randint(10, 99)), "inch"]
                tags += ["B-SIZE", "I-SIZE"]
            elif kind == "COLOR":
                words += ["dark", rng.choice(("red", "blue"))] if rng.random() < 0.5 else [rng.choice(("red", "blue"))]
                tags += ["B-COLOR", "I-COLOR"][: 1 + (words[-2:-1] == ["dark"])]
            else:
                words.append(rng.choice(("plate", "the", "dark")))
                tags.append("O")
        out += [(i, p, w, t) for p, (w, t) in enumerate(zip(words, tags))]
    return out


def test_tagger(spark):
    rng = random.Random(7)
    train, held = sequences(rng, 400), sequences(rng, 120)
    model = models.train_tagger(spark.createDataFrame(train + [(9999, 0, "x", None)], "id long, pos long, word string, tag string"))
    # Counts and shares as a plain version has them.
    low = lambda w: re.sub("[0-9]", "0", w.lower())
    per, begin = Counter(t for *_, t in train), Counter(t for _, p, _, t in train if p == 0)
    follow = Counter((a[3], b[3]) for a, b in zip(train, train[1:]) if a[0] == b[0])
    by = Counter((low(w), t) for _, _, w, t in train)
    known = {w for w, _ in by}
    assert model.tags == sorted(per)
    share = lambda w, t: math.log((by[w, t] + 0.1) / (per[t] + 0.1 * (len(known) + 1)))
    told = {r["word"]: r["shares"] for r in model.words.collect()}
    assert set(told) == known and all(abs(x - share(w, t)) < 1e-9 for w, xs in told.items() for x, t in zip(xs, model.tags))

    def after(counts, before):
        open_ = [t for t in model.tags if models.may_follow(before, t)]
        total = sum(counts(t) + 0.1 for t in open_)
        return [math.log((counts(t) + 0.1) / total) if t in open_ else -math.inf for t in model.tags]

    assert np.allclose(model.first, after(lambda t: begin[t], None)) and all(np.allclose(model.after[i], after(lambda t: follow[b, t], b)) for i, b in enumerate(model.tags))
    # The best path is the best of all paths.
    for _ in range(30):
        shares = np.log(np.random.default_rng(rng.randrange(10**6)).random((rng.randint(1, 4), len(model.tags))))
        paths = itertools.product(range(len(model.tags)), repeat=len(shares))
        value = lambda p: model.first[p[0]] + sum(model.after[a, b] for a, b in zip(p, p[1:])) + sum(shares[i, t] for i, t in enumerate(p))
        best = max(map(value, paths))
        assert abs(value(models.best_path(model.first, model.after, shares)) - best) < 1e-9
    asked = spark.createDataFrame(held, "id long, pos long, word string, tag string").repartition(5)
    got = models.tagged(asked.select("id", "pos", "word"), model)
    assert got.count() == len(held)
    spans = lambda df: score.decode_spans(df)
    metrics = score.span_metrics(spans(got), spans(asked.select("id", "pos", "tag"))).first()
    assert metrics["entity_f1"] > 0.9
    assert models.tagged(asked.where("false"), model).count() == 0
    none = models.train_tagger(asked.where("false"))
    assert none.tags == [] and models.tagged(asked, none).count() == 0
