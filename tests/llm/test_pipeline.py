"""The pipeline on whole small tables: each stage against what it is to do."""

import hashlib
import os
import random
import re
import shutil
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, nearcopies, tokens, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "token_ids":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept.append((name, docs, out := spark.read.parquet(str(tmp_path / name))))
        docs = out
    by = {n: (a, b) for n, a, b in kept}
    before, after = by["toxicity"]
    rejected = toxicity.report(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").count()
    assert before.count() - after.count() == rejected
    before, after = by["ngram_jaccard"]
    truth = nearcopies.brute_force([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {d for d, n, c in truth if not n or d == c}
    before, after = by["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {r[0] for r in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in before.collect()], items) if r[5]}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = by["mixing"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    import public_tokenizers

    before, after = by["token_ids"]
    expected = tokens.brute_force([(r["doc_id"], r["text"]) for r in before.collect()], public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after.collect()) == sorted((d, n, c) for d, _, n, c in expected)
    shutil.rmtree(tmp_path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, row string, size long, path string, score double, slot string"


def awkward():
    """Nulls in every column, empty and very long texts, repeated rows and ids, copies, leaked and toxic passages."""
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    leak, base = prose(30), prose(120)
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "en", "s1"), (2, "", None, "s2"), (3, " \n ", "en", None), (None, prose(40), "en", "s1")]
    rows += [(10 + i, base + f" end{i % 2}", "en", "s1") for i in range(6)] + [(10, base + " end0", "en", "s1"), (10, prose(50), "en", "s2")]
    rows += [(30 + i, f"{prose(25)} {leak} {prose(5)}", "fr", "s2") for i in range(3)]
    rows += [(50 + i, " ".join(["vile", "rotten", prose(20), "vile", "awful"]), "en", "s3") for i in range(12)]
    rows += [(100 + i, prose(60 + i), "en", f"s{i % 4}") for i in range(60)] + [(300, prose(25_000), "de", "s1")]
    labels = [(50 + i, 0, 1) for i in range(12)] + [(100 + i, 1, 0) for i in range(60)] + [(None, 0, 1), (10, None, None)]
    bench = [("b1", leak), ("b2", "short item"), (None, prose(20)), ("b3", None)]
    return rows, labels, bench


def small_tables(spark, folder, rows, labels, bench):
    width = len(SCHEMA.split(","))
    spark.createDataFrame([(*r, *(None,) * (width - len(r))) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_stages_on_awkward_rows(spark, tmp_path):
    """Every stage against a plain version over its own input."""
    rows, labels, bench = awkward()
    data = str(tmp_path / "data")
    small_tables(spark, data, rows, labels, bench)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        out[name] = (docs.collect(), (after := spark.read.parquet(str(tmp_path / name))).collect())
        docs = after
    before, after = out["toxicity"]
    known = sorted({d: y for d, _, y in labels if d is not None and y is not None and zlib.crc32(str(d).encode()) % 5}.items())
    assert len(known) > 40 and len(before) == len(rows)
    scores = toxicity.report(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert len(after) == sum(r["score"] < 0.5 for r in scores) and not any(r["doc_id"] is not None and 50 <= r["doc_id"] < 62 for r in after)
    before, after = out["ngram_jaccard"]
    numbered = [(i, r["text"]) for i, r in enumerate(before)]
    groups = {}
    for i, n, c in nearcopies.brute_force(numbered):
        groups.setdefault(("alone", i) if not n else c, []).append(before[i])
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).digest()[:16])
    assert plain_rows(spark.createDataFrame(after, SCHEMA)) == sorted((tuple(min(g, key=key)) for g in groups.values()), key=lambda r: tuple((x is not None, str(x)) for x in r))
    before, after = out["decontamination"]
    hit = [r[5] for r in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in before], [("null" if i is None else i, t) for i, t in bench])]
    assert sorted(map(repr, after)) == sorted(repr(r) for r, h in zip(before, hit) if not h) and any(hit)
    before, after = out["mixing"]
    have, times = Counter(map(repr, before)), Counter(map(repr, after))
    assert all(n <= 3 * have[r] for r, n in times.items())
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sources = sorted({r["source"] for r in before if size(r) and r["source"] is not None})
    total = sum(map(size, before))
    own = {s: sum(size(r) for r in before if r["source"] == s) for s in sources}
    target, left, open_ = {}, float(total), list(sources)
    order = sorted({r["source"] for r in before if r["source"] is not None})
    weight = {s: order.index(s) % 3 + 1 for s in sources}
    while open_:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 3 * own[s]]
        target |= {s: 3.0 * own[s] for s in full} if full else {s: left * weight[s] / w for s in open_}
        left, open_ = left - sum(3.0 * own[s] for s in full), [s for s in open_ if s not in full] if full else []
    for s in sources:
        taken = sum(size(r) for r in after if r["source"] == s)
        assert abs(taken - target[s]) <= 2 * max(size(r) for r in before if r["source"] == s), s
    before, after = out["token_ids"]
    import public_tokenizers

    expected = tokens.brute_force([(r["doc_id"], r["text"]) for r in before], public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == Counter((d, n, c) for d, _, n, c in expected)


def test_empty_tables(spark, tmp_path):
    small_tables(spark, str(tmp_path / "none"), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    # Documents but nothing to hold them against: no label, no benchmark.
    small_tables(spark, str(tmp_path / "some"), [(1, "a b c d e f g", "en", "s"), (2, None, None, None)], [], [])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()} == {1}


def test_stages_drop_what_earlier_ones_left(spark, tmp_path):
    from gristmill.llm.common import named

    rows, labels, bench = awkward()
    data = str(tmp_path / "data")
    small_tables(spark, data, rows[:20], labels, bench)
    began = set(named())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = set()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert not left & set(named()), name  # the predecessor's folders are gone
        left = set(named()) - began
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert left
