"""Linking brand tokens, the vocabulary's fold and implied values, against plain versions."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.functions import fixed, text
from gristmill.operators import entity, learn, render, taxonomy
from gristmill.plans import enrich
from gristmill.sources.rules import Category, Rules, demo, generated

INPUT = "row_index long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string"


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios_count_common_letters():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(60)]
    a, b = words[:30], words[30:]
    assert entity.common_letters(a, b).tolist() == [common(x, y) for x, y in zip(a, b)]
    assert entity.indel_ratios(["", "ab"], ["", "ba"]).tolist() == [100.0, 50.0]


@pytest.mark.parametrize(
    ("token", "name", "score"),
    [("Milw", "Milwaukee", 96), ("dewlt", "DeWalt", pytest.approx(90.909, abs=0.01)), ("Wire", "Southwire", 0), ("Square", "Square D", 100), ("T-Square", "T-Square", 100), ("Fir", "First Alert", 75), ("Timer", "Timbertech", pytest.approx(66.667, abs=0.01)), ("", "x", 0), ("x", "", 0)],
)
def test_similarity(token, name, score):
    assert entity.similarities([token], [name])[0] == score


@pytest.mark.parametrize(("token", "name", "agrees"), [("Milw", "Milwaukee", True), ("Kichler", "Kichler Co", True), ("Bosch", "Makita", False), ("Tool", "Milwaukee Tool", True), ("", "x", False)])
def test_agreement(token, name, agrees):
    assert (entity.agreements([token], [name])[0] >= fixed.LINK_THRESHOLD) == agrees


def test_near_pairs_miss_none(spark):
    """Every pair over the threshold is among the pairs of the equi-joins."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    names = [word(rng.randint(1, 14)) + rng.choice(("", " Tools", "-x", "/y")) for _ in range(250)]
    tokens = []
    for n in names * 2:
        t = list(n.split(" ")[0])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t) + 1) : rng.randrange(len(t) + 1)] = rng.choice(("", "a", "b"))
        tokens.append("".join(t) or "a")
    pairs = {tuple(r) for r in entity.near_pairs(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    for t in set(tokens):
        for n, s in zip(names, entity.similarities([t] * len(names), names)):
            assert s < fixed.LINK_THRESHOLD or (t, n) in pairs, (t, n, s)
    assert len(pairs) < len(set(tokens)) * len(set(names)) / 3


def catalogue_rows():
    """Groups with a brand of their own, shorthand for it, product words that resemble brands, and loose tokens."""
    rng, rows = random.Random(7), []
    makers = [("Milwaukee", "Milw", "Milwaukee Accessory (4031)"), ("DeWalt", "Dewlt", "Black & Decker/dewlt (DEW01)"), ("Metalmark", "Metal", "Metal House (MH001)"), ("", "Zorb", "Zorbo Partners (ZP001)"), ("Kichler", "Kichlr", "Kichler Lighting (KICLI)")]
    for i in range(120):
        brand, short, account = makers[i % len(makers)]
        told = brand if brand and i % 3 == 0 and short != "Metal" else "-- No DIB Brand --"
        desc = f"X{i} {short} {rng.choice(('Blue Ridge Pro', 'Pebble Beach', ''))} {rng.choice(('Metal Cut Off Disc', 'Long Sanding Belt Roll', 'Masonry Cut Off Wheel'))}"
        rows.append((i, f"X{i}", " ".join(desc.split()), "Metalmark" if i == 50 else "", "", told, account))
    return rows


def test_links_follow_the_ladder(spark):
    rows = spark.createDataFrame(catalogue_rows(), INPUT)
    types = learn.product_types(rows)
    words = {r["low"] for r in learn.product_words(types).collect()}
    links = {(r["grp"], r["token"]): r for r in learn.link_brands(rows, learn.product_words(types)).collect()}
    by = {t: r for (_, t), r in links.items()}
    assert by["Milw"]["canonical"] == "Milwaukee" and by["Milw"]["linkage"].startswith("group-brand-column(")
    assert by["Dewlt"]["canonical"] == "DeWalt" and by["Kichlr"]["canonical"] == "Kichler"
    assert by["Zorb"]["attested"] is False or by["Zorb"]["canonical"] == "Zorbo Partners"
    assert "metal" in words and ("Metal" not in by or by["Metal"]["linkage"] == "blocked:product-vocabulary")
    known, candidates = learn.brands(rows, learn.link_brands(rows, learn.product_words(types)))
    names = {r["canonical"] for r in known.collect()}
    assert {"Milwaukee", "DeWalt", "Kichler", "Metalmark"} <= names and not names & {r["canonical"] for r in candidates.collect()}


def test_entries_fold_in_order(spark):
    links = [("g1", "Milw", 3, 0.2, 5, "Milwaukee", "a", 0.9, True), ("g2", "MILW", 4, 0.6, 9, "Milwaukee", "b", 0.97, True), ("g2", "Milwk", 1, 0.4, 7, "Milwaukee", "c", 0.5, True)]
    df = spark.createDataFrame(links, "grp string, token string, hits long, position double, seen long, canonical string, linkage string, confidence double, attested boolean")
    told = spark.createDataFrame([("Milwaukee", 10, 1), ("Bosch", 2, 3)], "value string, support long, seen long")
    out = {r["canonical"]: r for r in learn.brand_entries(df, told).collect()}
    m = out["Milwaukee"]
    assert m["aliases"] == ["Milw", "Milwk"] and m["groups"] == ["g1", "g2"] and m["support"] == 18 and m["linkage"] == "a"
    assert m["confidence"] == 0.97 and m["mean_position"] == pytest.approx(((0.2 + 0.4) / 2 + 0.6) / 2)
    assert out["Bosch"]["aliases"] == ["Bosch"] and out["Bosch"]["linkage"] == "attested-column"


def test_series_leave_out_brands_and_product_words(spark):
    rows = [(i, f"P{i}", d, "", "", "", "a") for i, d in enumerate(["Trex Enhance Basics Decking", "Trex Enhance Basics Decking", "Pebble Beach Board", "Pebble Beach Board", "Pebble Beach Blk", "Trex Board", "Café Blue Ridgeé Rail"])]
    df = spark.createDataFrame(rows, INPUT)
    aliases = spark.createDataFrame([("trex",)], "alias string")
    told = learn.own_aliases(df, aliases)
    assert [r["aliases"] for r in told.orderBy("row_index").collect()] == [["trex"], ["trex"], [], [], [], ["trex"], []]
    phrases = {r["row_index"]: r["phrase"] for r in learn.named(told).collect()}
    assert phrases[0] == "Enhance Basics Decking" and phrases[5] == "Board"
    runs = {(r["row_index"], r["name"]) for r in learn.series_runs(told).collect()}
    for i, name in runs:
        assert not {w.lower() for w in name.split()} & {w.lower() for w in phrases[i].split()} and "trex" not in name.lower()


def test_families_of_kept_names_only(spark):
    rows = [(0, "", "Widget Board 6 in", "", "", "", "a"), (1, "", "Widget Board 7 in", "", "", "", "a"), (2, "", "Lonely Thing 3 in", "", "", "", "a")]
    out = {r["canonical"] for r in learn.families(spark.createDataFrame(rows, INPUT)).collect()}
    assert out == {"Widget Board"}


def test_implied_values_fill_blank_slots_only(spark):
    rules = demo()
    anvil = next(c for c in rules.categories if c.implies)
    slot = lambda label, value: (label, value, "", "r" if value else "", "r" if value else "", 0.9 if value else 0.0)
    rows = [(0, anvil.classpath, 0.8, [slot("Material", ""), slot("Color", "")]), (1, anvil.classpath, 0.5, [slot("Material", "Brass")]), (2, "Other", 0.9, [slot("Material", "")]), (3, None, 0.0, [slot("Material", "")])]
    df = spark.createDataFrame(rows, "row_index long, classpath string, confidence double, slots array<struct<label:string,value:string,uom:string,source:string,rule:string,confidence:double>>")
    out = {r["row_index"]: r["slots"] for r in render.with_implied(df, rules).collect()}
    assert out[0][0]["value"] == "Steel" and out[0][0]["source"] == "derived" and out[0][0]["confidence"] == pytest.approx(0.72) and out[0][1]["value"] == ""
    assert out[1][0]["value"] == "Brass" and out[2][0]["value"] == "" and out[3][0]["value"] == ""


def test_vocabulary_of_a_catalogue(spark):
    rows = spark.createDataFrame(catalogue_rows(), INPUT)
    aliases, known, _ = enrich.brand_vocabulary(rows)
    found = {r["alias"]: r["canonical"] for r in aliases.collect()}
    assert found["milw"] == "Milwaukee" and found["dewlt"] == "DeWalt" and found["milwaukee"] == "Milwaukee"
    brands = entity.resolve_brands(rows, aliases, learn.brand_prior(rows, aliases))
    assert Counter(r["brand_plain"] for r in brands.collect())["Milwaukee"] == 23  # one of the 24 rows names another brand


def test_matches_equal_patterns_on_every_text(spark):
    """The phrase join against every category's patterns on every text, phrases of many words and marks included."""
    rng = random.Random(9)
    words = ["red", "bolt", "Bolt", "bus", "box", "3", '"', "x", "T", "caf\u00e9", "steel", "old"]
    phrase = lambda: rng.choice(("", " ")).join(rng.choice(words) + rng.choice((" ", "-", "  ")) for _ in range(rng.randint(1, 6))).strip(" -")
    categories = [Category(f"c{i}", must=tuple(phrase() for _ in range(2)), boost=tuple(phrase() for _ in range(3)), veto=(phrase(),) if i % 3 == 0 else ()) for i in range(40)] + [Category("none")]
    texts = ["".join(rng.choice(words) + rng.choice((" ", "-", "", "s ", "es ", ", ")) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)], "row_index long, prepared string, grp string")
    got = {(r["row_index"], r["classpath"]): (r["n_boost"], tuple(r["phrases"]), round(r["base"], 9)) for r in taxonomy.matches(rows, Rules(tuple(categories))).collect()}
    want = {}
    for i, t in enumerate(texts):
        for c in categories:
            hit = lambda p, t=t: bool(p.strip()) and re.search(text.phrase_pattern(p), t or "", re.ASCII) is not None
            must = [p for p in c.must if hit(p)]
            if must and not any(map(hit, c.veto)):
                boost = {p for p in c.boost if hit(p) and p not in c.must}
                base = 0.6 + 0.25 * min(max(map(len, must)) / 12, 1) + fixed.BOOST * min(len(boost), 4)
                want[i, c.classpath] = (len(boost), tuple(sorted({*must, *boost})), round(base, 9))
    assert got == want and len(want) > 200


def test_a_generated_rule_set_runs(spark):
    rules = generated()
    assert len(rules.categories) == 87 and len(rules.contracts) == 18
    rows = spark.createDataFrame(catalogue_rows(), INPUT)
    out, made, verdict, _ = enrich.run(rows, rules)
    assert verdict.count() == out.count() == rows.count()


def test_names_and_tokens_are_dealt_before_their_parts_are_made(spark):
    """Few bytes make many parts: neither side may be left to the few partitions that its bytes fill."""
    tokens, names = spark.createDataFrame([("acmee",), ("zed",)], "token string"), spark.createDataFrame([("Acme",), ("Zeds",)], "name string")
    found = entity.near_pairs(tokens, names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"RepartitionByExpression \[xxhash64\((?:token|name)", plan))) == 2
    assert ("acmee", "Acme") in {tuple(r) for r in found.collect()}


def test_close_names(spark):
    """Account heads against names with letters dropped, added and changed anywhere, by brute force over all pairs."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdeAB") for _ in range(n))
    names = list(dict.fromkeys(word(rng.randint(1, 40)) for _ in range(120))) + ["Philips", "PHILIPS", "Zoë Works"]
    heads = {"Phillips", "philips", "zoe works", "", "a"}
    for n in names:
        for _ in range(3):
            x = list(n)
            for _ in range(rng.randint(0, 1 + len(n) // 8)):
                at, how = rng.randint(0, len(x)), rng.randrange(3)
                x[at : at + (how != 1)] = rng.choice("abcz") * (how != 2)
            heads.add("".join(x))
    order = {n: (i * 37) % 41 for i, n in enumerate(names)}
    pairs = [(h, n) for h in sorted(heads) for n in names if h and entity.slack(len(h), len(n), 88) >= 0]
    scores = entity.indel_ratios([h.lower() for h, _ in pairs], [n.lower() for _, n in pairs])
    want = {}
    for (h, n), score in zip(pairs, scores):
        if score >= 88 and (h not in want or (order[n], n) < (order[want[h]], want[h])):
            want[h] = n
    found = entity.close_names(spark.createDataFrame([(h,) for h in sorted(heads)] + [(None,)], "head string"), spark.createDataFrame(list(order.items()), "name string, ord long"))
    assert {r["head"]: r["name"] for r in found.collect()} == want and len(want) > 100
    assert any(h.lower()[0] != n.lower()[0] for h, n in want.items())


def test_close_names_beyond_the_first_block(spark):
    """Heads that the first block leaves open meet the rest by keys where names differ, and block by block where they are
    alike; long texts too. The same names as over all pairs."""
    rng = random.Random(5)
    alike = [f"Supplier#{n:09d}" for n in rng.sample(range(100_000), 300)]
    apart = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(9, 80))) for _ in range(200)]
    for names in (alike, apart, alike[:30] + apart):
        heads = sorted({n[1:] if k % 3 == 0 else n + " x" if k % 3 == 1 else n.replace("pp", "p").upper() for k, n in enumerate(names)} | {"none of them"})
        order = {n: (i * 37) % 41 for i, n in enumerate(names)}
        ranked = sorted(names, key=lambda n: (order[n], n))
        scores = entity.indel_ratios([h.lower() for h in heads for _ in ranked], [n.lower() for _ in heads for n in ranked]).reshape(len(heads), -1)
        want = {h: ranked[int((row >= 88).argmax())] for h, row in zip(heads, scores) if (row >= 88).any()}
        given = spark.createDataFrame([(h,) for h in heads], "head string"), spark.createDataFrame(list(order.items()), "name string, ord long")
        found = entity.close_names(*given, first=16, block=100)
        assert {r["head"]: r["name"] for r in found.collect()} == want and len(want) >= len(names) - 3
        places = entity.first_close([h.lower() for h in heads], [n.lower() for n in ranked], 88)
        assert {h: ranked[k] for h, k in zip(heads, places) if k >= 0} == want


def test_close_names_costs_no_pairs_of_what_is_alike(spark):
    """6,000 heads and as many names that share nearly all letters: 36 million pairs are not made (they took minutes)."""
    names = spark.range(6000).select(F.format_string("Supplier#%09d", "id").alias("name"), F.col("id").alias("ord"))
    began = time.time()
    assert entity.close_names(names.select(F.concat("name", F.lit(" x")).alias("head")), names).count() == 6000
    assert time.time() - began < 60


def test_slack_is_what_a_ratio_leaves():
    for x in range(1, 30):
        for y in range(1, 30):
            most = max((d for d in range(x + y + 1) if (x + y - d) % 2 == 0 and d >= abs(x - y) and 100 * (x + y - d) >= 88 * (x + y)), default=-1)
            assert entity.slack(x, y, 88) == most


def test_account_head_of_a_brand(spark):
    row = lambda i, account: (i, "X", "nothing known", "-", "-", "-", account)
    rows = spark.createDataFrame([row(0, "Phillips (ABC)"), row(1, "Hillipse (ABC)"), row(2, "Philips (ABC)"), row(3, "Elsewhere (ABC)"), row(4, "-"), row(5, "Candidat (ABC)")], "row_index long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string")
    aliases = spark.createDataFrame([("philips", "Philips", True), ("candidat", "Candidat", False)], "alias string, canonical string, attested boolean")
    brands = spark.createDataFrame([("Philips", 4), ("Phillipse", 9), ("Candidate", 1)], "canonical string, seen long")
    prior = spark.createDataFrame([], "grp string, brand string, hits long, purity double")
    got = {r["row_index"]: (r["brand_plain"], r["rung"], r["confidence"]) for r in entity.resolve_brands(rows, aliases, prior, parse_account=True, brands=brands).collect()}
    assert got[0] == got[2] == ("Philips", "account-name-head", 0.7) and got[1] == ("Phillipse", "account-name-head", 0.7)
    assert got[3][1] == got[4][1] == got[5][1] == "unresolved"


def plain_agreement(token, name):
    ratio = lambda a, b: 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))
    short, long = sorted((token.lower(), name.lower()), key=len)
    if not short:
        return 0.0
    scores = [ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))]
    if len(long) < 1.5 * len(short):
        scores += [ratio(token, name), 0.95 * ratio(token, " ".join(sorted(name.split()))), 95.0 * (token in name.split())]
    return max(scores)


def test_agreements_of_a_batch():
    rng = random.Random(14)
    text = lambda most: "".join(rng.choice("abAB é") for _ in range(rng.randint(0, most)))
    pairs = [(text(9), text(14)) for _ in range(300)] + [(text(20), text(90)) for _ in range(10)] + [(text(80), text(80)) for _ in range(4)]
    found = entity.agreements(*map(list, zip(*pairs)))
    assert all(abs(f - plain_agreement(t, n)) < 1e-9 for f, (t, n) in zip(found, pairs))
    letters = [(text(70), text(150)) for _ in range(60)] + [("", ""), ("", "a"), ("a" * 64, "a" * 70), ("b" * 65, "b" * 64)]
    assert entity.common_letters(*map(list, zip(*letters))).tolist() == [common(a, b) for a, b in letters]
    many = [("Milwauke", "Milwaukee Accessory"), ("Dewlt", "Dewalt")] * 2000
    began = time.perf_counter()
    entity.agreements(*map(list, zip(*many)))
    assert time.perf_counter() - began < 10  # 4,000 pairs with some twenty stretches each


def plain_entries(links):
    """canonical to (aliases, groups, support, linkage, confidence, mean position, seen), folded link by link."""
    out = {}
    for seen, g, t, p, linkage, hits, c, confidence in sorted((x[4], x[0], x[1], x[3], x[6], x[2], x[5], x[7]) for x in links):
        e = out.setdefault(c, [[], set(), 0, linkage, 0.0, 0.0, seen])
        if t.lower() not in {a.lower() for a in e[0]}:
            e[0].append(t)
        e[1].add(g)
        e[2] += hits
        e[4] = max(e[4], confidence)
        e[5] = p if e[5] == 0 else (e[5] + p) / 2
    return out


def test_entries_equal_the_fold(spark):
    """Among others a brand of 100,000 links, brands that begin at 0 or never leave it, and links that repeat."""
    rng = random.Random(20)
    made = lambda c, n, zeros=0.2: [(f"g{rng.randrange(9)}", rng.choice(("Ab", "AB", "ab", "Abc", "aBC")), rng.randrange(5), 0.0 if rng.random() < zeros else round(rng.random(), 3), rng.randrange(50 * n), c, rng.choice("xyz"), round(rng.random(), 2)) for _ in range(n)]
    links = made("hot", 100_000) + made("zero", 30, 1.0) + [x for i in range(40) for x in made(f"c{i}", rng.randint(1, 9))]
    links += [("g", "Tail", 1, 0.0, i, "late", "x", 0.5) for i in range(3000)] + [("g", "Tail", 1, 0.7, 3000, "late", "x", 0.5), ("g", "Tail", 1, 0.1, 3001, "late", "x", 0.5)]
    links += [("g", "Same", 1, 0.25, 1, "same", "x", 0.5)] * 3 + [("g", "Same", 1, 0.75, 2, "same", "x", 0.5)]
    df = spark.createDataFrame(links, "grp string, token string, hits long, position double, seen long, canonical string, linkage string, confidence double").withColumn("attested", F.lit(True))
    want = plain_entries(links)
    got = {r["canonical"]: r for r in learn.brand_entries(df).collect()}
    assert set(got) == set(want)
    for c, (aliases, groups, support, linkage, confidence, mean, seen) in want.items():
        r = got[c]
        assert (r["aliases"], r["groups"], r["support"], r["linkage"], r["confidence"], r["seen"]) == (aliases, sorted(groups), support, linkage, confidence, seen)
        assert r["mean_position"] == pytest.approx(mean, abs=2e-6), c


def test_product_names_read_rows_once(spark):
    """Families count names and measurements in one pass, and names are made of distinct phrases: two rows whose phrases
    differ in shorthand alone are one name."""
    said = [(0, "PN1", "PN1 SS Bolt 2 in", "A"), (1, "PN2", "PN2 Stainless Steel Bolt 3 in 4 pc", "B"), (2, "PN3", "PN3 Stainless Steel Bolt", "A"), (3, "PN4", "4 in", "A"), (4, "PN5", "5 in", "A")]
    rows = spark.createDataFrame(said, "row_index long, Mfg_Part_Num string, Part_Desc string, Part_Manuf string")
    types, families = learn.product_types(rows), learn.families(rows)
    assert {(r["canonical"], r["support"], tuple(r["groups"]), tuple(r["variants"])) for r in types.collect()} == {("Stainless Steel Bolt", 3, ("A", "B"), ("SS Bolt",))}
    assert {tuple(r) for r in families.collect()} == {("Stainless Steel Bolt", "length", 2), ("Stainless Steel Bolt", "count", 1)}
    assert families._jdf.queryExecution().optimizedPlan().toString().count("find_measurements") == 1
