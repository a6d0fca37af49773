"""The vocabulary's JSON document: read, written, and read again."""

import glob
import json

import pytest

from gristmill.operators import entity
from gristmill.plans import enrich
from gristmill.sources import catalogue, vocabulary
from gristmill.sources.rules import demo

BRAND = {"canonical": "Milwaukee", "aliases": ["Milw", "MIL \"W\""], "groups": ["A (X1)"], "support": 12, "linkage": "exact:dib-brand-column", "confidence": 0.95, "attested": True, "mean_position": 0.125, "rejection": ""}
DOCUMENT = {
    "n_rows": 3,
    "brands": {"Milwaukee": BRAND, "Bosch": BRAND | {"canonical": "Bosch", "aliases": [], "confidence": 1.0}, "Été\\n": BRAND | {"canonical": "Été\\n"}},
    "brand_candidates": {"Decking": BRAND | {"canonical": "Decking", "attested": False, "rejection": "no attested spelling"}},
    "alias_index": {"milw": "Milwaukee", "bosch": "Bosch", "ghost": "Nobody"},
    "product_types": {"Hex Bolt": {"canonical": "Hex Bolt", "support": 4, "groups": ["g"], "variants": ["Hx Bolt"]}},
    "series": {"Zone Two": 9, "Blue Ridge": 2},
    "groups": {"A (X1)": {"name": "A", "code": "X1"}, "-": {"name": "", "code": ""}},
    "unknown_units": {"zz": 5},
    "observed_families": {"Hex Bolt": {"length": 3, "weight": 1}},
    "value_vocab": {"finish": {"Black": 2, "White": 7}},
    "stats": {"brands": 3.0, "share": 0.25},
}


def read_back(folder) -> dict:
    (file,) = glob.glob(f"{folder}/part-*")
    return json.loads(open(file, encoding="utf-8").read())


def test_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(DOCUMENT, indent=2, ensure_ascii=False), encoding="utf-8")
    tables = vocabulary.read_vocabulary(spark, str(tmp_path / "in.json"))
    assert [(r["ord"], r["key"], r["aliases"]) for r in tables["brands"].orderBy("ord").collect()] == [(i, k, v["aliases"]) for i, (k, v) in enumerate(DOCUMENT["brands"].items())]
    assert {(r["canonical"], r["family"], r["n"]) for r in tables["observed_families"].collect()} == {("Hex Bolt", "length", 3), ("Hex Bolt", "weight", 1)}
    vocabulary.write_vocabulary(tables, str(tmp_path / "out"))
    again = read_back(tmp_path / "out")
    assert again == DOCUMENT and list(again["brands"]) == list(DOCUMENT["brands"]) and list(again["alias_index"]) == list(DOCUMENT["alias_index"])
    vocabulary.write_vocabulary(vocabulary.read_vocabulary(spark, str(tmp_path / "out")), str(tmp_path / "twice"))
    assert read_back(tmp_path / "twice") == DOCUMENT


def test_partial_and_broken_documents(spark, tmp_path):
    (tmp_path / "part.json").write_text('{"series": {"Zone Two": 2}, "more": [1]}')
    tables = vocabulary.read_vocabulary(spark, str(tmp_path / "part.json"))
    assert {k: df.count() for k, df in tables.items()} == {"n_rows": 1} | {k: int(k == "series") for k in vocabulary.SECTIONS}
    vocabulary.write_vocabulary(tables, str(tmp_path / "out"))
    assert read_back(tmp_path / "out") == {"n_rows": 0} | {k: {"Zone Two": 2} if k == "series" else {} for k in vocabulary.SECTIONS}
    (tmp_path / "bad.json").write_text('{"series": {')
    with pytest.raises(Exception):
        vocabulary.read_vocabulary(spark, str(tmp_path / "bad.json"))["series"].collect()


def test_brands_resolve_by_a_document(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps(DOCUMENT))
    known = enrich.Vocabulary.of_artefact(vocabulary.read_vocabulary(spark, str(tmp_path / "in.json")))
    row = lambda i, d, account: (i, "X", d, "-", "-", "-", account)
    rows = spark.createDataFrame([row(0, "Milw saw", "-"), row(1, "saw", "Milwauke (ABC)"), row(2, "ghost saw", "-"), row(3, "saw", "-")], "row_index long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string")
    got = {r["row_index"]: (r["brand_plain"], r["rung"], r["attested"]) for r in entity.resolve_brands(rows, known.aliases, known.brand_prior, parse_account=True, brands=known.brands).collect()}
    assert got == {0: ("Milwaukee", "description-alias", True), 1: ("Milwaukee", "account-name-head", True), 2: ("Nobody", "description-alias", False), 3: ("", "unresolved", False)}
    assert enrich.enriched(rows, demo(), known).count() == 4


def test_learned_vocabulary_as_a_document(spark, tmp_path):
    rows = catalogue.bridge(spark, "/root/testdata/sf0.001").where("row_index < 80")
    learned = enrich.learned(rows, demo())
    vocabulary.write_vocabulary(enrich.artefact(rows, learned), str(tmp_path / "out"))
    document = read_back(tmp_path / "out")
    assert document["n_rows"] == 80 and set(document["brands"]) == {r["canonical"] for r in learned.brands.collect()} and len(document["brands"]) > 3
    again = vocabulary.read_vocabulary(spark, str(tmp_path / "out"))
    fields = ["canonical", "aliases", "groups", "support", "linkage", "confidence", "mean_position"]
    key = lambda df: sorted(map(str, df.select(fields).collect()))
    assert key(again["brands"]) == key(learned.brands)
    assert {(r["alias"], r["canonical"]) for r in again["alias_index"].collect()} == {(r["alias"], r["canonical"]) for r in learned.aliases.collect()}
