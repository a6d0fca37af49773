"""A rule file of a real one's size: 87 categories, 17 contracts of 201 slots with 313 permitted values, 8 dimension orders."""

import json
from collections import Counter

import pytest

from gristmill.operators import extract
from gristmill.plans import enrich
from gristmill.sources import catalogue, rules

N_CATEGORIES, N_CONTRACTS, N_SLOTS, N_VALUES, N_ORDERS = 87, 17, 201, 313, 8
NOUNS = ("bolt", "widget", "plate", "gear", "rod", "ring", "gizmo", "anvil")
FAMILIES = ("length", "weight", "voltage", "power", "current")


def full_size() -> dict:
    """The file's content, by a rule: every kind of slot, values with spellings, cues, bounds, implied values."""
    names = [f"{kind} {noun}".strip() for kind in ("", "hot", "red", "blue", "cold", "small", "large", "steel", "brass", "wide", "flat") for noun in NOUNS][:N_CATEGORIES]
    categories = [
        {"classpath": f"Goods > {n.split()[-1].title()} > {n.title()}", "contract": f"contract {i % (N_CONTRACTS - 1)}", "must": [n, f"{n} kit"], "boost": [x for x in NOUNS if x not in n][:3], "veto": [f"old {n}"], "implies": [["Material", "Steel"]] if "steel" in n else [], "department": "Goods", "klass": n.split()[-1], "fine": n, "product_name": n.title()}
        for i, n in enumerate(names)
    ]
    contracts, values = {}, 0
    for c in range(N_CONTRACTS):
        n_slots = N_SLOTS // N_CONTRACTS + (c < N_SLOTS % N_CONTRACTS)
        slots = [{"label": "Series", "kind": "series", "style": "series", "in_title": True}, {"label": "Width", "kind": "dimension"}, {"label": "Length", "kind": "dimension"}, {"label": "Size", "kind": "dimension"}, {"label": "Pack Quantity", "kind": "count", "lo": 1, "hi": 500}]
        slots += [{"label": f"Measure {k}", "kind": "measure", "family": FAMILIES[(c + k) % len(FAMILIES)], "cues": [NOUNS[k]]} for k in range(2)]
        slots += [{"label": "Condition", "kind": "text", "cues": ["hot", "cold"]}, {"label": "Parts", "kind": "count", "cues": ["pc", "way"]}]
        while len(slots) < n_slots:
            left, open_ = N_VALUES - values, N_CONTRACTS * 2 + N_SLOTS % N_CONTRACTS + (N_SLOTS // N_CONTRACTS - 11) * N_CONTRACTS
            k = len([s for s in slots if s["kind"] == "lov"])
            lov = [f"Finish {c} {k} {v}" for v in range(6)] + (["Steel", "Brass"] if k == 0 else [])
            lov = lov[:left] if open_ and left < len(lov) else lov
            values += len(lov)
            slots.append({"label": f"Finish {k}" if k else "Material", "kind": "lov", "lov": lov, "lov_aliases": [[f"fin {c} {k}", lov[0]]] if lov else [], "in_title": k == 0, "in_invoice": True})
        contracts["generic" if c == N_CONTRACTS - 1 else f"contract {c}"] = slots
    last = contracts["generic"][-1]
    last["lov"] = last["lov"] + [f"More {v}" for v in range(N_VALUES - values)]
    orders = {f"contract {c}": {"2": ["Width", "Length"], "3": ["Width", "Length", "Height"]} for c in range(3)} | {"generic": {"2": ["Width", "Length"], "4": ["Width", "Length", "Height", "Depth"]}}
    return {"categories": categories, "contracts": contracts, "dimensions": orders}


@pytest.fixture(scope="module")
def loaded(tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "rules.json"
    path.write_text(json.dumps(full_size()))
    return rules.load(str(path))


def test_counts(spark, loaded):
    assert (len(loaded.categories), len(loaded.contracts)) == (N_CATEGORIES, N_CONTRACTS)
    slots = [s for c in loaded.contracts.values() for s in c]
    assert (len(slots), sum(len(s.lov) for s in slots), sum(map(len, loaded.dimensions.values()))) == (N_SLOTS, N_VALUES, N_ORDERS)
    assert loaded.category_table(spark).count() == N_CATEGORIES == loaded.category_table(spark).select("classpath").distinct().count()
    assert loaded.lov_table(spark).count() == len({(s.label, v) for s in slots for v in s.lov})
    kinds = Counter(r["kind"] for r in loaded.phrases(spark).collect())
    assert kinds == {"must": 2 * N_CATEGORIES, "boost": 3 * N_CATEGORIES, "veto": N_CATEGORIES}


def test_orders_of_dimensions(loaded):
    assert loaded.order("contract 1", 3) == ("Width", "Length", "Height") and loaded.order("contract 9", 4) == ("Width", "Length", "Height", "Depth")
    assert loaded.order("contract 9", 3) == ("Width", "Length", "Height") and loaded.order("none", 2) == ("Width", "Length")


def test_every_permitted_value_is_read(loaded):
    for name, slots in loaded.contracts.items():
        for slot in slots:
            for value in slot.lov:
                out = {f[0]: f[1] for f in extract.fill_contract(f"a thing, {value.lower()}-", name, loaded)}
                assert out[slot.label] == value, (name, slot.label, value)
            for spelling, value in slot.lov_aliases:
                assert {f[0]: f[1] for f in extract.fill_contract(f"thing ({spelling.upper()})", name, loaded)}[slot.label] == value


def test_a_run_under_it(spark, loaded):
    rows = catalogue.bridge(spark, "/root/testdata/sf0.001").where("row_index < 60")
    out, _, verdict, _ = enrich.run(rows, loaded)
    found = out.select("row_index", "classpath", "Part_Desc").collect()
    assert len(found) == 60 == verdict.count()
    known = {c.classpath for c in loaded.categories}
    assert all(r["classpath"] in known for r in found if r["classpath"]) and sum(r["classpath"] is not None for r in found) > 40
