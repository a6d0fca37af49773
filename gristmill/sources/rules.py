"""Rule sets that come as parameters: taxonomy categories and attribute contracts, from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Category:
    """One leaf: a row belongs to it if a `must` phrase occurs and no `veto` phrase does; `boost` phrases add to it."""

    classpath: str
    contract: str = "generic"
    must: tuple[str, ...] = ()
    boost: tuple[str, ...] = ()
    veto: tuple[str, ...] = ()
    implies: tuple[tuple[str, str], ...] = ()
    department: str = ""
    klass: str = ""
    fine: str = ""
    product_name: str = ""

    @property
    def leaf(self) -> str:
        return self.classpath.split(">")[-1].strip()


@dataclass(frozen=True)
class Slot:
    """One attribute of a contract: how it is found (`kind`) and how it reads in prose (`style`)."""

    label: str
    kind: str = "text"
    style: str = "value"
    family: str = ""
    lo: float | None = None
    hi: float | None = None
    lov: tuple[str, ...] = ()
    lov_aliases: tuple[tuple[str, str], ...] = ()
    cues: tuple[str, ...] = ()
    in_title: bool = False
    in_invoice: bool = False
    in_mobile: bool = False
    in_long: bool = True
    rank: int = 50
    title_rank: int = 0


@dataclass(frozen=True)
class Rules:
    categories: tuple[Category, ...] = ()
    contracts: dict[str, tuple[Slot, ...]] = field(default_factory=dict)
    #: Labels of a dimension run by contract and number of parts.
    dimensions: dict[str, dict[int, tuple[str, ...]]] = field(default_factory=dict)

    @cached_property
    def memo(self) -> dict:
        """What is made of the rules once in each process, by contract."""
        return {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def contract(self, name: str) -> tuple[Slot, ...]:
        return self.contracts.get(name) or self.contracts.get("generic", ())

    def order(self, name: str, parts: int) -> tuple[str, ...]:
        known = self.dimensions.get(name) or self.dimensions.get("generic") or {}
        return known.get(parts) or (known[max(known)][:parts] if known else ())

    def phrases(self, spark: SparkSession) -> DataFrame:
        """(classpath, kind, phrase): one row a phrase; bounded by the rule file."""
        rows = [(c.classpath, kind, p) for c in self.categories for kind in ("must", "boost", "veto") for p in getattr(c, kind)]
        return spark.createDataFrame(rows, "classpath string, kind string, phrase string")

    def category_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.classpath, c.leaf, c.contract, c.department, c.klass, c.fine, c.product_name or c.leaf) for c in self.categories]
        return spark.createDataFrame(rows, "classpath string, leaf string, contract string, department string, klass string, fine string, product_name string")

    def lov_table(self, spark: SparkSession) -> DataFrame:
        rows = sorted({(s.label, v) for slots in self.contracts.values() for s in slots for v in s.lov})
        return spark.createDataFrame(rows, "label string, value string")


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def load(path: str) -> Rules:
    """A JSON file with `categories` (list), `contracts` (name to list of slots) and `dimensions`."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    made = lambda kind, rows: tuple(kind(**{k: _tuples(v) for k, v in r.items()}) for r in rows)
    return Rules(
        made(Category, spec.get("categories", [])),
        {k: made(Slot, v) for k, v in spec.get("contracts", {}).items()},
        {k: {int(n): tuple(labels) for n, labels in v.items()} for k, v in spec.get("dimensions", {}).items()},
    )


def demo() -> Rules:
    """A small rule set over the nouns of the order tables, for queries and tests."""
    nouns = {"widget": "Widgets", "plate": "Plates", "gear": "Gears", "bolt": "Bolts", "rod": "Rods", "ring": "Rings", "gizmo": "Gizmos", "anvil": "Anvils"}
    finishes = ("red", "blue", "hot", "cold")
    categories = tuple(
        Category(f"Hardware > {'Fasteners' if n in ('bolt', 'ring', 'rod') else 'Parts'} > {leaf}", "hardware", must=(n, f"large {n}"), boost=finishes[:2], veto=("old bolt",) if n == "bolt" else (), implies=(("Material", "Steel"),) if n == "anvil" else (), department="Hardware", klass="Fasteners" if n in ("bolt", "ring", "rod") else "Parts", fine=leaf, product_name=leaf[:-1])
        for n, leaf in nouns.items()
    )
    slots = (
        Slot("Series", "series", "series", in_title=True, in_long=True, rank=1),
        Slot("Width", "dimension", "value_only_uom", in_invoice=True, rank=5),
        Slot("Length", "dimension", "value_only_uom", in_invoice=True, rank=6),
        Slot("Size", "dimension", "value", rank=7),
        Slot("Pack Quantity", "count", "value_uom_label", lo=1, hi=500, rank=8),
        Slot("Color", "lov", "value", lov=("Red", "Blue"), in_title=True, in_invoice=True, rank=9, title_rank=2),
        Slot("Material", "lov", "value", lov=("Steel", "Brass"), in_title=True, rank=10, title_rank=1),
        Slot("Condition", "text", "value_label_head", cues=("hot", "cold"), rank=11),
        Slot("Additional Information", "additional", "suffix_list", rank=99),
    )
    dimensions = {"generic": {2: ("Width", "Length"), 3: ("Width", "Length", "Height")}}
    return Rules(categories, {"hardware": slots, "generic": slots}, dimensions)


def generated(n_categories: int = 87, n_contracts: int = 17, n_slots: int = 12) -> Rules:
    """A rule set of a real one's size, made by a rule from the words of the order tables: categories of one or two
    words with boosts and vetoes, and contracts of every kind of slot. For measuring."""
    nouns = ("widget", "plate", "gear", "bolt", "rod", "ring", "gizmo", "anvil", "bracket", "lever")
    kinds = ("red", "blue", "hot", "cold", "small", "large", "steel", "brass", "wide")
    names = [f"{kind} {noun}" if kind else noun for kind in ("", *kinds) for noun in nouns][:n_categories]
    categories = tuple(
        Category(f"Made > {name.split()[-1]} > {name}", f"contract {i % n_contracts}", must=(name, f"{name} kit"), boost=tuple(k for k in kinds if k not in name)[:4], veto=(f"old {name}",), department="Made", klass=name.split()[-1], fine=name, product_name=name.title())
        for i, name in enumerate(names)
    )
    families = ("length", "weight", "voltage", "power")

    def slots(c: int) -> tuple[Slot, ...]:
        base = [Slot("Series", "series", "series", in_title=True, rank=1), Slot("Width", "dimension", "value_only_uom", in_invoice=True, rank=2), Slot("Length", "dimension", "value_only_uom", rank=3), Slot("Size", "dimension", "value", rank=4), Slot("Pack Quantity", "count", "value_uom_label", lo=1, hi=500, rank=5)]
        base += [Slot(f"Finish {c} {k}", "lov", lov=tuple(kinds[k::3]), in_title=k == 0, in_invoice=True, rank=6 + k) for k in range(3)]
        base += [Slot(f"Measure {k}", "measure", "value_uom_label", family=f, cues=(nouns[(c + k) % len(nouns)],), rank=10 + k) for k, f in enumerate(families)]
        return tuple(base[: n_slots - 1] + [Slot("Additional Information", "additional", "suffix_list", rank=99)])

    contracts = {f"contract {c}": slots(c) for c in range(n_contracts)}
    return Rules(categories, contracts | {"generic": slots(0)}, {"generic": {2: ("Width", "Length"), 3: ("Width", "Length", "Height")}})
