"""The optional proposer: a client asked for the slots that rules left blank, its answers cached and checked.

Off unless a client is given. Distinct requests are asked once; a reply counts only where it passes `accepted`.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, units
from ..sources import catalogue
from ..sources.rules import Rules


#: What a model says for nothing, and the columns that it may fill besides attributes.
NOTHING = ("null", "none", "unknown", "n/a")
PROPOSABLE = ("MARKETING_DESCRIPTION",)


@dataclass(frozen=True)
class Config:
    """Where the client's model is and how often it may be asked."""

    model: str = ""
    base_url: str = ""
    api_key: str = ""
    max_calls: int = 250
    timeout_s: float = 30.0

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        return cls(env.get("PROPOSER_MODEL", ""), env.get("PROPOSER_BASE_URL", ""), env.get("PROPOSER_API_KEY", ""), int(env.get("PROPOSER_MAX_CALLS", 250)))


def build(config: Config) -> Callable[[str], str] | None:
    """A client that asks the configured model over HTTP (the common chat protocol); None where none is configured."""
    if not (config.model and config.base_url):
        return None

    def ask(request: str) -> str:
        import json
        import urllib.request

        body = json.dumps({"model": config.model, "temperature": 0, "messages": [{"role": "user", "content": request}]}).encode()
        call = urllib.request.Request(config.base_url.rstrip("/") + "/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {config.api_key}"})
        with urllib.request.urlopen(call, timeout=config.timeout_s) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""

    return ask


def probe(client: Callable[[str], str] | None) -> bool:
    """Whether a client answers at all."""
    try:
        return client is not None and isinstance(client("{}"), str)
    except Exception:  # a client that cannot be reached is no reason to stop a run
        return False


def requests(rows: DataFrame) -> DataFrame:
    """row_index, key and request (JSON) of the rows (row_index, body, classpath, blanks: array) with blanks."""
    asked = rows.where(F.size("blanks") > 0).select("row_index", F.to_json(F.struct(F.sort_array("blanks").alias("blanks"), F.col("body").alias("description"), "classpath")).alias("request"))
    return asked.withColumn("key", F.sha2(F.col("request").cast("binary"), 256))


def replies(asked: DataFrame, client: Callable[[str], str], cache: str | None = None, most: int = 250) -> DataFrame:
    """key, response of the distinct requests: from the cache, and at most `most` new ones from the client (the
    feature's own call limit, by key order)."""
    spark = asked.sparkSession
    distinct = asked.groupBy("key").agg(F.min("request").alias("request"))
    known = catalogue.read_cache(spark, cache) if cache else spark.createDataFrame([], "key string, response string")
    new = distinct.join(known.select("key"), "key", "left_anti").orderBy("key").limit(most)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "response": [answer(r) for r in b["request"]]})

    def answer(request: str) -> str:
        try:
            return client(request)
        except Exception:  # a proposer must never break a run: an error is an empty reply
            return ""

    return distinct.select("key").join(known, "key").unionByName(new.mapInPandas(ask, "key string, response string"))


def accepted(value: Column, uom: Column, lov: Column, lo: Column, hi: Column, family: Column) -> Column:
    """Whether a proposed value may fill a slot: permitted, within bounds, in a unit of the slot's family."""
    number = units.to_decimal(value)
    in_family = (F.coalesce(family, F.lit("")) == "") | (units.unit_of(uom, "family") == family)
    return (F.trim(value) != "") & ((F.size(lov) <= 0) | F.array_contains(lov, value)) & F.coalesce(number >= lo, F.lit(True)) & F.coalesce(number <= hi, F.lit(True)) & F.coalesce(in_family, F.lit(False))


def proposals(response: DataFrame) -> DataFrame:
    """key, label, value of the replies that hold a JSON object of strings, fenced or not."""
    parsed = F.from_json(text.first_json(F.col("response")), "map<string,string>")
    return response.select("key", F.explode(parsed).alias("label", "value"))


def _slot_rules(rules: Rules) -> Column:
    """Map of contract, a line feed and label to the slot's limits."""
    one = lambda s: F.struct(F.array(*map(F.lit, s.lov)).cast("array<string>").alias("lov"), F.lit(s.lo).cast("double").alias("lo"), F.lit(s.hi).cast("double").alias("hi"), F.lit(s.family if s.kind == "measure" else "").alias("family"), F.lit(s.kind in ("measure", "count")).alias("number"))
    return F.create_map(*(x for name, slots in rules.contracts.items() for s in slots for x in (F.lit(f"{name}\n{s.label}"), one(s))))


def proposed(rows: DataFrame, rules: Rules, client: Callable[[str], str] | None, cache: str | None = None, most: int = 250) -> DataFrame:
    """rows (row_index, body, classpath, contract, slots) whose blank slots hold what the client proposed and the rules
    allow, with `marketing` ('' for none) and `outcomes`: label and outcome (accepted, not in list, out of bounds) of
    every proposal. Without a client nothing changes but the two columns.

    A reply is a JSON object: `attributes` (label to value, or to {value, uom}) and `marketing_description`."""
    none = F.array().cast("array<struct<label:string,outcome:string>>")
    if client is None:
        return rows.withColumn("marketing", F.lit("")).withColumn("outcomes", none)
    blank = lambda s: (F.trim(s["value"]) == "") & ~s["kind"].isin("additional", "model")
    asked = requests(rows.select("row_index", "body", "classpath", F.transform(F.filter("slots", blank), lambda s: s["label"]).alias("blanks")))
    told = replies(asked, client, cache, most).withColumn("json", text.first_json(F.col("response")))
    told = told.select("key", F.from_json(F.get_json_object("json", "$.attributes"), "map<string,string>").alias("said"), F.coalesce(F.trim(F.get_json_object("json", "$.marketing_description")), F.lit("")).alias("marketing"))
    out = rows.join(asked.select("row_index", "key").join(told, "key").drop("key"), "row_index", "left").withColumn("marketing", F.coalesce("marketing", F.lit("")))
    limits = _slot_rules(rules)

    def judged(s: Column) -> Column:
        raw = F.element_at("said", s["label"])
        entry = F.coalesce(F.get_json_object(raw, "$.value"), raw)
        value, uom = F.trim(entry), F.coalesce(F.trim(F.get_json_object(raw, "$.uom")), F.lit(""))
        rule = F.coalesce(F.element_at(limits, F.concat(F.col("contract"), F.lit("\n"), s["label"])), F.element_at(limits, F.concat(F.lit("generic\n"), s["label"])))
        empty = value.isNull() | (value == "") | F.lower(value).isin(*NOTHING)
        listed = (F.size(rule["lov"]) <= 0) | F.array_contains(rule["lov"], value)
        sound = ~rule["number"] | (units.to_decimal(value).isNotNull() & accepted(value, uom, F.array().cast("array<string>"), rule["lo"], rule["hi"], rule["family"]))
        outcome = F.when(~blank(s) | empty, None).when(~listed, "not in list").when(~F.coalesce(sound, F.lit(False)), "out of bounds").otherwise("accepted")
        return F.struct(s["label"].alias("label"), value.alias("value"), F.when(rule["family"] != "", F.coalesce(units.unit_of(uom, "canonical"), uom)).otherwise(uom).alias("uom"), outcome.alias("outcome"))

    out = out.withColumn("_j", F.transform("slots", judged))
    take = lambda s, j: F.when(j["outcome"] == "accepted", s.withField("value", j["value"]).withField("uom", j["uom"]).withField("source", F.lit("llm")).withField("rule", F.concat(F.lit("proposed:"), s["label"])).withField("confidence", F.lit(0.5))).otherwise(s)
    found = F.transform(F.filter("_j", lambda j: j["outcome"].isNotNull()), lambda j: F.struct(j["label"].alias("label"), j["outcome"].alias("outcome")))
    return out.withColumn("slots", F.zip_with("slots", "_j", take)).withColumn("outcomes", F.coalesce(found, none)).drop("_j", "said")


def stats(rows: DataFrame) -> DataFrame:
    """One row over proposed() rows: accepted, rejected_not_in_lov, rejected_out_of_bounds, marketing."""
    n = lambda what: F.coalesce(F.sum(F.size(F.filter("outcomes", lambda o: o["outcome"] == what))), F.lit(0))
    return rows.agg(n("accepted").alias("accepted"), n("not in list").alias("rejected_not_in_lov"), n("out of bounds").alias("rejected_out_of_bounds"), F.count_if(F.col("marketing") != "").alias("marketing"))
