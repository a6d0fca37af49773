"""The catalogue engine: learn vocabularies and priors from a corpus, then enrich every row by them.

Learning is grouped aggregation; what it leaves is as small as the vocabulary and is materialised once. Enriching is
one wide projection with joins to those tables, so it scales with the rows and streams as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, units
from ..operators import cells as C
from ..operators import entity, extract, learn, propose, render, score, taxonomy
from ..sources import catalogue, rules as rule_files
from ..sources.rules import Rules
from ..sources.scratch import stored


@dataclass
class Vocabulary:
    """The learned tables."""

    aliases: DataFrame
    brand_prior: DataFrame
    group_prior: DataFrame
    series: DataFrame
    brands: DataFrame
    candidates: DataFrame
    product_types: DataFrame

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark, path: str) -> Vocabulary:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


    @classmethod
    def of_artefact(cls, tables: dict[str, DataFrame]) -> Vocabulary:
        """The vocabulary that a JSON document holds (read_vocabulary()); it has no priors, which are learnt from rows."""
        brands = tables["brands"].drop("key").withColumnRenamed("ord", "seen")
        attested = brands.select("canonical", "attested")
        aliases = tables["alias_index"].join(attested, "canonical", "left").select("alias", "canonical", F.coalesce("attested", F.lit(False)).alias("attested"))
        empty = lambda schema: brands.sparkSession.createDataFrame([], schema)
        priors = empty("grp string, brand string, hits long, purity double"), empty("grp string, classpath string, weight double, total double, share double")
        return cls(aliases, *priors, tables["series"].select("name", "n"), brands, tables["brand_candidates"].drop("key").withColumnRenamed("ord", "seen"), tables["product_types"].drop("ord", "key"))


def artefact(rows: DataFrame, vocabulary: Vocabulary) -> dict[str, DataFrame]:
    """The sections of the JSON document (write_vocabulary()) of a vocabulary and the rows that it was learnt from."""
    entry = lambda df, attested: df.select(F.col("seen").alias("ord"), F.col("canonical").alias("key"), "canonical", "aliases", "groups", "support", "linkage", "confidence", F.lit(attested).alias("attested"), "mean_position", (F.col("rejection") if "rejection" in df.columns else F.lit("")).alias("rejection"))
    plain = lambda df: df.withColumn("ord", F.lit(0).cast("long"))  # noqa: E731  # sections whose order tells nothing
    return {
        "n_rows": rows.agg(F.count(F.lit(1)).alias("n_rows")), "brands": entry(vocabulary.brands, True), "brand_candidates": entry(vocabulary.candidates, False), "alias_index": plain(vocabulary.aliases.select("alias", "canonical")),
        "product_types": plain(vocabulary.product_types.withColumn("key", F.col("canonical"))), "series": vocabulary.series.withColumn("ord", -F.col("n")), "groups": plain(learn.groups(rows).select("grp", "name", "code")),
        "unknown_units": plain(learn.unknown_units(rows)), "observed_families": plain(learn.families(rows)), "value_vocab": plain(learn.finishes(rows).withColumn("kind", F.lit("finish"))),
    }


def prepared(rows: DataFrame) -> DataFrame:
    """rows with grp, body and prepared (the text that categories are matched against)."""
    if "prepared" in rows.columns:
        return rows
    made = rows.withColumn("grp", text.group_key(F.col("Part_Manuf"))).withColumn("body", text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num")))
    return made.withColumn("prepared", text.prepare_text(F.col("Part_Desc"), F.col("Mfg_Part_Num")))


def dealt(rows: DataFrame) -> DataFrame:
    """rows by row_index over as many partitions as exchanges have. Work on a row is heavy and its bytes few, so neither
    the files' splits nor a count of bytes deals it well; joins by row_index need no other exchange of these rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_index")


def shared(rows: DataFrame) -> DataFrame:
    """rows with what several passes over them read: grp, body, prepared, found (measurements) and candidates (for brand
    tokens), written once."""
    if "found" in rows.columns:
        return rows
    found = F.transform(units.find_measurements("body"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["family"].alias("family")))
    made = prepared(dealt(rows)).withColumn("candidates", learn.candidate_tokens(F.col("Part_Desc"), F.col("Mfg_Part_Num"))).withColumn("found", found)
    return stored(made, "rows")


def brand_vocabulary(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aliases: alias, canonical, attested; brands; candidates). Product names come first, without any knowledge of
    brands, since their words are never linked to a brand that they merely resemble."""
    words = stored(learn.product_words(learn.product_types(rows)), "words")
    links = stored(learn.link_brands(rows, words, stored), "links")
    known, candidates = learn.brands(rows, links)
    known = stored(known, "brands")
    entries = known.select("canonical", F.explode(F.array_union("aliases", F.array("canonical"))).alias("alias"), F.col("seen").alias("ord"))
    return stored(learn.alias_index(entries).withColumn("attested", F.lit(True)), "aliases"), known, candidates


def brand_aliases(rows: DataFrame) -> DataFrame:
    """alias, canonical, attested."""
    return brand_vocabulary(rows)[0]


def learned(rows: DataFrame, rules: Rules) -> Vocabulary:
    rows = shared(rows)
    aliases, brands, candidates = brand_vocabulary(rows)
    ready = prepared(rows).select("row_index", "grp", "prepared")
    seen = taxonomy.classify(ready, rules).join(ready.select("row_index", "grp"), "row_index")
    prior = stored(learn.group_prior(seen.where("grp <> '<ungrouped>'").select("grp", "classpath", "confidence")), "group-prior")
    # The second pass over product language knows the brands and leaves them out.
    told = learn.own_aliases(rows, aliases)
    return Vocabulary(aliases, stored(learn.brand_prior(rows, aliases), "brand-prior"), prior, stored(learn.series(told), "series"), brands, candidates, learn.product_types(told))


def enriched(rows: DataFrame, rules: Rules, vocabulary: Vocabulary, client=None, cache: str | None = None, most: int = 250) -> DataFrame:
    """One row a row: the input, classification, brand, filled slots and the five channels. A `client` (request to
    reply) proposes values for slots that are still blank; see propose.proposed()."""
    ready = dealt(prepared(rows.drop("found", "candidates")))
    found = taxonomy.classify(ready.select("row_index", "grp", "prepared"), rules, vocabulary.group_prior)
    brands = entity.resolve_brands(rows, vocabulary.aliases, vocabulary.brand_prior, brands=vocabulary.brands)
    out = ready.join(found, "row_index").join(brands.withColumnsRenamed({"confidence": "brand_confidence", "source": "brand_source"}), "row_index")
    out = taxonomy.with_category(out, rules)
    out = render.with_implied(render.with_slots(extract.extract(out, rules, vocabulary.series), rules), rules)
    out = propose.proposed(out, rules, client, cache, most)
    named = F.coalesce("product_name", text.fallback_name(F.col("body")))
    out = out.withColumn("product_name", named).withColumn("mpn", F.trim("Mfg_Part_Num")).withColumn("series", F.lit("")).withColumn("with_phrase", F.lit("")).withColumn("maker", F.col("manufacturer")).withColumn("manufacturer", F.col("maker.value"))
    out = render.channels(out)
    return out.withColumn("approvals", text.approvals(F.col("prepared")))


def cells(rows: DataFrame, rules: Rules) -> DataFrame:
    """The output cells of enriched rows."""
    cell, known = C.cell, F.col("classpath").isNotNull()
    how = F.when(F.col("how") == "lexical", "lexicon_exact").when(F.col("how") == "group-prior", "derived").otherwise("unresolved")
    crosswalk = F.when(known, "crosswalk").otherwise("unresolved")
    made = [
        cell("BRAND_NAME", F.col("brand"), F.col("brand_source"), F.concat(F.lit("brand:"), "rung"), F.col("brand_confidence")),
        cell("MANUFACTURER_NAME", F.col("maker.value"), F.col("maker.source"), F.col("maker.rule"), F.col("maker.confidence")),
        cell("MANUFACTURER_PART_NUMBER", F.col("mpn"), "input_copy", "mpn", 1.0),
        cell("Classpath", F.coalesce("classpath", F.lit("")), how, F.concat(F.lit("taxonomy:"), "how"), F.col("confidence")),
        cell("Dept", F.coalesce("department", F.lit("")), crosswalk, "taxonomy:dept", F.col("confidence")),
        cell("Class", F.coalesce("klass", F.lit("")), crosswalk, "taxonomy:class", F.col("confidence")),
        cell("Fine", F.coalesce("fine", F.lit("")), crosswalk, "taxonomy:fine", F.col("confidence")),
        cell("Product Name", F.col("product_name"), "derived", "taxonomy:product-name", F.col("confidence")),
        cell("SHORT_DESC", F.col("SHORT_DESC"), "derived", "channel:SHORT_DESC", 0.9),
        cell("LONG_DESC1", F.col("LONG_DESC1"), "derived", "channel:LONG_DESC1", 0.9),
        cell("RETAIL_DESC", F.col("RETAIL_DESC"), "derived", "channel:RETAIL_DESC", 0.88),
        cell("MOBILE_DESC", F.col("MOBILE_DESC"), "constraint_solver", "channel:MOBILE_DESC", F.when(F.length("MOBILE_DESC") >= fixed.MOBILE_MIN, 0.9).otherwise(0.55)),
        cell("INVOICE_DESC", F.col("INVOICE_DESC"), "constraint_solver", "channel:INVOICE_DESC", 0.92),
        cell("MARKETING_DESCRIPTION", F.col("marketing"), F.when(F.col("marketing") != "", "llm").otherwise("unresolved"), "proposed:MARKETING_DESCRIPTION", F.when(F.col("marketing") != "", 0.5).otherwise(0.0)),
        cell("STANDARD_APPROVALS", F.col("approvals"), F.when(F.col("approvals") != "", "regex_extract").otherwise("unresolved"), "approvals", 0.9),
        cell("MFR URL", F.coalesce(text.url_of(F.col("brand_plain"), F.col("mpn")), F.lit("")), F.when(text.url_of(F.col("brand_plain"), F.col("mpn")).isNotNull(), "derived").otherwise("not_derivable"), "mfr-url", 0.75),
    ]
    assets = F.transform(F.map_entries(F.coalesce(text.asset_names(F.col("brand"), F.col("mpn")), F.create_map().cast("map<string,string>"))), lambda e: cell(e["key"], e["value"], "derived", "asset:name", 0.9))
    return C.passthrough(rows).unionByName(C.exploded(rows, array=F.concat(F.array(*made), assets))).unionByName(C.attribute_cells(rows)).unionByName(C.not_derivable(rows))


def checked(rows: DataFrame, rules: Rules) -> DataFrame:
    """The compliance inputs of score.verdicts()."""
    lov = {s.label: sorted({v for slots in rules.contracts.values() for t in slots if t.label == s.label for v in t.lov}) for slots in rules.contracts.values() for s in slots if s.lov}
    allowed = F.create_map(*(x for k, vs in lov.items() for x in (F.lit(k), F.array(*map(F.lit, vs))))) if lov else F.create_map().cast("map<string,array<string>>")
    wrong = F.filter("slots", lambda s: (F.trim(s["value"]) != "") & F.element_at(allowed, s["label"]).isNotNull() & ~F.array_contains(F.element_at(allowed, s["label"]), s["value"]))
    return rows.select("row_index", F.length("INVOICE_DESC").alias("invoice_length"), F.length("MOBILE_DESC").alias("mobile_length"), F.size(wrong).alias("n_lov_violations"), F.col("classpath").isNull().alias("unclassified"), (F.col("brand_plain") == "").alias("brand_unresolved"), "margin", "runner_up")


def run(rows: DataFrame, rules: Rules, client=None, cache: str | None = None, most: int = 250) -> tuple[DataFrame, DataFrame, DataFrame, Vocabulary]:
    """(enriched rows, cells, verdicts, vocabulary). Enriched rows are written once: cells of each kind, and what is
    checked, read them."""
    rows = shared(rows)
    vocabulary = learned(rows, rules)
    out = stored(enriched(rows, rules, vocabulary, client, cache, most), "enriched")
    made = cells(out, rules)
    return out, made, score.verdicts(made, checked(out, rules)), vocabulary


def build(spark, input_path: str, rules_path: str | None = None, limit: int | None = None) -> tuple[DataFrame, Rules]:
    """(rows, rules) of a run: `limit` keeps the first rows, before anything is learnt from them."""
    rows = catalogue.read_input(spark, input_path)
    missing = catalogue.require_columns(rows)
    if missing:
        raise ValueError(f"{input_path} lacks the columns {', '.join(missing)}")
    rows = rows if limit is None else rows.orderBy("row_index").limit(limit)
    return rows, rule_files.load(rules_path) if rules_path else rule_files.demo()
