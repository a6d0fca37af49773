"""Classification: phrases of a rule set against prepared texts, scored, ranked and checked against a group's habits.

Texts and phrases meet by an equi-join: runs of a text's words, without the gaps that a phrase may have between its
words, are looked up among the phrases, and the phrase's pattern decides. So a row costs its own words, whatever the
number of categories, and no row of text is multiplied by categories that cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.rules import Rules
from .learn import micro

#: Spaces of all scripts, said in full since engines differ in what their short form holds.
GAP = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\-"
ATOM = rf"([a-z0-9]+|[^a-z0-9{GAP}])"
#: Categories (one short row each) that are sent to all tasks; a larger table is joined by its size.
MOST_BROADCAST = 20_000


def phrase_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """classpath, kind (must, boost, veto), phrase of the categories that have a `must` phrase; a boost that is a `must`
    as well is not counted twice."""
    rows = [(c.classpath, kind, p) for c in rules.categories if c.must for kind in ("must", "boost", "veto") for p in dict.fromkeys(getattr(c, kind)) if p.strip() and not (kind == "boost" and p in c.must)]
    return spark.createDataFrame(rows, "classpath string, kind string, phrase string")


def matches(rows: DataFrame, rules: Rules, prepared: str = "prepared") -> DataFrame:
    """rows (row_index, prepared) with classpath, base, n_boost and phrases of every category that matches: any veto
    excludes, one `must` at least is needed."""
    hits = phrase_join(rows, phrase_table(rows.sparkSession, rules), "row_index", prepared)
    of = lambda kind: F.col("kind") == kind
    told = hits.groupBy("row_index", "classpath").agg(
        F.max(F.when(of("must"), F.length("phrase"))).alias("longest"),
        F.count_if(of("boost")).cast("int").alias("n_boost"),
        F.count_if(of("veto")).alias("vetoes"),
        F.sort_array(F.collect_set(F.when(~of("veto"), F.col("phrase")))).alias("phrases"),
    )
    base = 0.6 + 0.25 * F.least(F.col("longest") / 12.0, F.lit(1.0)) + fixed.BOOST * F.least("n_boost", F.lit(4))
    found = told.where("longest is not null and vetoes = 0").select("row_index", "classpath", base.alias("base"), "n_boost", "phrases")
    return rows.join(found, "row_index").select(*rows.columns, "classpath", "base", "n_boost", "phrases")


def ranked(rows: DataFrame, rules: Rules, prior: DataFrame | None = None) -> DataFrame:
    """row_index, grp, classpath, score, prior, rank: the two best categories of each row, ties by classpath."""
    found = matches(rows.select("row_index", "grp", "prepared"), rules).drop("prepared")
    if prior is None:
        found = found.withColumn("prior", F.lit(0.0))
    else:
        found = found.join(prior.select("grp", "classpath", F.col("share").alias("prior")), ["grp", "classpath"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
    scored = found.withColumn("score", F.col("base") + fixed.PRIOR * F.col("prior"))
    order = Window.partitionBy("row_index").orderBy(F.col("score").desc(), "classpath")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 2")


def classify(rows: DataFrame, rules: Rules, prior: DataFrame | None = None) -> DataFrame:
    """row_index, classpath, confidence, margin, runner_up, how: one row for each of rows (row_index, grp, prepared).

    Without a phrase, a group that is nearly always one category lends it with low confidence (how = 'group-prior');
    else the class is null (how = 'none')."""
    two = ranked(rows, rules, prior)
    best = two.groupBy("row_index").agg(
        F.max_by(F.struct("classpath", "score"), -F.col("rank")).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 2, F.col("classpath"))).alias("runner_up")
    )
    margin = F.col("b.score") - F.coalesce("second", F.lit(0.0))
    confidence = F.least(F.lit(0.99), 0.55 * F.least(F.col("b.score"), F.lit(1.0)) + 0.45 * F.least(margin / 0.4, F.lit(1.0)))
    lexical = best.select("row_index", F.col("b.classpath").alias("classpath"), micro(confidence).alias("confidence"), micro(margin).alias("margin"), "runner_up")
    out = rows.select("row_index", "grp").join(lexical, "row_index", "left")
    if prior is None:
        return out.select("row_index", "classpath", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("margin", F.lit(0.0)).alias("margin"), "runner_up", F.when(F.col("classpath").isNull(), "none").otherwise("lexical").alias("how"))
    lent = prior_only(prior)
    out = out.join(lent, "grp", "left")
    own, other = F.col("classpath").isNotNull(), F.col("lent").isNotNull()
    return out.select(
        "row_index", F.coalesce("classpath", "lent").alias("classpath"), F.coalesce("confidence", "lent_confidence", F.lit(0.0)).alias("confidence"), F.coalesce("margin", F.lit(0.0)).alias("margin"), "runner_up",
        F.when(own, "lexical").when(other, "group-prior").otherwise("none").alias("how"),
    )


def with_category(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows (classpath) with the category's leaf, department, klass, fine, product_name and contract, 'generic' where the
    class is null or unknown."""
    table = rules.category_table(rows.sparkSession)
    table = F.broadcast(table) if len(rules.categories) <= MOST_BROADCAST else table
    return rows.join(table, "classpath", "left").withColumn("contract", F.coalesce("contract", F.lit("generic")))


def prior_only(prior: DataFrame) -> DataFrame:
    """grp, lent, lent_confidence: what a group lends to rows without any phrase."""
    from .learn import prior_top

    top = prior_top(prior).where((F.col("share") >= fixed.PRIOR_ONLY_PURITY) & (F.col("total") >= fixed.PRIOR_ONLY_WEIGHT))
    return top.select("grp", F.col("classpath").alias("lent"), micro(0.45 * F.col("share"), 4).alias("lent_confidence"))


def phrase_candidates(rows: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key and the columns of `phrases`) of the phrases (phrase) that a text may hold; their pattern is not yet tried.

    Runs of as many atoms as a phrase may have are compared with phrases without their gaps, plural endings cut. Only
    keys and runs are exchanged, not texts; the phrases are joined by their size."""
    fold = lambda c: F.lower(F.translate(c, "İıſ", "iis"))
    most = phrases.agg(F.max(F.size(F.regexp_extract_all(fold("phrase"), F.lit(ATOM), F.lit(0))))).first()[0] or 1
    squeezed = phrases.withColumn("_g", F.regexp_replace(fold("phrase"), f"[{GAP}]+", ""))
    atoms = F.regexp_extract_all(fold(text), F.lit(ATOM), F.lit(0))

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("_a") - n + 1), lambda i: F.array_join(F.slice("_a", i, n), ""))
        return F.when(F.size("_a") >= n, made).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(runs, range(1, most + 1))))
    cut = F.array_distinct(F.flatten(F.transform(grams, lambda g: F.array(g, F.regexp_replace(g, "s$", ""), F.regexp_replace(g, "es$", "")))))
    listed = rows.select(key, atoms.alias("_a")).select(key, F.explode(cut).alias("_g"))
    return listed.join(squeezed, "_g").drop("_g").distinct()


def phrase_join(rows: DataFrame, phrases: DataFrame, key: str, prepared: str) -> DataFrame:
    """(key, classpath, kind, phrase) of the phrases (classpath, kind, phrase) that a text holds: candidates by their
    words, on which the pattern of the phrase decides."""
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.regexp_replace(F.regexp_replace(F.trim("phrase"), r"([^A-Za-z0-9\s\-])", r"\\$1"), r"[\s\-]+", r"[\\s\\-]*"), F.lit("(?:e?s)?(?![A-Za-z0-9])"))
    met = phrase_candidates(rows, phrases.select("classpath", "kind", "phrase"), key, prepared).withColumn("_p", pattern)
    return met.join(rows.select(key, prepared), key).where(F.expr(f"`{prepared}` rlike _p")).select(key, "classpath", "kind", "phrase")
