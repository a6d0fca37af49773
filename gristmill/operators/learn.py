"""What a catalogue teaches: groups, brand tokens, attested brands, aliases, product types, series and priors.

Every table is a grouped aggregate of the corpus with map-side combining. Tables joined back are as small as the
vocabulary, and are joined by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, units

COLUMNS = ("DIB_Brand", "E1_Brand", "Unilog_Brand")
PRODUCT_WORD = r"([A-Za-z][A-Za-z'\-]*)"


def micro(x: Column, places: int = 6) -> Column:
    """A double rounded half up at a place, by steps that every engine takes alike."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5).cast("double") / scale


def candidate_tokens(desc: Column, mpn: Column) -> Column:
    """Words of a description that may name a brand."""
    low_mpn = F.lower(mpn)
    known = [*fixed.NEVER_BRAND, *fixed.EXPANSIONS, *units.aliases()]
    body = text.strip_noise(text.strip_leading_mpn(desc, mpn))
    return F.filter(text.tokens(body), lambda t: (F.length(t) >= 3) & t.rlike(r"^[A-Za-z][A-Za-z'\-]*$") & ~F.lower(t).isin(*known) & ~F.contains(low_mpn, F.lower(t)))


def groups(rows: DataFrame) -> DataFrame:
    """Rows of each account: grp, name, code, n_rows; placeholders are one group, '<ungrouped>'."""
    keyed = rows.select(text.group_key(F.col("Part_Manuf")).alias("grp"))
    return keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows")).select("grp", text.account_name(F.col("grp")).alias("name"), text.account_code(F.col("grp")).alias("code"), "n_rows")


def token_positions(rows: DataFrame) -> DataFrame:
    """row_index, grp, token, low, position (of the first occurrence, over the number of candidates)."""
    candidates = F.col("candidates") if "candidates" in rows.columns else candidate_tokens(F.col("Part_Desc"), F.col("Mfg_Part_Num"))
    listed = rows.select("row_index", text.group_key(F.col("Part_Manuf")).alias("grp"), candidates.alias("c"))
    return listed.select("row_index", "grp", F.greatest(F.size("c"), F.lit(1)).alias("n"), F.posexplode("c").alias("pos", "token")).withColumn("low", F.lower("token"))


def mean_positions(rows: DataFrame) -> DataFrame:
    """low, mean_position, n: where a token first stands in its rows, 0 the head and 1 the tail."""
    firsts = token_positions(rows).groupBy("row_index", "low").agg(F.min(F.col("pos") / F.col("n")).alias("p"))
    return firsts.groupBy("low").agg(micro(F.avg("p")).alias("mean_position"), F.count(F.lit(1)).alias("n"))


def salience(rows: DataFrame) -> DataFrame:
    """grp, token, hits, coverage, n_token_groups, salience of every token in every group: a TF-IDF over groups.

    Coverage counts spellings, the number of groups ignores case."""
    found = token_positions(rows).select("row_index", "grp", "token", "low").distinct()
    sizes = rows.groupBy(text.group_key(F.col("Part_Manuf")).alias("grp")).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.count(F.lit(1)).alias("n_groups"))
    hits = found.groupBy("grp", "token", "low").agg(F.count(F.lit(1)).alias("hits"))
    spread = hits.groupBy("low").agg(F.count_distinct("grp").alias("n_token_groups"))
    joined = hits.join(spread, "low").join(sizes, "grp").join(F.broadcast(total))  # one row
    coverage = F.col("hits") / F.col("size")
    return joined.select("grp", "token", "hits", micro(coverage).alias("coverage"), "n_token_groups", micro(coverage * F.log(F.col("n_groups") / F.col("n_token_groups"))).alias("salience"))


def brand_tokens(rows: DataFrame) -> DataFrame:
    """The tokens salient enough to name a brand of their group."""
    return salience(rows).where((F.col("coverage") >= fixed.MIN_COVERAGE) & (F.col("n_token_groups") <= fixed.MAX_GROUPS) & (F.col("salience") >= fixed.MIN_SALIENCE))


def stacked_brands(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """row_index, grp, column_rank, value of every brand column that holds one."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("column_rank"), F.col(c).alias("raw")) for i, c in enumerate(columns)))).alias("b")
    flat = rows.select("row_index", text.group_key(F.col("Part_Manuf")).alias("grp"), each).select("row_index", "grp", "b.column_rank", "b.raw")
    return flat.where(~text.is_placeholder(F.col("raw"))).withColumn("value", text.clean(F.col("raw"))).where(~text.is_placeholder(F.col("value"))).drop("raw")


def attested_brands(rows: DataFrame) -> DataFrame:
    return stacked_brands(rows).groupBy("value").agg(F.count(F.lit(1)).alias("support"))


def link_tiers(rows: DataFrame) -> DataFrame:
    """tier, ord, name, strongest evidence first: the brand columns, brands that shorthand stands for, account heads.
    Of spellings that differ in case alone the first seen counts; `ord` is where it was seen."""
    columns = stacked_brands(rows).select(F.col("column_rank").alias("tier"), F.col("value").alias("name"), F.col("row_index").alias("ord"))
    heads = rows.select(F.lit(len(COLUMNS) + 1).alias("tier"), text.account_head(text.account_name(F.col("Part_Manuf"))).alias("name"), F.col("row_index").alias("ord"))
    known = rows.sparkSession.createDataFrame([(len(COLUMNS), i, v) for i, v in enumerate(dict.fromkeys(fixed.BRAND_SHORTHAND.values()))], "tier int, ord long, name string")
    each = columns.unionByName(heads.where("name <> ''")).unionByName(known).withColumn("ord", F.col("ord").cast("long"))
    first = F.min(F.struct("ord", "name")).alias("f")
    return each.groupBy("tier", F.lower("name").alias("low")).agg(first).select("tier", "f.ord", "f.name")


def link_brands(rows: DataFrame, product: DataFrame, store=lambda df, name: df) -> DataFrame:
    """grp, token, hits, position, seen, canonical, linkage, confidence, attested of every brand token, by the first of:
    its group's favourite column value, if the two agree; a name that it is but for case; if it is no product word
    (`product`: low), the closest name of the first tier with one that is close enough. What is left is unattested.
    `store` (frame, name) may write what is used several times."""
    from . import entity

    seen = token_positions(rows).groupBy("grp", "token").agg(F.min("row_index").alias("seen"))
    positions = mean_positions(rows).select("low", F.col("mean_position").alias("position"))
    tokens = brand_tokens(rows).withColumn("low", F.lower("token")).join(positions, "low", "left").join(seen, ["grp", "token"], "left")
    tokens = store(tokens.select("grp", "token", "low", "hits", F.coalesce("position", F.lit(0.5)).alias("position"), "seen"), "tokens")
    order = (F.col("row_index") * 4 + F.col("column_rank")).alias("seen")
    votes = stacked_brands(rows, COLUMNS[:2]).select("grp", "value", order)
    favourites = first_mode(votes, "grp", "value", "seen").withColumnRenamed("value", "name")
    tiers = store(link_tiers(rows), "tiers")
    own = entity.group_links(tokens, favourites).select("grp", "token", F.col("name").alias("own"), F.col("hits").alias("votes"))
    exact = entity.exact_links(tokens, tiers).select("token", F.col("name").alias("exact"), F.col("tier").alias("exact_tier"))
    blocked = product.select("low", F.lit(True).alias("blocked"))
    out = store(tokens.join(own, ["grp", "token"], "left").join(exact, "token", "left").join(blocked, "low", "left"), "linked")
    open_ = out.where("own is null and exact is null and blocked is null").select("token")
    fuzzy = entity.tiered_links(open_, tiers).select("token", F.col("name").alias("fuzzy"), F.col("tier").alias("fuzzy_tier"), "score")
    labels = F.array(*map(F.lit, ("dib-brand-column", "e1-brand-column", "unilog-brand-column", "known-shorthand", "account-name-head")))
    at = lambda tier: F.element_at(labels, tier + 1)
    made = lambda name, linkage, confidence: F.struct(name.alias("canonical"), linkage.alias("linkage"), confidence.cast("double").alias("confidence"))
    self_name = text.title_case(F.col("token"))
    found = (
        F.when(F.col("own").isNotNull(), made(F.col("own"), F.concat(F.lit("group-brand-column("), "votes", F.lit(" rows)")), F.lit(0.97)))
        .when(F.col("exact").isNotNull(), made(F.col("exact"), F.concat(F.lit("exact:"), at(F.col("exact_tier"))), F.lit(0.95)))
        .when(F.col("blocked"), made(self_name, F.lit("blocked:product-vocabulary"), F.lit(0.0)))
        .when(F.col("fuzzy").isNotNull(), made(F.col("fuzzy"), F.concat(F.lit("fuzzy:"), at(F.col("fuzzy_tier")), F.lit("("), F.rint("score").cast("int"), F.lit(")")), F.col("score") / 100))
        .otherwise(made(self_name, F.lit("unlinked"), F.lit(0.0)))
    )
    told = out.join(fuzzy, "token", "left").withColumn("f", found)
    return told.select("grp", "token", "hits", "position", "seen", "f.*", (F.col("f.confidence") > 0).alias("attested"))


#: From here on a weight of 2**-r is 0.
LAST = 1100


def brand_entries(links: DataFrame, attested: DataFrame | None = None) -> DataFrame:
    """canonical, aliases, groups, support, linkage, confidence, mean_position, seen of what link_brands() tells, folded
    in the order in which groups and tokens were seen; with `attested` (value, support, seen) every such value is an
    entry and adds its support.

    The mean position is a running one: each link moves it half way to its own, from the first that is not 0. So the
    link that is r-th from the end weighs 2**-r, the first as much again, and links beyond the last LAST weigh nothing
    that a double holds. Everything else is a group's aggregate, by spelling first: no row holds a brand's links."""
    link = F.struct("seen", "grp", "token", "position", "linkage", "hits")
    made = links.select("canonical", "token", "grp", "hits", "confidence", "seen", "position", link.alias("l"))
    spelled = made.groupBy("canonical", F.lower("token").alias("low")).agg(
        F.min("l").alias("l"), F.min(F.when(F.col("position") > 0, F.col("l"))).alias("begin"), F.sum("hits").alias("hits"), F.max("confidence").alias("confidence"), F.min("seen").alias("seen"), F.collect_set("grp").alias("groups")
    )
    some = spelled.groupBy("canonical").agg(
        F.transform(F.sort_array(F.collect_list("l")), lambda x: x["token"]).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("groups")))).alias("groups"), F.sum("hits").alias("support"),
        F.min("l")["linkage"].alias("linkage"), F.max("confidence").alias("confidence"), F.min("begin").alias("begin"), F.min("seen").alias("seen"),
    )
    last = made.select("canonical", "l", F.row_number().over(Window.partitionBy("canonical").orderBy(F.col("l").desc())).alias("r")).where(F.col("r") <= LAST)
    last = last.join(some.select("canonical", "begin"), "canonical")
    weight = F.pow(F.lit(2.0), -F.col("r"))
    means = last.groupBy("canonical").agg(F.sum(F.col("l.position") * weight).alias("most"), F.min(F.when(F.col("l").eqNullSafe(F.col("begin")), F.col("l.position") * weight)).alias("more"))
    halved = F.coalesce("most", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
    out = some.join(means, "canonical").select("canonical", "aliases", "groups", "support", "linkage", "confidence", micro(halved).alias("mean_position"), "seen")
    if attested is None:
        return out
    told = attested.select(F.col("value").alias("canonical"), F.col("support").alias("_n"), F.col("seen").alias("_seen"))
    both = out.join(told, "canonical", "full_outer")
    none = F.array().cast("array<string>")
    return both.select(
        "canonical", F.coalesce("aliases", F.array("canonical")).alias("aliases"), F.coalesce("groups", none).alias("groups"), (F.coalesce("support", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("support"),
        F.coalesce("linkage", F.lit("attested-column")).alias("linkage"), F.coalesce("confidence", F.lit(0.99)).alias("confidence"), F.coalesce("mean_position", F.lit(0.0)).alias("mean_position"), F.coalesce("seen", F.col("_seen") + (1 << 40)).alias("seen"),
    )


def canonical_brands(entries: DataFrame) -> DataFrame:
    """canonical of every entry, in order."""
    return entries.select("canonical").orderBy("canonical")


def brands(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(brands, candidates): entries of the attested links and column values, and of the rest for review, with why they
    were refused; a candidate that a column attests is no candidate any more."""
    told = stacked_brands(rows).groupBy("value").agg(F.count(F.lit(1)).alias("support"), F.min("row_index").alias("seen"))
    known = brand_entries(links.where("attested"), told)
    open_ = brand_entries(links.where("not attested")).join(told.select(F.col("value").alias("canonical")), "canonical", "left_anti")
    why = F.when(F.col("linkage").startswith("blocked:"), "token is product vocabulary, not a brand").otherwise(f"no attested spelling within {fixed.LINK_THRESHOLD} similarity")
    side = F.when(F.col("mean_position") < 0.4, "head").otherwise("tail")
    return known, open_.withColumn("rejection", F.format_string("%s; mean position %.2f (%s-weighted)", why, "mean_position", side))


def alias_index(entries: DataFrame) -> DataFrame:
    """alias to canonical: of the canonicals (canonical, alias, ord) that share an alias the longest, then the first."""
    both = entries.select("canonical", F.explode(F.array("alias", "canonical")).alias("a"), "ord").withColumn("alias", F.lower("a"))
    best = F.max_by("canonical", F.struct(F.length("canonical"), -F.col("ord"), F.col("canonical"))).alias("canonical")
    return both.groupBy("alias").agg(best)


def resolved(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """values with `canonical`: what the alias index has for `value`, or the value."""
    known = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return values.join(known, F.lower("value") == F.col("_a"), "left").withColumn("canonical", F.coalesce("_c", "value")).drop("_a", "_c")


def first_mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, hits, total: the most frequent value of a key, the first seen among equals."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("hits"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(value, "hits"), F.struct(F.col("hits"), -F.col("seen"))).alias("b")
    return counts.groupBy(key).agg(best, F.sum("hits").alias("total")).select(key, f"b.{value}", "b.hits", "total")


def brand_prior(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """grp, brand, hits, purity of the groups whose brand columns agree enough."""
    votes = stacked_brands(rows, COLUMNS[:2]).where("grp <> '<ungrouped>'")
    votes = resolved(votes, aliases) if aliases is not None else votes.withColumn("canonical", F.col("value"))
    votes = votes.select("grp", text.strip_marks(F.col("canonical")).alias("brand"), (F.col("row_index") * 4 + F.col("column_rank")).alias("seen"))
    mode = first_mode(votes, "grp", "brand", "seen").withColumn("purity", micro(F.col("hits") / F.col("total")))
    return mode.where((F.col("purity") >= fixed.BRAND_PURITY) & (F.col("hits") >= fixed.BRAND_ROWS)).select("grp", "brand", "hits", "purity")


def head_phrase(body: Column, measured: Column, aliases: Column | None = None) -> Column:
    """The words that name the product: the last four of the last segment that has any, without measurements and aliases."""
    cut = F.aggregate(F.reverse(F.array_sort(F.transform(measured, lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))), body, lambda acc, m: F.concat(F.substring(acc, F.lit(1), m["s"]), F.lit(" "), F.substring(acc, m["e"] + 1, F.length(acc))))
    segments = F.split(cut, r"\s+-\s+|\s*[|;]\s*")

    def words(s: Column) -> Column:
        found = F.filter(F.regexp_extract_all(s, F.lit(PRODUCT_WORD), F.lit(0)), lambda w: (F.length(w) > 1) | (F.lower(w) == "t"))
        return found if aliases is None else F.filter(found, lambda w: ~F.array_contains(aliases, F.lower(w)))

    ending = lambda last: F.array_join(F.slice(last, F.greatest(F.size(last) - 3, F.lit(1)), F.lit(4)), " ")
    return text.let(F.filter(F.transform(segments, words), lambda w: F.size(w) > 0), lambda named: F.when(F.size(named) > 0, ending(F.element_at(named, -1))).otherwise(""))


def own_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with `aliases`: the words of a row's description that are aliases, in lower case. A join by words, so that
    the alias table may be of any size."""
    words = rows.select("row_index", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("Part_Desc", F.lit(PRODUCT_WORD), F.lit(0)), F.lower))).alias("alias"))
    found = words.join(aliases.select("alias").distinct(), "alias").groupBy("row_index").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return rows.join(found, "row_index", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def phrased(rows: DataFrame) -> DataFrame:
    """rows with body, found (its measurements) and phrase (the words that name the product). Words of a column `aliases`
    name no product; `body` and `found` are taken from rows that have them."""
    made = rows if "body" in rows.columns else rows.withColumn("body", text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num")))
    made = made if "found" in rows.columns else made.withColumn("found", units.find_measurements("body"))
    known = F.col("aliases") if "aliases" in rows.columns else None
    return made.withColumn("phrase", head_phrase(F.col("body"), F.col("found"), known))


def in_full(phrases: DataFrame) -> DataFrame:
    """phrases with canonical: the phrase in full, title case. Made of distinct phrases, it costs no row anything."""
    return phrases.withColumn("canonical", text.title_case(text.expand(F.col("phrase"))))


def product_types(rows: DataFrame) -> DataFrame:
    """canonical, support, groups and variants (sorted arrays) of the product names that occur twice or more.

    Empty phrases go last: a condition on the phrase itself would be tried on rows, and make each phrase twice."""
    account = text.clean(F.col("Part_Manuf"))
    made = phrased(rows).withColumn("grp", F.when(account == "", "<ungrouped>").otherwise(account))
    counts = made.groupBy("phrase", "grp").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("phrase").agg(F.sum("n").alias("n"), F.collect_set("grp").alias("grps"))
    variant = F.when(F.lower("canonical") != F.lower("phrase"), F.col("phrase"))
    groups = F.array_sort(F.array_distinct(F.flatten(F.collect_list("grps"))))
    return in_full(each).groupBy("canonical").agg(F.sum("n").alias("support"), groups.alias("groups"), F.array_sort(F.collect_set(variant)).alias("variants"), F.max(F.length("phrase")).alias("_said")).where("support >= 2 and _said > 0").drop("_said")


def product_words(types: DataFrame) -> DataFrame:
    """low: every word of the product names (canonical), in lower case."""
    return types.select(F.explode(F.regexp_extract_all("canonical", F.lit(PRODUCT_WORD), F.lit(0))).alias("w")).select(F.lower("w").alias("low")).distinct()


def families(rows: DataFrame) -> DataFrame:
    """canonical, family, n: the measurement families of each product name that occurs twice or more. One pass over rows."""
    counts = phrased(rows).groupBy("phrase", F.col("found.family").alias("families")).agg(F.count(F.lit(1)).alias("n"))
    told = in_full(counts).withColumn("support", F.sum("n").over(Window.partitionBy("canonical"))).where("support >= 2 and phrase <> ''")
    return told.select("canonical", "n", F.explode("families").alias("family")).groupBy("canonical", "family").agg(F.sum("n").alias("n"))


#: Word boundaries, spaces and digits of all scripts, said in full since engines differ in what their short forms hold.
_NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
_SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_WHOLE_RUN = rf"{_NO_WORD_BEFORE}([A-Z][a-z]+(?:{_SPACE}+(?:[A-Z][a-z]+|[IVX]+|\p{{Nd}}+|[A-Z]\+?))++)"


def title_runs(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with `run`, a row for each title-cased run anywhere in a text of any script."""
    return texts.withColumn("run", F.explode(F.regexp_extract_all(text, F.lit(_WHOLE_RUN), F.lit(1))))


def top_tokens(rows: DataFrame, most: int = 20) -> DataFrame:
    """token, n: the most frequent candidate tokens, a report of `most` rows."""
    return token_positions(rows).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token").limit(most)


def no_product_words(tokens: DataFrame, product: DataFrame) -> DataFrame:
    """The tokens (token) that are no product words (low)."""
    return tokens.select("token").distinct().join(product.select("low").distinct(), F.lower("token") == F.col("low"), "left_anti")


def series_runs(rows: DataFrame) -> DataFrame:
    """row_index, name: the title-cased runs of a description that may name a product line. A run with a word of the
    row's product phrase is none; words of a column `aliases` are left out; two words must stay, without shorthand and
    units among them."""
    known = [*fixed.EXPANSIONS, *units.aliases()]
    made = phrased(rows).select("row_index", "phrase", *(["aliases"] if "aliases" in rows.columns else []), F.explode(F.regexp_extract_all("body", F.lit(_WHOLE_RUN), F.lit(1))).alias("run"))
    words = F.filter(F.split("run", rf"{_SPACE}+"), lambda w: w != "")
    low = lambda x: F.transform(x, F.lower)
    made = made.withColumn("words", words).where(~F.arrays_overlap(low(F.col("words")), low(F.split("phrase", " "))))
    if "aliases" in rows.columns:
        made = made.withColumn("words", F.filter("words", lambda w: ~F.array_contains("aliases", F.lower(w))))
    plain = ~F.exists("words", lambda w: F.lower(w).isin(*known))
    return made.where((F.size("words") >= 2) & plain).select("row_index", F.array_join("words", " ").alias("name"))


def series(rows: DataFrame) -> DataFrame:
    """name, n of the series_runs() that occur twice or more."""
    return series_runs(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def unknown_units(rows: DataFrame) -> DataFrame:
    """suffix, n: letters after numbers that are neither unit nor shorthand."""
    body = text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num"))
    found = rows.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?<![A-Za-z])\b\d+(?:[./-]\d+)?\s*([A-Za-z]{1,5})\b"), F.lit(1))).alias("suffix"))
    return found.where(~F.lower("suffix").isin(*units.aliases(), *fixed.EXPANSIONS)).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


def finishes(rows: DataFrame) -> DataFrame:
    """value, n: colours and materials that shorthand names."""
    body = text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num"))
    full = rows.select(F.explode(F.transform(text.tokens(body), text.expand_token)).alias("value"))
    return full.where(F.col("value").isin(*fixed.FINISHES)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def group_prior(classified: DataFrame, least: float = fixed.LEARN) -> DataFrame:
    """grp, classpath, weight, total, share from (grp, classpath, confidence); confidences below `least` do not count.

    Sums are exact decimals, so no order of rows moves a threshold."""
    kept = classified.where((F.col("confidence") >= least) & (F.col("grp") != "") & F.col("classpath").isNotNull())
    weights = kept.groupBy("grp", "classpath").agg(F.sum(F.col("confidence").cast("decimal(18,6)")).alias("w"), F.count(F.lit(1)).alias("n"))
    total = F.sum("w").over(Window.partitionBy("grp"))
    return weights.select("grp", "classpath", F.col("w").cast("double").alias("weight"), total.cast("double").alias("total"), micro(F.col("w").cast("double") / total.cast("double")).alias("share"))


def prior_top(prior: DataFrame) -> DataFrame:
    """grp, classpath, share, total: the heaviest class of a group, ties by name."""
    best = F.min_by(F.struct("classpath", "share", "total"), F.struct(-F.col("weight"), F.col("classpath"))).alias("b")
    return prior.groupBy("grp").agg(best).select("grp", "b.classpath", "b.share", "b.total")


def prior_report(prior: DataFrame, most: int = 6) -> DataFrame:
    """The `most` heaviest classes of each group with shares to four places."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("weight").desc(), "classpath"))
    return prior.withColumn("rank", rank).where(F.col("rank") <= most).select("grp", "rank", "classpath", micro(F.col("share"), 4).alias("share"))
