"""Queries over the tables of a folder, one for each catalogue operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, units
from ..operators import cells as C
from ..operators import entity, extract, learn, models, propose, render, score, taxonomy, training
from ..sources import catalogue, sheets, sinks, vocabulary
from ..sources.rules import Category, Rules, Slot, demo
from ..sources.scratch import folder, stored
from . import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = demo()


def table_rules(spark: SparkSession, sf_dir: str) -> Rules:
    """A rule set whose permitted values, cues and contracts come from `part`, whose types and brands are few."""
    part = read(spark, sf_dir, "part")
    types, brands = (sorted(r[0] for r in part.select(c).distinct().collect()) for c in ("p_type", "p_brand"))
    slots = (Slot("Type", "lov", lov=tuple(types)), Slot("Maker", "lov", lov=tuple(brands), lov_aliases=tuple((b.replace(" ", "-nr "), b) for b in brands)), Slot("Note", "text", cues=tuple(f"{t} make" for t in types)))
    more = (Slot("Type", "lov", lov=tuple(f"{t} Plus" for t in types)),)
    categories = tuple(Category(f"Parts > {t}", f"contract {t}", must=(t.lower(),)) for t in types[::2])
    return Rules(categories, {"generic": slots, **{f"contract {t}": more for t in types[::2]}})


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(pairs, *names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs) + f") t({', '.join(names)})"


#: Column texts of the rules, in SQL.
def sql_clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(regexp_replace(translate(coalesce({x}, ''), '“”″′‘’´—–', '\"\"\"''''''''--'), '\\s+', ' ', 'g')), '[\\s\\-,;:]+$', ''), '^[\\s\\-,;:]+', '')"


def sql_placeholder(x: str) -> str:
    t, names = f"trim(coalesce({x}, ''))", ", ".join(map(quoted, fixed.PLACEHOLDERS))
    bare = f"trim(trim({t}, '-'))"
    return f"({t} = '' or regexp_matches({t}, '^\\s*--+\\s*[^-].*?\\s*--+\\s*$') or lower({t}) in ({names}) or lower({bare}) in ({names}) or regexp_matches({bare}, '(?i)^\\s*no\\s+[\\w\\s]{{0,24}}\\bbrands?\\s*$') or not regexp_matches({t}, '[\\p{{L}}\\p{{N}}]'))"


NOISE = "(?i)[\\s\\-,(]*\\b(?:" + "|".join(fixed.NOISE) + ")\\b[\\s)]*"


def sql_strip_noise(x: str) -> str:
    return f"(case when regexp_matches({x}, {quoted(NOISE)}) then {sql_clean(f'regexp_replace({x}, {quoted(NOISE)}, chr(32), {quoted(chr(103))})')} else {x} end)"


def sql_strip_mpn(x: str, mpn: str) -> str:
    rest = f"ltrim(substr(trim({x}), length({mpn}) + 1), ' -,:')"
    return f"(case when coalesce({mpn}, '') <> '' and starts_with(upper(trim({x})), upper({mpn})) and {rest} <> '' then {rest} else {x} end)"


CATALOG = f"with c as ({catalogue.BRIDGE})"
BODY = f"b as (select *, {sql_strip_noise(sql_strip_mpn(sql_clean('Part_Desc'), 'Mfg_Part_Num'))} as body, case when {sql_placeholder(sql_clean('Part_Manuf'))} then '<ungrouped>' else {sql_clean('Part_Manuf')} end as grp from c)"
MICRO = "floor(({x}) * {s}::double + 0.5::double) / {s}::double"


def micro(x: str, places: int = 6) -> str:
    return MICRO.format(x=x, s=10**places)


def query(sql: str | None = None):
    """Registers a function of (rows of the catalogue view) or, named with spark, of (spark, sf_dir)."""

    def register(f):
        wants = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = f if wants[0] == "spark" else lambda spark, sf_dir, f=f: f(catalogue.bridge(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def bodies(rows: DataFrame) -> DataFrame:
    return rows.withColumn("body", text.body_of(F.col("Part_Desc"), F.col("Mfg_Part_Num"))).withColumn("grp", text.group_key(F.col("Part_Manuf")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Predicates and projections


@query(f"{CATALOG} select row_index, {sql_placeholder('E1_Brand')} as e1, {sql_placeholder('Unilog_Brand')} as other, {sql_placeholder('DIB_Brand')} as dib, {sql_placeholder('Part_Manuf')} as account from c")
def p1_placeholder(rows):
    return rows.select("row_index", *(text.is_placeholder(F.col(c)).alias(n) for c, n in (("E1_Brand", "e1"), ("Unilog_Brand", "other"), ("DIB_Brand", "dib"), ("Part_Manuf", "account"))))


@query(f"{CATALOG} " + " union all ".join(f"select row_index, {quoted(h)} as header, trim(coalesce({h}, '')) as value, 'input_copy' as source from c" for h in fixed.PASSTHROUGH))
def p2_passthrough_cells(rows):
    return C.passthrough(rows).select("row_index", "header", "value", "source")


@query(f"{CATALOG}, n as (select * from {values([(h,) for h in fixed.NOT_DERIVABLE], 'header')}) select row_index, header, 'not_derivable' as source from c cross join n where not (header = 'UPC' and row_index % 3 = 0)")
def p3_not_derivable(rows):
    upc = C.exploded(rows.where("row_index % 3 = 0"), C.cell("UPC", F.lit("0"), "input_copy", "x", 1.0))
    return C.not_derivable(rows, upc).select("row_index", "header", "source")


_SMALL = ["Mfg_Part_Num", "Part_Desc", "E1_Brand"]


@query(f"{CATALOG} select row_index, " + ", ".join(f"trim({h}) as {h}" for h in _SMALL) + " from c")
def p7_wide_record(rows):
    return C.wide(C.passthrough(rows), _SMALL)


_SLOTS = ((1, "substr(p_type, 1, cast(p_partkey % 3 as integer))", "p_name", "''"), (2, "case when p_size > 25 then p_brand else ' ' end", "case when p_partkey % 4 = 0 then '' else p_type end", "case when p_size % 2 = 0 then 'in' else ' ' end"))


@query("select row_index, problem from (" + " union all ".join(f"select p_partkey as row_index, 'slot {n}: value/UOM present with no label' as problem, trim({a}) = '' and (trim({v}) <> '' or trim({u}) <> '') as bad from part" for n, a, v, u in _SLOTS) + ") where bad")
def p4_record_problems(spark, sf_dir):
    wide = read(spark, sf_dir, "part").selectExpr("p_partkey as row_index", *(f"{x} as `ATTRIBUTE_{kind} {n}`" for n, *slot in _SLOTS for kind, x in zip(("LABEL", "VALUE", "UOM"), slot)))
    schema = C.Schema([c for c in wide.columns if c != "row_index"])
    return wide.select("row_index", F.explode(schema.problems(wide)).alias("problem"))


@query("select l_orderkey, l_linenumber, (l_quantity >= 10 or 10 is null) and l_quantity <= 40 as ok from lineitem")
def p13_in_bounds(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", extract.in_bounds(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("ok"))


@query(f"{CATALOG} select row_index, Part_Desc from c order by row_index limit 100")
def p17_first_rows(rows):
    return rows.orderBy("row_index").limit(100).select("row_index", "Part_Desc")


# Text


@query(f"{CATALOG} select row_index, {sql_clean('Part_Desc')} as cleaned from c")
def t1_clean(rows):
    return rows.select("row_index", text.clean(F.col("Part_Desc")).alias("cleaned"))


@query(f"{CATALOG} select row_index, {sql_strip_noise('Part_Desc')} as stripped from c")
def t2_strip_noise(rows):
    return rows.select("row_index", text.strip_noise(F.col("Part_Desc")).alias("stripped"))


@query(f"{CATALOG} select row_index, {sql_strip_mpn('Part_Desc', 'Mfg_Part_Num')} as stripped from c")
def t3_strip_leading_mpn(rows):
    return rows.select("row_index", text.strip_leading_mpn(F.col("Part_Desc"), F.col("Mfg_Part_Num")).alias("stripped"))


_TOKEN = quoted(text.TOKEN)


@query(f"{CATALOG} select row_index, array_to_string(regexp_extract_all(Part_Desc, {_TOKEN}), '|') as tokens from c")
def t4_tokens(rows):
    return rows.select("row_index", F.array_join(text.tokens(F.col("Part_Desc")), "|").alias("tokens"))


_LEXICON = values(fixed.EXPANSIONS.items(), "k", "v")


@query(f"select v as expansion, count(*) as n from (select lower(unnest(regexp_extract_all(text, {_TOKEN}))) as w from documents) join {_LEXICON} on w = k group by v")
def t5_expand_token(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    lexicon = spark.createDataFrame(list(fixed.EXPANSIONS.items()), "k string, v string")
    counts = words.groupBy(F.lower("w").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return counts.join(F.broadcast(lexicon), "k").groupBy(F.col("v").alias("expansion")).agg(F.sum("c").alias("n"))  # a fixed table of 164 rows


@query(f"{CATALOG} select row_index, replace({sql_clean('Part_Desc')}, 'PN', 'Polished Nickel') || ' Stainless Steel Black Light Fixture' as expanded from c")
def t6_expand(rows):
    return rows.select("row_index", text.expand(F.concat_ws(" ", "Part_Desc", F.lit("SS blk lt fixt"))).alias("expanded"))


def _contracted(x: str) -> str:
    for p in sorted(fixed.INVOICE, key=len, reverse=True):
        x = f"regexp_replace({x}, {quoted(chr(40) + '?i)' + chr(92) + 'b' + p + chr(92) + 'b')}, {quoted(fixed.INVOICE[p])}, 'g')"
    return x


@query(f"{CATALOG} select row_index, upper(trim(regexp_replace({_contracted(quoted('Black Stainless Steel with ') + ' || Part_Desc')}, '\\s{{2,}}', ' ', 'g'))) as line from c")
def t7_invoice_contraction(rows):
    return rows.select("row_index", text.contract_for_invoice(F.concat(F.lit("Black Stainless Steel with "), "Part_Desc")).alias("line"))


def _sql_title(x: str) -> str:
    ups, lows = (", ".join(map(quoted, w)) for w in (fixed.UPPER_WORDS, fixed.LOWER_WORDS))
    lift = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"
    bare = "trim(w, '.,;:()')"
    return (
        f"array_to_string(list_transform(list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> ''), lambda w, i: case when upper({bare}) in ({ups}) then replace(w, {bare}, upper({bare})) "
        f"when i > 1 and lower({bare}) in ({lows}) then lower(w) when {bare} = upper({bare}) and regexp_matches({bare}, '[A-Za-z]') and length({bare}) > 1 and regexp_matches({bare}, '[0-9]') then w "
        f"when contains({bare}, '-') then array_to_string(list_transform(string_split(w, '-'), lambda p: {lift('p')}), '-') else {lift('w')} end), ' ')"
    )


@query(f"{CATALOG} select row_index, {_sql_title('Part_Desc || chr(32) || $$led panel for the semi-flush mount$$')} as title from c")
def t8_title_case(rows):
    return rows.select("row_index", text.title_case(F.concat("Part_Desc", F.lit(" led panel for the semi-flush mount"))).alias("title"))


@query(f"{CATALOG} select row_index, regexp_extract(Part_Manuf, '^(.*?)\\s*\\(([A-Z0-9]{{3,8}})\\)\\s*$', 1) as name, regexp_extract(Part_Manuf, '^(.*?)\\s*\\(([A-Z0-9]{{3,8}})\\)\\s*$', 2) as code from c")
def t9_parse_account(rows):
    return rows.select("row_index", text.account_name(F.col("Part_Manuf")).alias("name"), text.account_code(F.col("Part_Manuf")).alias("code"))


_SUFFIX = "|".join(fixed.ACCOUNT_SUFFIXES)


@query(f"select s_suppkey, trim(regexp_replace(s_name || ' Tools, Inc.', '(?i)(?:\\s+[.,]*(?:{_SUFFIX})[.,]*)+$', ''), ' .,&-') as head from supplier")
def t10_account_head(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.account_head(F.concat("s_name", F.lit(" Tools, Inc."))).alias("head"))


_NEVER = ", ".join(quoted(w) for w in [*fixed.NEVER_BRAND, *fixed.EXPANSIONS, *units.aliases()])
CANDIDATES = f"list_filter(regexp_extract_all({sql_strip_noise(sql_strip_mpn('Part_Desc', 'Mfg_Part_Num'))}, {_TOKEN}), lambda t: length(t) >= 3 and regexp_matches(t, '^[A-Za-z][A-Za-z''\\-]*$') and lower(t) not in ({_NEVER}) and not contains(lower(Mfg_Part_Num), lower(t)))"
TOKENS = f"k as (select row_index, grp, {CANDIDATES} as c from b), tok as (select row_index, grp, greatest(len(c), 1) as n, unnest(c) as token, unnest(range(len(c))) as pos from k)"


@query(f"{CATALOG}, {BODY}, {TOKENS} select row_index, token, pos from tok")
def t11_candidate_tokens(rows):
    return learn.token_positions(rows).select("row_index", "token", F.col("pos").cast("long").alias("pos"))


@query("select c_custkey, regexp_matches(lower(c_name), 'c.*t.*m.*r') as sub from customer")
def t13_subsequence(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.is_subsequence("ctmr", F.lower("c_name")).alias("sub"))


@query(f"{CATALOG}, {BODY} select row_index, trim(regexp_replace(body, ' \\d+\"x\\d/8\"| 6pc$', '', 'g')) as phrase from b")
def t15_head_phrase(rows):
    made = bodies(rows).withColumn("m", units.find_measurements("body"))
    return made.select("row_index", learn.head_phrase(F.col("body"), F.col("m")).alias("phrase"))


@query()
def t16_title_runs(spark, sf_dir):
    return learn.title_runs(read(spark, sf_dir, "documents")).select("doc_id", "run")


@query(f"{CATALOG} select row_index, regexp_matches(Part_Desc, '(?i)(?:^|[^A-Za-z0-9])red[\\s\\-]*bolt(?:e?s)?(?:[^A-Za-z0-9]|$)') as hit from c")
def t20_phrase_match(rows):
    return rows.select("row_index", F.col("Part_Desc").rlike(text.phrase_pattern("red bolt")).alias("hit"))


@query(f"{CATALOG}, {BODY} select row_index, {sql_clean('Part_Desc')} || ' | ' || body as prepared from b")
def t21_prepare_text(rows):
    return enrich.prepared(rows).select("row_index", "prepared")


_MARKED = "case p_partkey % 5 " + " ".join(f"when {i} then {quoted(w)}" for i, w in enumerate(("Bosch", "DeWalt®", "LP SmartSide", "Acme"))) + " else p_brand end || case when p_size % 3 = 0 then '®' when p_size % 3 = 1 then ' ' else '' end"
_BARE = "trim(regexp_replace(b, '[®™©]', '', 'g'))"


@query(f"with x as (select p_partkey, {_MARKED} as b, p_size % 2 = 0 as attested from part) select p_partkey, case when {_BARE} = '' then '' when regexp_matches(b, '[®™©]') then trim(b) when attested and lower({_BARE}) in ({', '.join(map(quoted, fixed.REGISTERED))}) then {_BARE} || '®' else {_BARE} end as brand from x")
def t22_decorate(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.decorate(F.expr(_MARKED), F.col("p_size") % 2 == 0).alias("brand"))


@query(f"{CATALOG}, {BODY} select row_index, array_to_string(list_transform(list_slice(regexp_extract_all(body, '[A-Za-z]{{2,}}'), -3, -1), lambda w: case when w = upper(w) then w else upper(w[1:1]) || w[2:] end), ' ') as name from b")
def t24_fallback_name(rows):
    return bodies(rows).select("row_index", text.fallback_name(F.col("body")).alias("name"))


@query(f"{CATALOG} select row_index, regexp_replace(trim(regexp_replace(DIB_Brand, '[®™©]', '', 'g')), '[^\\w]+', '', 'g') || '_' || Mfg_Part_Num || '_2.jpg' as alternate from c")
def t25_asset_names(rows):
    return rows.select("row_index", F.element_at(text.asset_names(F.col("DIB_Brand"), F.col("Mfg_Part_Num")), "Alternate Image 2").alias("alternate"))


def _approval_sql(x: str) -> str:
    cases = ", ".join(f"case when regexp_matches({x}, " + quoted("(?i)(?:^|[^A-Za-z0-9])(?:" + "|".join(re.escape(c) for c in cues.split("|")) + ")(?:[^A-Za-z0-9]|$)") + f") then {quoted(mark)} end" for mark, cues in fixed.APPROVALS.items())
    return f"list_filter([{cases}], lambda m: m is not null)"


#: A text of cues and words that the table's numbers pick.
_CUES = [c for cues in fixed.APPROVALS.values() for c in cues.split("|")]
_SAID_CUES = "p_name || " + " || ".join(f"case when (p_partkey + p_size) % {k + 3} = 0 then ' {c if k % 3 else c.upper()}{',' if k % 2 else ''}' when p_partkey % {k + 5} = 1 then ' x{c} ' else '' end" for k, c in enumerate(_CUES))


@query(f"with x as (select p_partkey, {_approval_sql(_SAID_CUES)} as marks from part) select p_partkey, array_to_string(list_sort(marks), '|') as binary_order, array_to_string(list_transform(list_sort(list_transform(marks, lambda m: {{'k': lower(m), 'v': m}})), lambda z: z.v), '|') as gold_order from x")
def t26_approvals(spark, sf_dir):
    said = F.expr(_SAID_CUES)
    return read(spark, sf_dir, "part").select("p_partkey", text.approvals(said).alias("binary_order"), text.approvals(said, "gold").alias("gold_order"))


@query(f"{CATALOG} select row_index, lower(trim(regexp_replace(Part_Desc, '\\s+', ' ', 'g'))) as norm from c")
def t27_normalised(rows):
    return rows.select("row_index", text.normalised(F.col("Part_Desc")).alias("norm"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def t28_first_json(spark, sf_dir):
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(text.first_json(reply), "$.k").cast("long").alias("k"))


@query("select r_regionkey, 'O|B-' || r_name || '|I-' || r_name as tags from region")
def t30_bio_tags(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", F.array_join(text.bio_tags(F.array("r_name")), "|").alias("tags"))


@query(f"{CATALOG}, a as (select row_index, length(Part_Desc) as n from c) select row_index, case when n = 0 then 'empty' when n <= 40 then 'short' when n between 60 and 80 then 'window' else 'other' end as status from a")
def t32_length_status(rows):
    return rows.select("row_index", text.length_status(F.col("Part_Desc")).alias("status"))


# Units and numbers


@query(f"select alias, canonical, family, count(*) as n from (select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as alias from documents) join {values([(k, u.canonical, u.family) for k, u in units.aliases().items()], 'alias', 'canonical', 'family')} using (alias) group by 1, 2, 3")
def n1_alias_table(spark, sf_dir):
    """How often each spelling of a unit is a word of the documents."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    return words.join(units.unit_table(spark), "alias").select("alias", "canonical", "family", "n")


_ALIASES = values([(k, u.canonical) for k, u in units.aliases().items()], "k", "v")


@query(f"select l_orderkey, l_linenumber, coalesce(v, w) as unit from (select *, case l_linenumber % 4 when 0 then 'Inches' when 1 then 'LBS.' when 2 then 'volts' else 'foo' end as w from lineitem) left join {_ALIASES} on lower(w) = k")
def n2_unit_lookup(spark, sf_dir):
    w = F.when(F.col("l_linenumber") % 4 == 0, "Inches").when(F.col("l_linenumber") % 4 == 1, "LBS.").when(F.col("l_linenumber") % 4 == 2, "volts").otherwise("foo")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.canonical(w).alias("unit"))


_64 = "(select range as n, cast(n * 1000000 // 64 as bigint) as m from range(1, 64))"


@query("with s as (select range as n, case when range % 32 = 0 then 32 when range % 16 = 0 then 16 when range % 8 = 0 then 8 when range % 4 = 0 then 4 when range % 2 = 0 then 2 else 1 end as g from range(1, 64)), r as (select p_partkey, p_partkey % 63 + 1 as k from part) select p_partkey, '7-' || cast(n // g as varchar) || '/' || cast(64 // g as varchar) as fraction from r join s on n = k")
def n4_to_fraction(spark, sf_dir):
    digits = F.lpad(((F.col("p_partkey") % 63 + 1) * 15625).cast("string"), 6, "0")
    return read(spark, sf_dir, "part").select("p_partkey", units.to_fraction(F.concat(F.lit("7."), digits)).alias("fraction"))


@query("select p_partkey, cast(p_size as double) + 3.0::double / 8.0::double as x from part")
def n5_to_decimal(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", units.to_decimal(F.concat(F.col("p_size").cast("string"), F.lit("-3/8"))).alias("x"))


@query("select p_partkey, cast(p_size as varchar) || case when p_partkey % 2 = 0 then '-1/2' else '.5' end as m from part")
def n6_normalise_magnitude(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", units.normalise_magnitude(F.concat(F.col("p_size").cast("string"), F.lit(".50")), F.col("p_partkey") % 2 == 0).alias("m"))


@query("select l_orderkey, l_linenumber, cast(cast(l_quantity as integer) as double) / 64.0::double as x from lineitem")
def n7_fraction_table(spark, sf_dir):
    """Quantities as sixty-fourths."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.to_decimal(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/64"))).alias("x"))


@query("select p_partkey, cast(p_size as varchar) || ' in' as spaced, cast(p_size as varchar) || 'IN' as glued from part")
def n8_render_unit(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return read(spark, sf_dir, "part").select("p_partkey", units.render(size, F.lit("in")).alias("spaced"), units.render(size, F.lit("in"), True).alias("glued"))


@query(
    f"{CATALOG}, s as (select row_index, Part_Desc, regexp_extract(Part_Desc, '(\\d+)\"x', 1) as one, regexp_extract(Part_Desc, 'x(\\d/8)', 1) as two from c), p as (select *, strpos(Part_Desc, one || '\"x') - 1 as a from s), "
    "f as (select row_index, 0 as i, one as magnitude, 'in' as unit, 'length' as family, a, a + length(one) + 1 as b from p union all select row_index, 1, two, 'in', 'length', a + length(one) + 2, a + length(one) + 6 from p "
    "union all select row_index, 2, '6', 'pc', 'count', length(Part_Desc) - 3, length(Part_Desc) from p where Part_Desc like '% 6pc') "
    'select row_index, i, magnitude, unit, family, cast(a as integer) as start, cast(b as integer) as "end" from f'
)
def n9_find_measurements(rows):
    m = rows.select("row_index", F.posexplode(units.find_measurements("Part_Desc")).alias("i", "m"))
    return m.select("row_index", "i", "m.magnitude", "m.unit", "m.family", "m.start", "m.end")


@query("select p_partkey, cast(p_size as varchar) || ' in W x 2 in D' as dims from part")
def n10_render_dimensions(spark, sf_dir):
    parts = F.array(F.concat(F.col("p_size").cast("string"), F.lit(" in")), F.lit("2 in"))
    return read(spark, sf_dir, "part").select("p_partkey", units.render_dimensions(parts, F.array(F.lit("W"), F.lit("D"))).alias("dims"))


@query(f"{CATALOG} select row_index, regexp_replace(regexp_replace(Part_Desc, '(\\d+)\"x(\\d/8)\"', '\\1 in x \\2 in'), ' 6pc$', ' 6 pc') as spaced from c")
def n11_enforce_spacing(rows):
    return rows.select("row_index", units.enforce_spacing("Part_Desc", "Mfg_Part_Num").alias("spaced"))


@query("select p_partkey, regexp_matches(case when p_partkey % 2 = 0 then cast(p_size as varchar) || 'in' else cast(p_size as varchar) || ' in' end, '(?i)\\d(?:in|ft|mm|cm|lb|oz|gal|qt|hr|min|sec)\\b') as bad from part")
def n12_glued_unit(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return read(spark, sf_dir, "part").select("p_partkey", units.glued_unit(F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit("in"))).otherwise(F.concat(size, F.lit(" in")))).alias("bad"))


@query(f"select l_orderkey, l_linenumber, {micro('l_extendedprice / l_quantity', 2)} as unit_price from lineitem")
def n13_rounding(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", learn.micro(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"))


@query(f"select p_partkey, {micro('greatest(0.0::double, least(1.0::double, ln(p_size) / ln(50::double)))')} as x from part")
def n14_clamp(spark, sf_dir):
    x = F.log(F.col("p_size").cast("double")) / F.log(F.lit(50.0))
    return read(spark, sf_dir, "part").select("p_partkey", learn.micro(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).alias("x"))


# Learning


@query(f"{CATALOG}, {BODY} select grp, regexp_extract(grp, '^(.*?)\\s*\\(([A-Z0-9]{{3,8}})\\)\\s*$', 1) as name, regexp_extract(grp, '^(.*?)\\s*\\(([A-Z0-9]{{3,8}})\\)\\s*$', 2) as code, count(*) as n_rows from b group by grp")
def a1_groups(rows):
    return learn.groups(rows)


SALIENCE = f"hit as (select grp, token, lower(token) as low, count(distinct row_index) as hits from tok group by 1, 2, 3), spread as (select low, count(distinct grp) as g from hit group by 1), size as (select grp, count(*) as s from b group by 1), sal as (select grp, token, hits, {micro('hits::double / s')} as coverage, g as n_token_groups, {micro('hits::double / s * ln((select count(*) from size)::double / g)')} as salience from hit join spread using (low) join size using (grp))"


@query(f"{CATALOG}, {BODY}, {TOKENS}, {SALIENCE} select * from sal")
def a2_salience(rows):
    return learn.salience(rows)


@query(f"{CATALOG}, {BODY}, {TOKENS}, f as (select row_index, lower(token) as low, min(pos::double / n) as p from tok group by 1, 2) select low, {micro('avg(p)')} as mean_position, count(*) as n from f group by 1")
def a3_mean_position(rows):
    return learn.mean_positions(rows)


STACK = "st as (" + " union all ".join(f"select row_index, grp, {i} as column_rank, {sql_clean(c)} as value from b where not {sql_placeholder(c)}" for i, c in enumerate(learn.COLUMNS)) + ")"


@query(f"{CATALOG}, {BODY}, {STACK} select value, count(*) as support from st group by 1")
def a4_attested_brands(rows):
    return learn.attested_brands(rows)


_LINKED = "l as (select p_brand as canonical, p_name as token, cast(p_size as bigint) as hits, p_type as grp, p_partkey as seen, 0.5::double + (p_partkey % 40) / 100.0::double as confidence, (p_size % 10) / 10.0::double as position from part)"


@query(f"with {_LINKED}, f as (select *, row_number() over (partition by canonical, lower(token) order by seen) as nth from l), g as (select canonical, string_agg(token, '|' order by seen) filter (nth = 1) as aliases, array_to_string(list_sort(list(distinct grp)), '|') as groups, cast(sum(hits) as bigint) as n, max(confidence) as confidence, {micro('list_reduce(list(position order by seen), lambda a, x: case when a = 0 then x else (a + x) / 2 end)')} as mean_position from f group by 1), t as (select p_brand as canonical, count(*) as k from part group by 1) select canonical, aliases, groups, n + k as support, confidence, mean_position from g join t using (canonical)")
def a5_brand_fold(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    links = part.select(F.col("p_brand").alias("canonical"), F.col("p_name").alias("token"), F.col("p_size").cast("long").alias("hits"), F.col("p_type").alias("grp"), F.col("p_partkey").alias("seen"), (0.5 + (F.col("p_partkey") % 40) / 100.0).cast("double").alias("confidence"), ((F.col("p_size") % 10) / 10.0).cast("double").alias("position"), F.lit("").alias("linkage"))
    told = part.groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("support"), F.min("p_partkey").alias("seen"))
    out = learn.brand_entries(links, told)
    return out.select("canonical", F.array_join("aliases", "|").alias("aliases"), F.array_join("groups", "|").alias("groups"), "support", "confidence", "mean_position")


@query("with e as (select p_brand as canonical, substr(p_name, 1, 4) as a, p_partkey as ord from part), x as (select canonical, lower(a) as alias, ord from e union all select canonical, lower(canonical), ord from e) select alias, first(canonical order by length(canonical) desc, ord) as canonical from x group by alias")
def a6_alias_index(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return learn.alias_index(part.select(F.col("p_brand").alias("canonical"), F.substring("p_name", 1, 4).alias("alias"), F.col("p_partkey").alias("ord")))


@query(
    f"{CATALOG}, {BODY}, h as (select grp, trim(regexp_replace(body, ' \\d+\"x\\d/8\"| 6pc$', '', 'g')) as phrase from b) "
    "select array_to_string(list_transform(string_split(phrase, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as canonical, count(*) as support, string_agg(distinct grp, '|' order by grp) as \"groups\", '' as variants from h group by phrase having count(*) > 1"
)
def a7_product_types(rows):
    t = learn.product_types(rows)
    return t.select("canonical", "support", F.array_join("groups", "|").alias("groups"), F.array_join("variants", "|").alias("variants"))


_KNOWN_WORDS = ", ".join(quoted(w) for w in [*units.aliases(), *fixed.EXPANSIONS])


@query(
    "with w as (select string_split(p_name, ' ') as w, p_size from part), s as (select array_to_string(list_transform(w, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') || case p_size % 3 when 0 then ' II' when 1 then ' 40' else '' end as name from w) "
    f"select name, count(*) as n from s where len(list_filter(string_split(lower(name), ' '), lambda w: w in ({_KNOWN_WORDS}))) = 0 group by name having count(*) >= 2"
)
def a8_series_counts(spark, sf_dir):
    """Descriptions that begin with a title-cased run and end with the product's words."""
    tail = F.when(F.col("p_size") % 3 == 0, " II").when(F.col("p_size") % 3 == 1, " 40").otherwise("")
    said = F.concat(F.initcap("p_name"), tail, F.lit(" in "), F.lower("p_type"), F.lit(" - general purpose shop stock"))
    return learn.series(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.lit("").alias("Mfg_Part_Num"), said.alias("Part_Desc")))


@query(
    f"{CATALOG}, {BODY}, h as (select row_index, body, trim(regexp_replace(body, ' \\d+\"x\\d/8\"| 6pc$', '', 'g')) as phrase from b), t as (select phrase from h group by 1 having count(*) > 1), "
    "m as (select phrase, 'length' as family, 2 as n from h union all select phrase, 'count', 1 from h where body like '% 6pc') "
    "select array_to_string(list_transform(string_split(phrase, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as canonical, family, cast(sum(n) as bigint) as n from m join t using (phrase) group by 1, 2"
)
def a9_families(rows):
    return learn.families(rows)


@query("select suffix, count(*) as n from (select unnest(regexp_extract_all(' ' || cast(p_size as varchar) || p_type || ' ', '\\d+(?:[./-]\\d+)?\\s*([A-Za-z]{1,5})\\b', 1)) as suffix from part) where lower(suffix) not in (" + _KNOWN_WORDS + ") group by suffix")
def a10_unknown_units(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.lit("").alias("Mfg_Part_Num"), F.concat(F.col("p_size").cast("string"), "p_type").alias("Part_Desc"))
    return learn.unknown_units(part)


_FIN = ", ".join(map(quoted, fixed.FINISHES))


@query(f"with w as (select unnest(['ss', 'blk', case when p_size % 2 = 0 then 'wht' else 'cu' end, p_name]) as w from part) select v as value, count(*) as n from w join {_LEXICON} on lower(w) = k where v in ({_FIN}) group by v")
def a11_finishes(spark, sf_dir):
    made = F.concat_ws(" ", F.lit("ss blk"), F.when(F.col("p_size") % 2 == 0, "wht").otherwise("cu"), "p_name")
    return learn.finishes(read(spark, sf_dir, "part").select(F.lit("").alias("Mfg_Part_Num"), made.alias("Part_Desc")))


@query(f"with o as (select c_mktsegment as grp, o_orderpriority as classpath, cast(0.5::double + (o_orderkey % 50) / 100.0::double as decimal(18,6)) as w from orders join customer on c_custkey = o_custkey), k as (select * from o where w >= 0.7), g as (select grp, classpath, sum(w) as w from k group by 1, 2) select grp, classpath, cast(w as double) as weight, cast(sum(w) over (partition by grp) as double) as total, {micro('cast(w as double) / cast(sum(w) over (partition by grp) as double)')} as share from g")
def a12_group_prior(spark, sf_dir):
    return learn.group_prior(_votes(spark, sf_dir))


def _even_types(rows: DataFrame) -> DataFrame:
    """`canonical`: type and brand of every second part of the catalogue view, whose descriptions end in the type."""
    part = rows.where("row_index % 2 = 0")
    return part.select(F.explode(F.array(F.regexp_extract("Part_Desc", r'/8" (.*?)(?: 6pc| - Display Only)?$', 1), "DIB_Brand", "E1_Brand")).alias("canonical")).where("canonical not like '--%'")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("c_mktsegment").alias("grp"), F.col("o_orderpriority").alias("classpath"), (0.5 + (F.col("o_orderkey") % 50) / 100.0).cast("decimal(18,6)").alias("confidence"))


PRIOR_SQL = ORACLE_SQL["a12_group_prior"]


@query(f"with p as ({PRIOR_SQL}) select grp, first(classpath order by weight desc, classpath) as classpath, first(share order by weight desc, classpath) as share, first(total order by weight desc, classpath) as total from p group by grp")
def a13_prior_top(spark, sf_dir):
    return learn.prior_top(learn.group_prior(_votes(spark, sf_dir)))


@query(f"with p as ({PRIOR_SQL}), r as (select *, cast(row_number() over (partition by grp order by weight desc, classpath) as integer) as rank from p) select grp, rank, classpath, {micro('share', 4)} as share from r where rank <= 3")
def a14_prior_report(spark, sf_dir):
    return learn.prior_report(learn.group_prior(_votes(spark, sf_dir)), 3)


@query(f"{CATALOG}, d as (select *, case when row_index % 4 = 0 then 'Brand ' || regexp_extract(Part_Manuf, '#0*(\\d+)', 1) else DIB_Brand end as dib from c), v as (select Part_Manuf as grp, dib as brand, row_index from d where row_index % 4 = 0 union all select Part_Manuf, E1_Brand, row_index from c where row_index % 5 = 0), g as (select grp, brand, count(*) as hits, min(row_index) as seen from v group by 1, 2), m as (select *, sum(hits) over (partition by grp) as total, row_number() over (partition by grp order by hits desc, seen) as rn from g) select grp, brand, hits, {micro('hits::double / total')} as purity from m where rn = 1 and floor(hits::double / total * 1000000 + 0.5) / 1000000 >= 0.6 and hits >= 3")
def a15_brand_prior(rows):
    own = F.concat(F.lit("Brand "), F.regexp_extract("Part_Manuf", r"#0*(\d+)", 1))
    return learn.brand_prior(rows.withColumn("DIB_Brand", F.when(F.col("row_index") % 4 == 0, own).otherwise(F.col("DIB_Brand"))))


@query("with g as (select o_custkey as grp, o_orderpriority as value, count(*) as hits, min(o_orderkey) as seen from orders group by 1, 2), m as (select *, cast(sum(hits) over (partition by grp) as bigint) as total, row_number() over (partition by grp order by hits desc, seen) as rn from g) select grp, value, hits, total from m where rn = 1")
def a16_first_mode(spark, sf_dir):
    return learn.first_mode(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seen")), "grp", "value", "seen")


# Joins


@query("select p_partkey, p_brand as canonical from part where p_partkey % 3 = 0 union all select p_partkey, p_name from part where p_partkey % 3 <> 0")
def j1_resolve_alias(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    aliases = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("alias "), F.col("p_partkey").cast("string")).alias("alias"), F.col("p_brand").alias("canonical"))
    tokens = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ALIAS "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("value"))
    return learn.resolved(tokens, aliases).select("p_partkey", "canonical")


@query(f"with p as ({PRIOR_SQL}), o as (select o_orderkey, c_mktsegment as grp, o_orderpriority as classpath from orders join customer on c_custkey = o_custkey) select o_orderkey, coalesce(share, 0.0::double) as prior from o left join p using (grp, classpath)")
def j2_group_prior(spark, sf_dir):
    prior = learn.group_prior(_votes(spark, sf_dir))
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("grp"), F.col("o_orderpriority").alias("classpath"))
    return rows.join(prior.select("grp", "classpath", "share"), ["grp", "classpath"], "left").select("o_orderkey", F.coalesce("share", F.lit(0.0)).alias("prior"))


def _re2(p: str) -> str:
    import re as _re

    return "(?i)(?:^|[^A-Za-z0-9])" + "[\\s\\-]*".join(_re.escape(x) for x in _re.split(r"[\s\-]+", p)) + "(?:e?s)?(?:[^A-Za-z0-9]|$)"


_PHRASES = values([(c.classpath, kind, p, _re2(p)) for c in RULES.categories for kind in ("must", "boost", "veto") for p in getattr(c, kind)], "classpath", "kind", "phrase", "pattern")
HITS = f"h as (select row_index, grp, classpath, kind, phrase from b cross join {_PHRASES} where regexp_matches(Part_Desc, pattern))"


@query(f"{CATALOG}, {BODY}, {HITS} select row_index, classpath, kind, phrase from h")
def j4_phrase_join(rows):
    return taxonomy.phrase_join(rows, RULES.phrases(rows.sparkSession), "row_index", "Part_Desc")


@query(f"{CATALOG}, {BODY}, {HITS} select distinct row_index, classpath from h where kind = 'must' and not exists (select 1 from h v where v.kind = 'veto' and v.row_index = h.row_index and v.classpath = h.classpath)")
def j5_veto_anti_must_semi(rows):
    hits = taxonomy.phrase_join(rows, RULES.phrases(rows.sparkSession), "row_index", "Part_Desc")
    side = lambda k: hits.where(F.col("kind") == k).select("row_index", "classpath").distinct()
    return side("must").join(side("veto"), ["row_index", "classpath"], "left_anti")


SCORES = f"m as (select row_index, grp, classpath, max(case when kind = 'must' then length(phrase) end) as len, count(distinct case when kind = 'boost' then phrase end) as nb, max(kind = 'veto') as veto from h group by 1, 2, 3), s as (select row_index, grp, classpath, 0.6::double + 0.25::double * least(len / 12.0::double, 1.0::double) + 0.18::double * least(nb, 4) as score from m where len is not null and not veto), r as (select *, row_number() over (partition by row_index order by score desc, classpath) as rank, lead(score) over (partition by row_index order by score desc, classpath) as second, lead(classpath) over (partition by row_index order by score desc, classpath) as runner_up from s)"


@query(f"{CATALOG}, {BODY}, {HITS}, {SCORES} select row_index, classpath, {micro('score')} as score from s")
def r3_category_scores(rows):
    made = rows.select("row_index", F.col("Part_Desc").alias("prepared"))
    return taxonomy.matches(made, RULES).select("row_index", "classpath", learn.micro(F.col("base")).alias("score"))


CLASSIFIED = f"k as (select row_index, grp, classpath, {micro('least(0.99::double, 0.55::double * least(score, 1.0::double) + 0.45::double * least((score - coalesce(second, 0.0::double)) / 0.4::double, 1.0::double))')} as confidence, {micro('score - coalesce(second, 0.0::double)')} as margin, runner_up from r where rank = 1)"


@query(f"{CATALOG}, {BODY}, {HITS}, {SCORES}, {CLASSIFIED} select c.row_index, classpath, coalesce(confidence, 0.0::double) as confidence, coalesce(margin, 0.0::double) as margin, runner_up from c left join k using (row_index)")
def r2_classify(rows):
    made = rows.select("row_index", text.group_key(F.col("Part_Manuf")).alias("grp"), F.col("Part_Desc").alias("prepared"))
    return taxonomy.classify(made, RULES).drop("how")


@query(f"{CATALOG}, {BODY}, {HITS}, {SCORES} select row_index, classpath, rank from (select row_index, classpath, cast(rank as integer) as rank from r) where rank <= 2")
def w1_best_and_runner_up(rows):
    made = rows.select("row_index", text.group_key(F.col("Part_Manuf")).alias("grp"), F.col("Part_Desc").alias("prepared"))
    return taxonomy.ranked(made, RULES).select("row_index", "classpath", "rank")


@query(f"with p as ({PRIOR_SQL}), x as (select grp, weight * 10 as weight, total, case when classpath like '1%' then share + 0.5 else share end as share, classpath from p) select grp, first(classpath order by weight desc, classpath) as lent from x group by grp having first(share order by weight desc, classpath) >= 0.15")
def r4_prior_only(spark, sf_dir):
    top = learn.prior_top(learn.group_prior(_votes(spark, sf_dir)).withColumn("share", F.when(F.col("classpath").startswith("1"), F.col("share") + 0.5).otherwise(F.col("share"))))
    return top.where("share >= 0.15").select("grp", F.col("classpath").alias("lent"))


_LEGAL = values(fixed.LEGAL_ENTITIES.items(), "k", "v")


@query(f"with x as (select p_partkey, case p_partkey % 4 when 0 then 'Frigidaire' when 1 then 'WHIRLPOOL' when 2 then p_brand else '' end as brand from part) select p_partkey, coalesce(v, brand) as maker, case when v is not null then 'crosswalk' when brand <> '' then 'derived' else 'unresolved' end as source from x left join {_LEGAL} on lower(brand) = k")
def j7_manufacturer(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 4 == 0, "Frigidaire").when(F.col("p_partkey") % 4 == 1, "WHIRLPOOL").when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).otherwise("")
    m = read(spark, sf_dir, "part").select("p_partkey", entity.manufacturer(brand, F.lit(True)).alias("m"))
    return m.select("p_partkey", F.col("m.value").alias("maker"), "m.source")


_URLS = values(fixed.URL_TEMPLATES.items(), "k", "v")


@query(f"with x as (select p_partkey, case p_partkey % 3 when 0 then 'Whirlpool®' when 1 then 'Maytag Laundry' else p_brand end as brand from part) select p_partkey, replace(coalesce(a.v, e.v), '{{mpn}}', 'M' || cast(p_partkey as varchar)) as url from x left join (select * from {_URLS}) a on a.k = lower(trim(replace(brand, '®', ''))) left join (select * from {_URLS}) e on e.k = string_split(lower(trim(replace(brand, '®', ''))), ' ')[1]")
def j8_manufacturer_url(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 3 == 0, "Whirlpool®").when(F.col("p_partkey") % 3 == 1, "Maytag Laundry").otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", text.url_of(brand, F.concat(F.lit("M"), F.col("p_partkey").cast("string"))).alias("url"))


_LEAVES = values([(c.classpath, c.leaf, c.department, c.klass) for c in RULES.categories], "classpath", "leaf", "department", "klass")


@query(f"select r_regionkey, classpath, leaf, department, klass from region cross join {_LEAVES}")
def j9_classpath_crosswalk(spark, sf_dir):
    table = RULES.category_table(spark).select("classpath", "leaf", "department", "klass")
    rows = read(spark, sf_dir, "region").withColumn("classpath", F.explode(F.array(*(F.lit(c.classpath) for c in RULES.categories))))
    return rows.join(F.broadcast(table), "classpath").select("r_regionkey", "classpath", "leaf", "department", "klass")  # one row a category


@query(f"{CATALOG}, {BODY}, {TOKENS}, t as (select 0 as tier, p_partkey as ord, p_brand as name from part union all select 1, p_partkey, p_type from part union all select 2, p_partkey, upper(substr(p_name, 1, strpos(p_name || ' ', ' ') - 1)) from part), h as (select distinct token, tier, ord, name from tok join t on lower(token) = lower(name)) select token, first(name order by tier, ord, name) as name, min(tier) as tier from h group by token")
def j10_exact_link(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    first = F.upper(F.element_at(F.split("p_name", " "), 1))
    names = F.array(*(F.struct(F.lit(i).alias("tier"), F.col("p_partkey").alias("ord"), n.alias("name")) for i, n in enumerate((F.col("p_brand"), F.col("p_type"), first))))
    return entity.exact_links(learn.token_positions(catalogue.bridge(spark, sf_dir)), part.select(F.explode(names).alias("n")).select("n.*")).select("token", "name", "tier")


@query()
def j11_tiered_link(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    # Names with letters left out: each is close to what it was made of.
    tokens = part.select(F.regexp_replace(F.regexp_replace("p_name", " ", ""), "(?<=...)[aeiou]", "").alias("token"))
    tiers = part.select((F.col("p_partkey") % 2).cast("int").alias("tier"), F.col("p_partkey").alias("ord"), F.regexp_replace("p_name", " ", "").alias("name"))
    return entity.tiered_links(tokens.where("token <> ''"), tiers).select("token", "name", "tier")


#: The catalogue with a word of each account's own at the head of its descriptions. A third of the accounts (kind 0) have
#: that word's company in a brand column here and there, a third (1) the word itself in another column, the rest nothing.
_WORDS = (
    "select *, upper(substr(l, 1, 1)) || substr(l, 2) as w, ascii(substr(l, 2, 1)) % 3 as kind, ascii(substr(md5(Mfg_Part_Num), 1, 1)) % 2 = 0 as told "
    "from (select *, translate(substr(md5(Part_Manuf), 1, 8), '0123456789', 'ghijklmnop') as l from {c}) as named"
)
_BRANDED = (
    "select row_index, Mfg_Part_Num, w || ' ' || substr(Part_Desc, 10) || ' general purpose shop stock' as Part_Desc, '-- Unbranded --' as E1_Brand, case when kind = 1 and told then w else '-- No Unilog Brand --' end as Unilog_Brand, "
    f"case when kind = 0 and told then w || ' Company' else '-- No DIB Brand --' end as DIB_Brand, Part_Manuf from ({_WORDS}) as worded"
)
_BRANDED_SQL = f"with c as ({_BRANDED.format(c=f'({catalogue.BRIDGE}) as bridge')})"


def branded(rows):
    return rows.sparkSession.sql(_BRANDED, c=rows)


@query(
    f"with g as (select Part_Manuf as grp, w as token, kind, count(*) as hits, count(*) filter (where told) as votes from ({_WORDS.format(c=f'({catalogue.BRIDGE}) as bridge')}) group by 1, 2, 3) "
    "select grp, token, hits, case when kind = 0 and votes > 0 then token || ' Company' else token end as canonical, case when kind = 0 and votes > 0 then 'group-brand-column(' || votes || ' rows)' when kind = 1 and votes > 0 then 'exact:unilog-brand-column' else 'unlinked' end as linkage, kind < 2 and votes > 0 as attested from g"
)
def j12_link_brands(rows):
    """Every brand token of the catalogue on the ladder: group column, exact name, product word, likeness, none."""
    rows = enrich.shared(branded(rows))
    return learn.link_brands(rows, learn.product_words(learn.product_types(rows)), stored).select("grp", "token", "hits", "canonical", "linkage", "attested")


@query(f"{_BRANDED_SQL}, {BODY}, {STACK} select value, 1 as kept from st group by 1")
def j19_no_attested_candidates(rows):
    """Brands that columns attest are entries, whatever else their tokens would make of them; none stays a candidate."""
    rows = enrich.shared(branded(rows))
    _, known, candidates = enrich.brand_vocabulary(rows)
    values = learn.attested_brands(rows).select("value")
    kept = values.join(known, F.col("value") == F.col("canonical"), "left_semi")
    return kept.join(candidates, F.col("value") == F.col("canonical"), "left_anti").select("value", F.lit(1).alias("kept"))


@query("with g as (select *, row_number() over (partition by p_name order by p_partkey desc) as rn from part), w as (select * from g where rn = 1), f as (select p.p_name as k, 'brand' as field, p.p_brand as got, w.p_brand as want from part p join w using (p_name) union all select p.p_name, 'type', lower(p.p_type), w.p_type from part p join w using (p_name)) select field, count(*) as compared, cast(count_if(got = want) as bigint) as exact, cast(count_if(lower(got) = lower(want)) as bigint) as normalised from f group by field")
def j14_gold_scores(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    got = part.select(F.col("p_name").alias("Mfg_Part_Num"), F.col("p_brand").alias("brand"), F.lower("p_type").alias("type"))
    gold = part.select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("Mfg_Part_Num"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return score.gold_scores(got, gold, ["brand", "type"])


@query("select p_partkey as row_index, 'Color' as label, p_type as value from part where p_type not in ('Red', 'Blue') and p_partkey % 2 = 0")
def j15_lov_violations(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.when(F.col("p_partkey") % 2 == 0, "Color").otherwise("Free").alias("label"), F.col("p_type").alias("value"))
    return score.lov_violations(pairs, RULES.lov_table(spark)).select("row_index", "label", "value")


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines as tokens and entities, both by order in parts of half a million narrow rows, so that aligning them needs
    no other exchange and a task's memory does not follow the table's size."""
    lines = read(spark, sf_dir, "lineitem")
    lines = catalogue.dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", lines.count(), 500_000)
    tokens = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.when(F.col("l_partkey") % 7 == 0, 0).otherwise(5)).alias("end")).distinct()
    entities = lines.where("l_linenumber % 3 = 1").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") * 10).alias("e_start"), (F.col("l_linenumber") * 10 + 16).alias("e_end"), F.lit("X").alias("label"))
    return tokens, entities


BIO = "tk as (select l_orderkey as id, l_linenumber as pos, l_linenumber * 10 as s, l_linenumber * 10 + case when l_partkey % 7 = 0 then 0 else 5 end as e from lineitem), en as (select l_orderkey as id, l_linenumber as ord, l_linenumber * 10 as es, l_linenumber * 10 + 16 as ee from lineitem where l_linenumber % 3 = 1), al as (select tk.id, pos, s, e, first(es order by ord) filter (es is not null) as es from tk left join en on en.id = tk.id and s >= es and e <= ee group by 1, 2, 3, 4), tags as (select id, pos, case when s = e then null when es is null then 'O' when s = es then 'B-X' else 'I-X' end as tag from al)"


@query(f"with {BIO} select * from tags")
def j16_align_bio(spark, sf_dir):
    return score.align_bio(*_tokens(spark, sf_dir))


# Windows


_TAGGED = "select l_orderkey as id, l_linenumber as pos, min(case l_partkey % 6 when 0 then 'B-' || l_returnflag when 3 then 'O' when 5 then null else 'I-' || l_returnflag end) as tag from lineitem group by 1, 2"


@query(f"with t as ({_TAGGED}), n as (select id, max(pos) + 1 as n from t group by 1), u as (select *, lag(tag) over (partition by id order by pos) as prev from t where tag is not null), m as (select *, sum(case when tag[1] = 'I' and prev <> 'O' and substr(prev, 3) = substr(tag, 3) then 0 else 1 end) over (partition by id order by pos) as run from u), r as (select id, run, min(pos) as start, min_by(tag, pos) as first from m group by 1, 2), x as (select *, lead(start) over (partition by id order by run) as next from r) select id, start, coalesce(next, n) as stop, substr(first, 3) as label from x join n using (id) where first[1] = 'B'")
def w6_decode_spans(spark, sf_dir):
    tagged = spark.sql(_TAGGED.replace("lineitem", "{lines}"), lines=read(spark, sf_dir, "lineitem"))
    return score.decode_spans(tagged)


@query("with g as (select o_custkey as grp, o_orderpriority as value, count(*) as n, min(o_orderkey) as seen from orders group by 1, 2) select grp, value, cast(row_number() over (partition by grp order by n desc, seen) as integer) as place from g")
def w2_first_seen_order(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return score.placed(rows, "grp", "value", "o_orderkey")


@query(f"{CATALOG} select row_index, cast(regexp_extract(Part_Desc, '(\\d+)\"x', 1) as varchar) || ' in x ' || case row_index % 4 when 0 then '1/8' when 1 then '3/8' when 2 then '5/8' else '7/8' end || ' in' as run from c")
def w3_dimension_run(rows):
    made = rows.withColumn("m", units.find_measurements("Part_Desc")).withColumn("run", units.dimension_run(F.col("m"), F.col("Part_Desc")))
    return made.select("row_index", F.array_join(F.transform("run", lambda m: F.concat_ws(" ", m["magnitude"], m["unit"])), " x ").alias("run"))


@query(
    "with s as (select l_orderkey as id, cast(l_linenumber * 10 - l_quantity % 7 as integer) as a, cast(l_linenumber * 10 + l_quantity % 25 + 1 as integer) as b, l_returnflag as x from lineitem), "
    "l as (select id, list(struct_pack(a := a, b := b, x := x) order by a, b desc, x) as l from s group by id), "
    "k as (select id, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda kept, v: case when v[1].a >= kept[-1].b then list_concat(kept, v) else kept end)) as k from l) "
    "select id, k.a as start, k.b as \"end\", k.x as label from k"
)
def w4_without_overlaps(spark, sf_dir):
    quantity = F.col("l_quantity").cast("int")
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10 - quantity % 7).cast("int").alias("start"), (F.col("l_linenumber") * 10 + quantity % 25 + 1).cast("int").alias("end"), F.col("l_returnflag").alias("label"))
    return score.without_overlaps(spans)


@query("with s as (select l_orderkey as id, l_linenumber * 10 as a, l_linenumber * 10 + 4 + cast(l_quantity as integer) % 12 as b from lineitem), o as (select *, max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding) as reach from s), r as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by id order by a, b) as run from o) select id, min(a) as start, max(b) as \"end\" from r group by id, run")
def w5_merged_spans(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return score.merged_spans(lines.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 4 + F.col("l_quantity").cast("int") % 12).alias("end")))


@query(f"{CATALOG}, {BODY}, {TOKENS} select row_index, lower(token) as low, {micro('min(pos::double / n)')} as p from tok group by 1, 2")
def w7_first_position(rows):
    return learn.token_positions(rows).groupBy("row_index", "low").agg(learn.micro(F.min(F.col("pos") / F.col("n"))).alias("p"))


@query(f"{CATALOG}, {BODY}, {TOKENS} select token, count(*) as n from tok group by 1 order by n desc, token limit 20")
def w8_top_tokens(rows):
    return learn.top_tokens(rows)


# Cells, scores and reports over synthetic cells: every order is a row, every priority a source


_SOURCES = {"1-URGENT": "input_copy", "2-HIGH": "regex_extract", "3-MEDIUM": "llm", "4-NOT SPECIFIED": "unresolved", "5-LOW": "derived"}
CELLS = "cells as (select o_custkey as row_index, case o_orderkey % 7 when 0 then 'BRAND_NAME' when 1 then 'MANUFACTURER_NAME' when 2 then 'Classpath' when 3 then 'SHORT_DESC' when 4 then 'INVOICE_DESC' when 5 then 'MOBILE_DESC' else 'Dept' end as header, case when o_orderkey % 11 = 0 then '' else o_orderstatus end as value, case o_orderpriority " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in _SOURCES.items()) + " else 'crosswalk' end as source, cast((o_orderkey % 101) / 100.0::double as double) as confidence from orders)"
_HEADERS = ("BRAND_NAME", "MANUFACTURER_NAME", "Classpath", "SHORT_DESC", "INVOICE_DESC", "MOBILE_DESC", "Dept")


def some_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    source = F.coalesce(F.element_at(text.lexicon(_SOURCES), F.col("o_orderpriority")), F.lit("crosswalk"))
    value = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_custkey").alias("row_index"), header.alias("header"), value.alias("value"), source.alias("source"), F.lit("r").alias("rule"), ((F.col("o_orderkey") % 101) / 100.0).cast("double").alias("confidence"))


@query(f"with {CELLS} select source, count(*) as n from cells where trim(value) <> '' group by source")
def a17_source_histogram(spark, sf_dir):
    return score.source_histogram(some_cells(spark, sf_dir))


@query(f"with {CELLS} select source, count(*) as n from cells where trim(value) = '' group by source")
def a18_blank_histogram(spark, sf_dir):
    return score.source_histogram(some_cells(spark, sf_dir), blank=True)


@query(f"with {CELLS} select row_index, source, count(*) as n from cells where trim(value) <> '' group by 1, 2")
def a19_sources_by_row(spark, sf_dir):
    return score.sources_by_row(some_cells(spark, sf_dir))


@query(f"with {CELLS} select row_index, header, value, source from cells where source in ('llm', 'local_model') and value <> ''")
def p9_generative_cells(spark, sf_dir):
    return C.generative(some_cells(spark, sf_dir)).select("row_index", "header", "value", "source")


@query(f"with {CELLS} select row_index, header, value, source, {micro('confidence', 4)} as confidence from cells where value <> '' or source <> 'unresolved'")
def k4_audit_record(spark, sf_dir):
    return C.audit(some_cells(spark, sf_dir)).select("row_index", "header", "value", "source", learn.micro(F.col("confidence"), 4).alias("confidence"))


_WEIGHTS = values([(k, str(v)) for k, v in fixed.SOURCE_WEIGHTS.items()], "source", "w")
_CRIT = ", ".join(map(quoted, score.CRITICAL))
QUALITY = f"w as (select cells.*, cast(w as double) as w from cells left join {_WEIGHTS} using (source)), q as (select row_index, count_if(value <> '') as nf, {micro('coalesce(avg(case when value <> $$$$ then w * confidence end), 0.0::double) + 1e-9::double')} as pq, count(distinct case when value <> '' and header in ({_CRIT}) then header end) / 6.0::double as cs, count_if(value <> '' and source = 'llm') as g from w group by 1)"


@query(f"with {CELLS}, {QUALITY} select row_index, cast(nf as bigint) as n_filled, pq as provenance_quality, cs as critical_score, case when nf > 0 then g::double / nf else 0.0::double end as generative_share from q")
def a24_row_quality(spark, sf_dir):
    return score.quality(some_cells(spark, sf_dir)).drop("missing")


def some_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("row_index"), (k % 45).cast("int").alias("invoice_length"), (k % 100).cast("int").alias("mobile_length"), (k % 13 == 0).cast("int").alias("n_lov_violations"), (k % 9 == 0).alias("unclassified"), (k % 8 == 0).alias("brand_unresolved"), ((k % 30) / 100.0).cast("double").alias("margin"), F.lit("other").alias("runner_up"))


VERDICT = f"ck as (select c_custkey as row_index, c_custkey % 45 as il, c_custkey % 100 as ml, c_custkey % 13 = 0 as lov, c_custkey % 9 = 0 as un, c_custkey % 8 = 0 as br, (c_custkey % 30) / 100.0::double as mg from customer), t as (select q.*, coalesce(il > 40, false) as t1, coalesce(ml > 0 and not ml between 60 and 80, false) as t2, coalesce(lov, false) as t3, coalesce(un, false) as t4, coalesce(br, false) as t5, coalesce(mg > 0 and mg < 0.1::double, false) as t6 from q left join ck using (row_index)), v as (select row_index, {micro('case when nf = 0 then 0.0::double else greatest(0.0::double, least(1.0::double, 0.45::double * pq + 0.30::double * cs + 0.25::double * (1.0::double - case when nf > 0 then g::double / nf else 0.0::double end) - (0.0::double + 0.0::double + case when t1 then 0.25::double else 0.0::double end + case when t2 then 0.1::double else 0.0::double end + case when t3 then 0.25::double else 0.0::double end + case when t4 then 0.2::double else 0.0::double end + case when t5 then 0.2::double else 0.0::double end + case when t6 then 0.08::double else 0.0::double end))) end + 1e-9::double')} as confidence, case when nf = 0 then 1 else cast(6 - round(cs * 6) as bigint) + (g > 0)::int + t1::int + t2::int + t3::int + t4::int + t5::int + t6::int end as n_reasons from t)"


@query(f"with {CELLS}, {QUALITY}, {VERDICT} select row_index, confidence, n_reasons > 0 or confidence < 0.7 as needs_review, cast(n_reasons as integer) as n_reasons from v")
def a24_verdicts(spark, sf_dir):
    v = score.verdicts(some_cells(spark, sf_dir), some_checks(spark, sf_dir))
    return v.select("row_index", "confidence", "needs_review", F.size("reasons").alias("n_reasons"))


@query(f"with {CELLS}, {QUALITY}, {VERDICT} select case when confidence >= 0.85 and not (n_reasons > 0 or confidence < 0.7) then 'auto_publish' when confidence >= 0.45 then 'needs_review' else 'blocked' end as bucket, count(*) as n from v group by 1")
def a23_triage(spark, sf_dir):
    return score.triage(score.verdicts(some_cells(spark, sf_dir), some_checks(spark, sf_dir)))


@query("with r as (select unnest(['BRAND_NAME is empty', 'INVOICE_DESC is ' || cast(o_orderkey as varchar) || ' chars', '3 value(s) proposed', 'brand unresolved: x']) as r from orders) select substr(trim(string_split(string_split(string_split(r, ':')[1], ' is ')[1], ' value(s)')[1]), 1, 70) as reason, count(*) as n from r group by 1")
def a20_reason_histogram(spark, sf_dir):
    said = F.array(F.lit("BRAND_NAME is empty"), F.concat(F.lit("INVOICE_DESC is "), F.col("o_orderkey").cast("string"), F.lit(" chars")), F.lit("3 value(s) proposed"), F.lit("brand unresolved: x"))
    return score.reason_histogram(read(spark, sf_dir, "orders").select(said.alias("reasons")))


_LINES = "l as (select p_name as s, upper(substr(p_name || ' ' || p_type || ' ' || p_brand, 1, 20 + p_size)) as i, p_name || repeat('x', 40 + p_size) as m from part)"


@query(f"with {_LINES} select count(*) as rows, {micro('100.0::double * count_if(i <> $$$$ and length(i) <= 40) / greatest(count_if(i <> $$$$), 1)', 2)} as invoice_within_40_chars_pct, {micro('100.0::double * count_if(i = upper(i)) / greatest(count(*), 1)', 2)} as invoice_all_caps_pct, {micro('100.0::double * count_if(length(m) between 60 and 80) / greatest(count_if(m <> $$$$), 1)', 2)} as mobile_within_60_80_pct, cast(0 as bigint) as uom_spacing_violations from l")
def a21_compliance(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    line = F.upper(F.expr("substring(concat_ws(' ', p_name, p_type, p_brand), 1, 20 + p_size)"))
    return score.compliance(p.select(F.col("p_name").alias("SHORT_DESC"), F.col("p_name").alias("LONG_DESC1"), F.col("p_name").alias("RETAIL_DESC"), line.alias("INVOICE_DESC"), F.expr("concat(p_name, repeat('x', 40 + p_size))").alias("MOBILE_DESC")))


@query("with t as (select labels.toxic as label, quality as pred from labels), m as (select label, count(*) as t, count_if(label = pred) as tp from t group by 1), p as (select pred as label, count(*) as p from t group by 1), f as (select m.*, 2.0::double * tp / (t + coalesce(p, 0)) as f1 from m left join p using (label)) select " + micro("sum(tp)::double / sum(t)") + " as accuracy, " + micro("avg(f1)") + " as macro_f1 from f")
def a28_classification_metrics(spark, sf_dir):
    return score.classification_metrics(read(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("pred")))


@query("with a as (select distinct l_orderkey as id, l_linenumber as start, l_linenumber + 1 as stop, l_returnflag as label from lineitem), p as (select distinct id, start, stop, case when id % 5 = 0 then 'Z' else label end as label from a where id % 7 <> 0), b as (select count(*) as tp from a join p using (id, start, stop, label)), n as (select (select tp from b)::double as tp, (select count(*) from p)::double as p, (select count(*) from a)::double as a) select " + f"{micro('tp / p')} as entity_precision, {micro('tp / a')} as entity_recall, {micro('2 * tp / (p + a)')} as entity_f1 from n")
def a29_span_metrics(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("stop"), F.col("l_returnflag").alias("label"))
    p = a.where("id % 7 <> 0").withColumn("label", F.when(F.col("id") % 5 == 0, "Z").otherwise(F.col("label")))
    return score.span_metrics(p, a)


@query("select source as label, count(*) as n from documents group by 1 order by n desc, min(doc_id)")
def a32_class_distribution(spark, sf_dir):
    return score.histogram(read(spark, sf_dir, "documents").withColumnRenamed("source", "label"), "label", "doc_id")


@query("select count(*) as leaked from (select lower(text) as t from documents where doc_id % 8 <> 0 intersect select lower(text) from documents where doc_id % 8 = 0)")
def a33_leakage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score.leaked(docs.where("doc_id % 8 <> 0"), docs.where("doc_id % 8 = 0"))


# Orders, sets, rendering


@query(f"with {CELLS}, v as (select row_index, max(confidence) as confidence from cells group by 1) select row_index, {micro('confidence', 3)} as confidence from v where confidence < 0.9 order by confidence, row_index")
def o1_review_order(spark, sf_dir):
    v = some_cells(spark, sf_dir).groupBy("row_index").agg(F.max("confidence").alias("confidence")).where("confidence < 0.9")
    return v.orderBy("confidence", "row_index").select("row_index", learn.micro(F.col("confidence"), 3).alias("confidence"))


@query("select doc_id, text from (select doc_id, text, lang, row_number() over (partition by lower(text), lower(lang) order by doc_id) as rn from documents) where rn = 1")
def u6_keep_first(spark, sf_dir):
    return score.keep_first(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], "doc_id").select("doc_id", "text")


@query("select distinct 'Type' as label, p_type as value from part union select 'Type', p_type || ' Plus' from part union select 'Maker', p_brand from part")
def u2_lov_union(spark, sf_dir):
    return table_rules(spark, sf_dir).lov_table(spark)


@query("select p_partkey, array_to_string(list_filter([p_type, p_brand, p_name, 'UPC'], lambda h: not list_contains([p_type, 'UPC', case when p_size % 2 = 0 then p_brand else p_name end], h)), '|') as missing from part")
def u4_missing_headers(spark, sf_dir):
    have = F.array("p_type", F.lit("UPC"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", C.absent(F.array("p_type", "p_brand", "p_name", F.lit("UPC")), have).alias("missing"))


_STYLES = ("value_uom_label", "value_label_head", "count_hyphen", "series", "value_only_uom", "suffix_list", "hidden")
_STYLE = "case p_partkey % 7 " + " ".join(f"when {i} then {quoted(x)}" for i, x in enumerate(_STYLES)) + " end"
_LABEL = "case p_partkey % 7 when 1 then p_type || ' Type' when 2 then 'Number of ' || p_type || ' Cycles' else p_type || ' Level' end"
_NUMBER = "case when p_size % 11 = 0 then '' else cast(p_size as varchar) end"


@query(f"with x as (select p_partkey, {_STYLE} as style, {_LABEL} as label, {_NUMBER} as value, case when p_size % 2 = 0 then 'in' else '' end as uom from part) select p_partkey, case when value = '' or style = 'hidden' then '' when style = 'value_uom_label' then concat_ws(' ', value, nullif(uom, ''), label) when style = 'value_label_head' then value || ' ' || regexp_replace(label, ' Type$', '') when style = 'count_hyphen' then value || '-' || regexp_replace(substr(label, 11), 's$', '') when style = 'series' then value || ' Series' when style = 'value_only_uom' then concat_ws(' ', value, nullif(uom, '')) else label || ': ' || value end as said from x")
def r6_phrases(spark, sf_dir):
    text_of = lambda x: F.expr(x.replace("varchar", "string"))
    slot = F.struct(text_of(_LABEL).alias("label"), text_of(_STYLE).alias("style"), text_of(_NUMBER).alias("value"), F.when(F.col("p_size") % 2 == 0, "in").otherwise("").alias("uom"))
    return read(spark, sf_dir, "part").withColumn("s", slot).select("p_partkey", render.phrase(F.col("s")).alias("said"))


@query("with x as (select p_partkey, list_filter([p_name, p_type, p_brand, cast(p_size as varchar) || ' in'], lambda c: c <> '') as l from part) select p_partkey, list_reduce(l, lambda a, c: case when length(a) >= 24 then a when length(a || ', ' || c) > 30 then a else a || ', ' || c end, 'PN') as packed from x")
def r9_two_sided_packer(spark, sf_dir):
    parts = F.array("p_name", "p_type", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit(" in")))
    return read(spark, sf_dir, "part").select("p_partkey", render.pack(F.lit("PN"), parts, lo=24, hi=30)["text"].alias("packed"))


@query("with x as (select p_partkey, [p_name, p_type, p_brand] as l from part) select p_partkey, list_reduce(l, lambda a, c: case when length(a || ' ' || c) > 20 then a else a || ' ' || c end, 'PN') as packed from x")
def r10_one_sided_packer(spark, sf_dir):
    packed = render.pack(F.lit("PN"), F.array("p_name", "p_type", "p_brand"), lo=20, hi=20, joiner=" ", required=3)
    return read(spark, sf_dir, "part").select("p_partkey", packed["text"].alias("packed"))


# Extraction by single slots


_SHORT = "p_name || ' ' || case p_partkey % 4 when 0 then cast(1000 + 100 * p_size as varchar) || 'K ' || cast(p_size as varchar) || 'pk' when 1 then cast(15 + p_size as varchar) || 'k T' || cast(10 + p_size as varchar) when 2 then 'P' || cast(40 + p_size as varchar) || ' ' || cast(1 + p_size % 9 as varchar) || 'G' else cast(10 + p_size as varchar) || '-' || cast(1 + p_size % 9 as varchar) || ' cord #' || cast(p_size % 10 as varchar) end"


def _only(k: int, x: str) -> str:
    return f"case when p_partkey % 4 = {k} then cast({x} as varchar) end"


@query(f"select p_partkey, coalesce({_only(0, '1000 + 100 * p_size')}, {_only(1, '100 * (15 + p_size)')}) as cct, {_only(2, '40 + p_size')} as grit, {_only(0, 'p_size')} as pack, coalesce({_only(1, chr(39) + 'T' + chr(39) + ' || cast(10 + p_size as varchar)')}, {_only(3, chr(39) + '#' + chr(39) + ' || cast(p_size % 10 as varchar)')}) as drive, {_only(2, '1 + p_size % 9')} as gangs, {_only(3, '10 + p_size')} as gauge, {_only(3, '1 + p_size % 9')} as conductors from part")
def e1_single_slots(spark, sf_dir):
    t = F.expr(_SHORT.replace("varchar", "string"))
    found = (extract.color_temperature(t).alias("cct"), extract.grit(t).alias("grit"), extract.pack_quantity(t).alias("pack"), extract.drive_size(t).alias("drive"), extract.gangs(t).alias("gangs"), extract.wire(t)["size"].alias("gauge"), extract.wire(t)["conductors"].alias("conductors"))
    return read(spark, sf_dir, "part").select("p_partkey", *found)


@query("select p_partkey, case p_partkey % 3 when 0 then cast(p_size as varchar) || ' in x ' || cast(p_size + 2 as varchar) || ' in x ' || cast(2 * p_size as varchar) || ' ft' when 1 then cast(p_size as varchar) || ' in x ' || cast(p_size + 4 as varchar) || ' in' else cast(p_size as varchar) || '-1/2 in x 1/8 in x ' || cast(p_size + 1 as varchar) || ' in' end as size from part")
def e4_nominal_size(spark, sf_dir):
    n = lambda k, times=1: (F.col("p_size") * times + k).cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), n(0), F.lit("nx"), n(2), F.lit("-"), n(0, 2), F.lit("' Grooved"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Stud "), n(0), F.lit("x"), n(4))).otherwise(F.concat(F.lit("Wheel "), n(0), F.lit("-1/2x1/8x"), n(1)))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.nominal_size(t), " x ").alias("size"))


@query(f"{CATALOG} select row_index, case when regexp_matches(Part_Desc, '(?i)(?:^|[^A-Za-z0-9])blue(?:e?s)?(?:[^A-Za-z0-9]|$)') then 'Blue' when regexp_matches(Part_Desc, '(?i)(?:^|[^A-Za-z0-9])red(?:e?s)?(?:[^A-Za-z0-9]|$)') then 'Red' end as color, nullif(regexp_extract(Part_Desc, '(?i)(?:^|[^A-Za-z0-9])(\\d{{1,4}})\\s*[-]?\\s*(?:pc)(?:e?s)?(?:[^A-Za-z0-9]|$)', 1), '') as pieces from c")
def e9_lov_and_count(rows):
    color = next(s for s in RULES.contract("hardware") if s.label == "Color")
    return rows.select("row_index", extract.lov_value(F.col("Part_Desc"), color).alias("color"), extract.count_of(F.col("Part_Desc"), "pc").alias("pieces"))


@query(
    f"{CATALOG}, {BODY}, s as (select row_index, body, regexp_extract(body, '(\\d+)\"x', 1) as one, regexp_extract(body, 'x(\\d/8)', 1) as two, split_part(body, ' ', 1) as word, (body like '% 6pc')::int as pack from b), "
    "p as (select *, strpos(body, one || '\"x') - 1 as a, strpos(body, one || '\"x') + length(one) + 5 as z, upper(word[1:1]) || word[2:] as said from s), "
    "f as (select row_index, 0 as i, 'Width' as label, one as value, 'in' as uom, 'regex_extract' as source, 'dimension:unit-bearing-run:Width' as rule, 0.88::double as confidence, a, z from p "
    "union all select row_index, 1, 'Length', two, 'in', 'regex_extract', 'dimension:unit-bearing-run:Length', 0.88::double, a, z from p "
    "union all select row_index, 2, 'Size', one || ' in x ' || two || ' in', '', 'regex_extract', 'dimension:unit-bearing-run:Size', 0.9::double, a, z from p "
    "union all select row_index, 3, 'Pack Quantity', '6', 'pc', 'regex_extract', 'pack:suffix', 0.92::double, length(body) - 3, length(body) from p where pack = 1 "
    "union all select row_index, 3 + pack, 'Color', said, '', 'lexicon_exact', 'lov:Color', 0.95::double, 0, length(word) from p where word in ('red', 'blue') "
    "union all select row_index, 3 + pack, 'Condition', said, '', 'regex_extract', 'cue:' || word, 0.8::double, 0, length(word) from p where word in ('hot', 'cold')) "
    'select row_index, i, label, value, uom, source, rule, confidence, cast(a as integer) as start, cast(z as integer) as "end" from f'
)
def e14_extract_contract(rows):
    made = bodies(rows).withColumn("contract", F.lit("hardware"))
    return extract.extract(made, RULES).select("row_index", F.posexplode("filled").alias("i", "f")).select("row_index", "i", "f.*")


# Engine


@query()
def r1_resolve_brands(rows):
    rows = enrich.shared(rows)
    aliases = enrich.brand_aliases(rows)
    out = entity.resolve_brands(rows, aliases, learn.brand_prior(rows, aliases))
    return out.select("row_index", "brand_plain", "brand", "rung", "confidence")


@query()
def r17_enrich(rows):
    rows = enrich.shared(rows)
    out = enrich.enriched(rows, RULES, enrich.learned(rows, RULES))
    return out.select("row_index", "classpath", "confidence", "how", "brand", "rung", "manufacturer", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MOBILE_DESC", "INVOICE_DESC", "approvals")


@query()
def r18_run_verdicts(rows):
    _, _, verdict, _ = enrich.run(rows, RULES)
    return verdict.select("row_index", "confidence", "needs_review", F.array_join("reasons", " | ").alias("reasons"))


@query("select o_orderkey, case when (o_orderkey % 97) / 96.0::double < 0.45 then 'blocked' when o_orderstatus = 'F' then 'review' else '' end as tone from orders")
def k2_row_tone(spark, sf_dir):
    tone = score.row_tone((F.col("o_orderkey") % 97).cast("double") / 96.0, F.col("o_orderstatus") == "F")
    return read(spark, sf_dir, "orders").select("o_orderkey", tone.alias("tone"))


@query("select key, response from (select cast(c_nationkey as varchar) as key, c_name as response, row_number() over (partition by c_nationkey order by c_custkey desc) as rn from customer) where rn = 1")
def s9_last_reply(spark, sf_dir):
    return catalogue.last_replies(read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("response"), F.col("c_custkey").alias("line_no")))


# More joins, folds and sets


@query(f"with {CELLS} select row_index, header, value from cells where trim(value) <> ''")
def p8_filled_cells(spark, sf_dir):
    return C.filled(some_cells(spark, sf_dir)).select("row_index", "header", "value")


@query("select l_orderkey, l_linenumber, (l_linenumber * 10 < l_quantity and l_linenumber * 10 + 8 > 3) or (l_linenumber * 10 < l_quantity + 12 and l_linenumber * 10 + 8 > l_quantity + 5) as taken from lineitem")
def p14_span_overlap(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    claimed = F.array(F.struct(F.lit(3.0).alias("s"), q.alias("e")), F.struct((q + 5).alias("s"), (q + 12).alias("e")))
    at = F.col("l_linenumber") * 10
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", extract.overlaps(claimed, at, at + 8).alias("taken"))


@query("select p_partkey as row_index, 'ATTRIBUTE_LABEL 1' as header, 'Color' as value from part union all select p_partkey, 'ATTRIBUTE_VALUE 1', p_type from part union all select p_partkey, 'ATTRIBUTE_UOM 1', '' from part union all select p_partkey, 'ATTRIBUTE_LABEL 2', 'Size' from part union all select p_partkey, 'ATTRIBUTE_VALUE 2', cast(p_size as varchar) from part union all select p_partkey, 'ATTRIBUTE_UOM 2', 'in' from part")
def p15_attribute_triples(spark, sf_dir):
    slot = lambda a, v, u: F.struct(F.lit(a).alias("label"), v.alias("value"), F.lit(u).alias("uom"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.array(slot("Color", F.col("p_type"), ""), slot("Size", F.col("p_size").cast("string"), "in"), slot("Dropped", F.lit("x"), "")).alias("slots"))
    return C.attribute_cells(rows, limit=2).select("row_index", "header", "value")


@query("select p_partkey as row_index, case when p_partkey % 2 = 0 then 'Steel' else p_type end as value, case when p_partkey % 2 = 0 then 0.72::double else 0.8::double end as confidence from part")
def p16_implied_values(spark, sf_dir):
    own = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type"))
    slot = F.struct(F.lit("Material").alias("label"), own.alias("value"), F.lit("").alias("uom"), F.lit("").alias("source"), F.lit("").alias("rule"), F.lit(0.8).alias("confidence"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.lit("Goods > A").alias("classpath"), F.lit(0.8).alias("confidence"), F.array(slot).alias("slots"))
    out = render.with_implied(rows, Rules((Category("Goods > A", implies=(("Material", "Steel"),)),)))
    return out.select("row_index", F.col("slots")[0]["value"].alias("value"), learn.micro(F.col("slots")[0]["confidence"]).alias("confidence"))


_A15 = ORACLE_SQL["a15_brand_prior"]


@query(f"with pr as ({_A15}), x as ({catalogue.BRIDGE}) select row_index, brand from x left join pr on grp = Part_Manuf")
def j3_brand_prior(rows):
    own = F.concat(F.lit("Brand "), F.regexp_extract("Part_Manuf", r"#0*(\d+)", 1))
    prior = learn.brand_prior(rows.withColumn("DIB_Brand", F.when(F.col("row_index") % 4 == 0, own).otherwise(F.col("DIB_Brand"))))
    return rows.withColumn("grp", text.group_key(F.col("Part_Manuf"))).join(prior.select("grp", "brand"), "grp", "left").select("row_index", "brand")


#: Letters in common, in order, by the usual table, one row of it a letter.
_COMMON = (
    "list_last(list_reduce(string_split(lower(head), ''), lambda row, c: list_reduce(range(1, length(name) + 1), "
    "lambda made, j: list_append(made, greatest(row[j + 1], made[j], row[j] + case when lower(name[j]) = c then 1 else 0 end)), [0::bigint]), "
    "list_transform(range(0, length(name) + 1), lambda j: 0::bigint)))"
)


@query(
    "with h as (select s_suppkey, case when s_suppkey % 3 = 0 then replace(s_name, 'pp', 'p') when s_suppkey % 3 = 1 then substr(s_name, 2) else s_name || ' x' end as head from supplier), "
    f"n as (select s_name as name, s_suppkey * 7 % 101 as ord from supplier where s_suppkey % 2 = 0), d as (select distinct head from h), m as (select head, name, ord, 200.0::double * {_COMMON} / (length(head) + length(name)) as score from d cross join n), "
    "b as (select head, first(name order by ord, name) as name from m where score >= 88 group by head) select s_suppkey, head, b.name as brand from h join b using (head)"
)
def j12_account_heads(spark, sf_dir):
    """Misspelt account heads against the even suppliers' names, in an order of their own."""
    supplier = read(spark, sf_dir, "supplier")
    three = F.pmod("s_suppkey", F.lit(3))
    head = F.when(three == 0, F.replace("s_name", F.lit("pp"), F.lit("p"))).when(three == 1, F.substring("s_name", 2, 99)).otherwise(F.concat("s_name", F.lit(" x")))
    heads = supplier.select("s_suppkey", head.alias("head"))
    names = supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.expr("s_suppkey * 7 % 101").alias("ord"))
    near = entity.close_names(heads, names)
    return heads.join(near, "head").select("s_suppkey", "head", F.col("name").alias("brand"))


@query("select p_partkey, case when list_contains((select list(t) from (select t, row_number() over (order by t) as n from (select distinct p_type as t from part)) where n % 2 = 1), p_type) then 'contract ' || p_type else 'generic' end as contract from part")
def j13_contract_default(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Parts > "), "p_type").alias("classpath"))
    return taxonomy.with_category(rows, table_rules(spark, sf_dir)).select("p_partkey", "contract")


@query("select p_partkey as row_index, cast(case when p_size % 3 = 0 then p_size + 7 else p_size end as varchar) as width from part")
def j17_nearest(spark, sf_dir):
    """The measurement next to the cue, wherever the cue stands among others."""
    rules = Rules((), {"generic": (Slot("Width", "measure", family="length", cues=("wide",)),)})
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + 7).cast("string")
    body = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("board "), a, F.lit(" in high and long, "), b, F.lit(" in wide"))).otherwise(F.concat(F.lit("wide "), a, F.lit(" in board, of great height "), b, F.lit(" in")))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), body.alias("body"), F.lit("generic").alias("contract"))
    return extract.extract(rows, rules).select("row_index", F.get("filled", F.lit(0))["value"].alias("width"))


@query(f"{CATALOG}, {BODY}, {TOKENS} select distinct token from tok where lower(token) not in (select lower(unnest(regexp_extract_all(p_type || ' ' || p_brand, '[A-Za-z][A-Za-z-]*'))) from part where p_partkey % 2 = 0)")
def j18_product_word_filter(rows):
    spark = rows.sparkSession
    return learn.no_product_words(learn.token_positions(rows), learn.product_words(_even_types(rows)))


@query(f"with {CELLS} select count(distinct row_index) as rows, count(distinct case when header = 'Classpath' and trim(value) <> '' then row_index end) as classified, cast(count_if(trim(value) <> '') as bigint) as filled, cast(count_if(source in ('llm', 'local_model') and trim(value) <> '') as bigint) as proposed from cells")
def a22_run_stats(spark, sf_dir):
    return score.run_stats(some_cells(spark, sf_dir))


@query(f"with {CELLS} select row_index, {micro('avg(case when trim(value) <> $$$$ then 1.0::double else 0.0::double end)')} as coverage from cells group by 1")
def a26_coverage(spark, sf_dir):
    return score.coverage(some_cells(spark, sf_dir))


@query("select distinct lower(w) as word from (select unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*')) as w from (select p_type as t from part union select p_brand from part union select replace(p_brand, ' ', '-nr ') from part union select p_type || ' make' from part))")
def a27_listed_words(spark, sf_dir):
    words = extract.listed_words(table_rules(spark, sf_dir).contract("generic"))
    return spark.createDataFrame([(w,) for w in sorted(words)], "word string")


@query("select o_orderpriority as k, count(*) as n from orders group by 1 order by n desc, min(o_orderkey)")
def o2_histogram_order(spark, sf_dir):
    return score.histogram(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "k"), "k", "o_orderkey")


_RANKS = [("a", "p_size", "p_partkey % 3"), ("b", "50 - p_size", "0"), ("c", "p_partkey % 7", "p_size % 2"), ("d", "20", "p_partkey % 2 * 2")]


@query("with x as (" + " union all ".join(f"select p_partkey, {quoted(n)} as label, {i} as i, cast({r} as integer) as r, cast({t} as integer) as t from part" for i, (n, r, t) in enumerate(_RANKS)) + ") select p_partkey, string_agg(label, ',' order by case when t > 0 then t else r + 1000 end, i) as ordered from x group by 1")
def o3_channel_order(spark, sf_dir):
    slots = F.array(*(F.struct(F.lit(n).alias("label"), F.expr(r).cast("int").alias("rank"), F.expr(t).cast("int").alias("title_rank")) for n, r, t in _RANKS))
    return read(spark, sf_dir, "part").withColumn("s", slots).select("p_partkey", F.array_join(F.transform(render.by_channel(F.col("s")), lambda s: s["label"]), ",").alias("ordered"))


@query("select p_partkey, array_to_string(list_sort([p_type, p_brand, p_name])[1:2], ', ') as shown from part")
def o7_first_items(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.first_items(F.array("p_type", "p_brand", "p_name"), 2).alias("shown"))


@query(f"{CATALOG}, {BODY}, {STACK} select column_rank, count(*) as n from st group by 1")
def u1_union_of_columns(rows):
    return learn.stacked_brands(rows).groupBy("column_rank").agg(F.count(F.lit(1)).alias("n"))


@query("select id, start, stop, label from (select l_orderkey as id, l_linenumber as start, l_linenumber + 1 as stop, l_returnflag as label from lineitem where l_quantity < 30 intersect select l_orderkey, l_linenumber, l_linenumber + 1, l_returnflag from lineitem where l_quantity > 10)")
def u5_span_intersection(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("stop"), F.col("l_returnflag").alias("label"), "l_quantity")
    return score.shared_spans(s.where("l_quantity < 30"), s.where("l_quantity > 10"))


@query("select s_suppkey, len(list_intersect(regexp_extract_all(lower(s_name), '[a-z0-9]+'), regexp_extract_all(lower(n_name || '-SUPPLIER ' || cast(s_suppkey % 40 as varchar)), '[a-z0-9]+'))) > 0 as shared from supplier join nation on s_nationkey = n_nationkey and n_nationkey % 2 = 0")
def u8_redundant_words(spark, sf_dir):
    both = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select("s_suppkey", render.shares_words(F.col("s_name"), F.concat("n_name", F.lit("-SUPPLIER "), (F.col("s_suppkey") % 40).cast("string"))).alias("shared"))


_ENDINGS = "case p_partkey % 6 when 0 then ' Type' when 1 then ' RATING' when 2 then '  level' when 3 then ' Grade Type' when 4 then 'Type' else '' end"


@query(f"select p_partkey, regexp_replace(p_type || {_ENDINGS}, '(?i)(\\S)\\s+(?:type|rating|level|style|option|class|grade)$', '\\1') as head from part")
def r7_label_head(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", render.label_head(F.concat("p_type", F.expr(_ENDINGS))).alias("head"))


@query(f"select p_partkey, case when p_partkey % 2 = 0 then cast(p_size as varchar) || 'IN' else upper(trim(regexp_replace({_contracted(chr(112) + '_name || ' + quoted(' Stainless Steel with ') + ' || p_type')}, '\\s{{2,}}', ' ', 'g'))) end as token from part")
def r8_invoice_token(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    slot = F.struct(F.when(even, F.col("p_size").cast("string")).otherwise(F.concat("p_name", F.lit(" Stainless Steel with "), "p_type")).alias("value"), F.when(even, "inches").otherwise("").alias("uom"))
    return read(spark, sf_dir, "part").withColumn("s", slot).select("p_partkey", render.invoice_token(F.col("s")).alias("token"))


@query("select p_partkey, 'Wh Lt ' || p_name as t from part")
def t33_contract_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", training.contract_words(F.concat(F.lit("White Light "), "p_name")).alias("t"))


@query(f"{CATALOG} select row_index, case when row_index % 2 = 0 then Part_Desc else Mfg_Part_Num || ' bolt' end as t from c")
def t33_add_mpn(rows):
    return rows.select("row_index", training.add_mpn(F.when(F.col("row_index") % 2 == 0, F.col("Part_Desc")).otherwise("bolt"), F.col("Mfg_Part_Num")).alias("t"))


@query()
def t31_augmented(rows):
    made = rows.select("row_index", F.col("Part_Desc").alias("text"), F.col("Mfg_Part_Num").alias("mpn"), F.lit("x").alias("label"), F.lit(0.9).alias("confidence"))
    return training.augmented(made)


@query("select p_partkey, (p_type = 'SMALL' or p_type = 'LARGE') and p_size between 5 and 40 as ok from part")
def m3_accept_proposal(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    named = propose.accepted(F.col("p_type"), F.lit(""), F.array(F.lit("SMALL"), F.lit("LARGE")), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(""))
    sized = propose.accepted(F.col("p_size").cast("string"), F.lit("inch"), F.array().cast("array<string>"), F.lit(5.0), F.lit(40.0), F.lit("length"))
    return part.select("p_partkey", (named & sized).alias("ok"))


@query("with s as (select l_orderkey, case when l_linenumber = 1 then '' else 'abc def' end as t, l_linenumber as a, l_linenumber + 1 as b, case when l_tax > 0.05 then 'X' else 'Y' end as label from lineitem), f as (select 'empty text' as fault from s where t = '' union all select 'unknown label' from s where label = 'Y' union all select 'offset out of range' from s where b > length(t) or a >= b union all select 'blank span' from s where not (b > length(t) or a >= b) and trim(substr(t, a + 1, b - a)) = '') select fault, count(*) as n from f group by 1")
def m10_span_faults(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "").otherwise("abc def").alias("text"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.when(F.col("l_tax") > 0.05, "X").otherwise("Y").alias("label"))
    return training.faults(s, spark.createDataFrame([("X",)], "label string"))


#: Slots of a part's text in SQL: label, value, start and end, in contract order.
SLOT_SQL = (
    "s as (select p_partkey as id, p_name || ' ' || p_size || ' inch ' || p_type as text, p_name, p_size, p_type from part), "
    "f as (select id, text, 0 as rank, 'FINISH' as label, split_part(p_name, ' ', 1) as value, 0 as a, strpos(p_name, ' ') - 1 as b from s "
    "union all select id, text, 1, 'PRODUCT_NAME', p_name, 0, length(p_name) from s where p_size % 3 = 0 "
    "union all select id, text, 2, 'SIZE', cast(p_size as varchar), length(p_name) + 1, length(p_name) + 1 + length(cast(p_size as varchar)) from s "
    "union all select id, text, 3, 'LETTER', 'letter', length(text) - 1, length(text) from s "
    "union all select id, text, 4, 'TYPE', p_type, length(text) - length(p_type), length(text) from s)"
)


@query(
    f"with {SLOT_SQL}, p as (select id, rank, label, value, strpos(text, substr(text, a + 1, b - a)) - 1 as a, b - a as len from f where b > a), "
    "l as (select id, list(struct_pack(a := a, b := a + len, r := rank, x := label, v := value) order by a, len desc, rank) as l from p group by id), "
    "k as (select id, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda kept, v: case when v[1].a >= kept[-1].b then list_concat(kept, v) else kept end)) as k from l) "
    'select id, cast(k.a as integer) as start, cast(k.b as integer) as "end", k.x as label, k.v as value from k'
)
def m6_span_examples(spark, sf_dir):
    """Spans of the parts' names, sizes and types; some readings share a beginning, and a letter's first place is elsewhere."""
    text, size, name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" inch "), "p_type"), F.col("p_size").cast("string"), F.length("p_name")
    slot = lambda label, value, a, b: F.struct(F.lit(label).alias("label"), value.alias("value"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    made = (
        slot("Finish", F.substring_index("p_name", " ", 1), F.lit(0), F.instr("p_name", " ") - 1), F.when(F.col("p_size") % 3 == 0, slot("Product Name", F.col("p_name"), F.lit(0), name)),
        slot("Size", size, name + 1, name + 1 + F.length(size)), slot("(letter)", F.lit("letter"), F.length(text) - 1, F.length(text)), slot("Type", F.col("p_type"), F.length(text) - F.length("p_type"), F.length(text)),
    )
    return training.span_examples(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), text.alias("text"), F.array_compact(F.array(*made)).alias("filled")))


@query(
    "with c as (select case when p_partkey % 5 = 0 then 'val' else 'train' end as split, case when p_partkey % 11 = 0 then ' ' else p_name end as text, p_brand as label, p_size, p_type from part), "
    "d as (select distinct label from c where p_size = 1), "
    "e as (select split, text, p_size % 15 - 1 as a, p_size % 15 + p_size % 3 as b, 'FINISH' as label from c union all select split, text, strpos(text, ' ') - 1, strpos(text, ' '), p_type from c), "
    "i as (select *, a >= 0 and a < b and b <= length(text) as ok from e), "
    "f as (select 'classes' as part, split, 'empty text' as fault, null as x from c where trim(text) = '' union all select 'classes', split, 'unknown label', label from c where label not in (select label from d) "
    "union all select 'spans', split, 'offset out of range', null from i where not ok union all select 'spans', split, 'unknown label', label from i where ok and label <> 'FINISH' "
    "union all select 'spans', split, 'blank span', null from i where ok and trim(substr(text, a + 1, b - a)) = '') "
    "select part, split, fault, count(*) as n, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(x))), 1, 5), ', '), '') as examples from f group by 1, 2, 3 "
    "union all select 'classes', 'all', 'text of both splits', count(*), '' from (select lower(text) from c group by 1 having count(distinct split) > 1) having count(*) > 0"
)
def m7_data_validation(spark, sf_dir):
    """A training set made of the parts, with brands that are not declared, blank names and spans that miss the text."""
    part, size = read(spark, sf_dir, "part"), F.col("p_size")
    rows = part.select(F.when(F.col("p_partkey") % 5 == 0, "val").otherwise("train").alias("split"), F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name")).alias("text"), F.col("p_brand").alias("label"), "p_size", "p_type")
    gap = F.instr("text", " ")
    span = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), label.alias("label"))
    spans = rows.select("split", "text", F.array(span(size % 15 - 1, size % 15 + size % 3, F.lit("FINISH")), span(gap - 1, gap, F.col("p_type"))).alias("entities"))
    return training.validation(rows.select("split", "text", "label"), spans, rows.where("p_size = 1").select("label"), spark.createDataFrame([("FINISH",)], "label string"))


# Evaluation and models


def _part_of(section: str, query_name: str, name: str, value: str = "n") -> str:
    return f"select '{section}' as section, {name} as name, cast({value} as bigint) as value from ({ORACLE_SQL[query_name]})"


@query(
    " union all ".join([
        *(_part_of("run", "a22_run_stats", f"'{c}'", c) for c in ("rows", "classified", "filled", "proposed")),
        _part_of("triage", "a23_triage", "bucket"),
        _part_of("sources", "a17_source_histogram", "source"),
        _part_of("blanks", "a18_blank_histogram", "source"),
    ])
)
def a30_evaluation(spark, sf_dir):
    cells = some_cells(spark, sf_dir)
    return score.payload(cells, score.verdicts(cells, some_checks(spark, sf_dir)))


@query(
    "with x as (select p_name as want, case p_partkey % 3 when 0 then upper(p_name) when 1 then p_name end as got, case when p_partkey % 5 > 0 then p_type else '' end as want2, p_type as got2 from part) "
    "select 'SHORT_DESC' as channel, count(*) as compared, cast(count_if(got = want) as bigint) as matched from x union all select 'MOBILE_DESC', count(*), cast(count_if(got2 = want2) as bigint) from x where want2 <> ''"
)
def a31_channel_check(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("Mfg_Part_Num", F.col("p_partkey").cast("string"))
    third = F.pmod("p_partkey", F.lit(3))
    got = part.select("Mfg_Part_Num", F.when(third == 0, F.upper("p_name")).when(third == 1, F.col("p_name")).alias("SHORT_DESC"), F.col("p_type").alias("MOBILE_DESC"))
    want = part.select("Mfg_Part_Num", F.col("p_name").alias("SHORT_DESC"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).otherwise("").alias("MOBILE_DESC"))
    return score.channel_check(got, want)


@query(
    "with k as (select doc_id, lang as label, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents), c as (select word, label, count(*) as n from k where doc_id % 5 <> 0 and label is not null group by 1, 2), "
    "v as (select count(distinct word) as v from c), t as (select label, sum(n) as total from c group by 1), r as (select lang as label, count(*) as r from documents where doc_id % 5 <> 0 and lang is not null group by 1), "
    "cl as (select label, ln(r::double / (select sum(r) from r)) as prior, ln(1.0::double / (coalesce(total, 0) + v)) as unseen from r left join t using (label) cross join v), "
    "q as (select doc_id, word, count(*) as tf from k where doc_id % 5 = 0 group by 1, 2), known as (select * from q where word in (select word from c)), sz as (select doc_id, sum(tf) as n from known group by 1), "
    "m as (select doc_id, c.label, sum(tf * ln(n + 1.0::double)) as more from known join c using (word) group by 1, 2), "
    "s as (select d.doc_id, cl.label, prior + coalesce(sz.n, 0) * unseen + coalesce(m.more, 0) as score from documents d cross join cl left join sz using (doc_id) left join m on m.doc_id = d.doc_id and m.label = cl.label where d.doc_id % 5 = 0) "
    "select doc_id as row_index, first(label order by score desc, label) as pred from s group by 1"
)
def m8_classify(spark, sf_dir):
    """The language of a fifth of the documents, told by the words of the others."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), "text", F.col("lang").alias("label"))
    held = F.col("row_index") % 5 == 0
    return models.classified(docs.where(held), models.train_classifier(docs.where(~held))).select("row_index", "pred")


@query(
    "with h as (select p_partkey as id, p_name, p_size, p_type from part where p_partkey % 4 = 0) select id, cast(0 as bigint) as pos, 'B-FINISH' as tag from h union all select id, 1, 'B-NOUN' from h "
    "union all select id, 2, 'B-SIZE' from h union all select id, 3, 'I-SIZE' from h union all select id, 4, 'O' from h"
)
def m8_tag_words(spark, sf_dir):
    """Names, sizes and types of a fourth of the parts, tagged after those of the others."""
    name = F.split("p_name", " ")
    words = (("B-FINISH", name[0]), ("B-NOUN", name[1]), ("B-SIZE", F.col("p_size").cast("string")), ("I-SIZE", F.lit("inch")), ("O", F.col("p_type")))
    tokens = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.array(*(F.struct(F.lit(t).alias("tag"), w.alias("word")) for t, w in words))).alias("pos", "x"))
    tokens = tokens.select("id", F.col("pos").cast("long").alias("pos"), "x.word", "x.tag")
    held = F.col("id") % 4 == 0
    return models.tagged(tokens.where(held).drop("tag"), models.train_tagger(tokens.where(~held)))


# Channels of a description


#: What the channels say of a part, in SQL: absent phrases are null.
CHANNELS = (
    "x as (select p_partkey, p_brand, p_size, 'PN' || lpad(cast(p_partkey as varchar), 6, '0') as mpn, split_part(p_name, ' ', 1) as finish, split_part(p_name, ' ', 2) as noun, "
    "case when p_size % 4 > 0 then p_type || ' Series' end as line, case when p_size % 5 > 0 then cast(p_size % 9 + 1 as varchar) || ' in Length' end as len, cast(p_size as varchar) || '-Hole' as holes, "
    "case when p_partkey % 2 = 0 then p_brand || ' Inc' else 'Supplies ' || p_type end as maker from part), "
    "y as (select *, concat_ws(', ', len, holes, finish) as title, list_filter([noun, line, mpn, len, holes, finish, 'Small Hardware', 'General Hardware Goods'], lambda c: c is not null) as l from x)"
)


def channelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts with a series, a count, a measure and a finish as slots, and the five channels made of them."""
    size = F.col("p_size")

    def slot(label, value, uom, style, kind, rank, title_rank, in_invoice=True):
        said = (F.lit(label), value, F.lit(uom), F.lit(style), F.lit(kind), F.lit(rank), F.lit(title_rank), F.lit(True), F.lit(in_invoice), F.lit(True))
        return F.struct(*said).cast(render.SLOT)

    slots = F.array(
        slot("Series", F.when(size % 4 > 0, F.col("p_type")).otherwise(""), "", "series", "series", 1, 0, False),
        slot("Number of Holes", size.cast("string"), "", "count_hyphen", "count", 2, 2),
        slot("Length", F.when(size % 5 > 0, (size % 9 + 1).cast("string")).otherwise(""), "in", "value_uom_label", "measure", 3, 1),
        slot("Finish", F.split("p_name", " ")[0], "", "value", "lov", 4, 0, False),
    )
    maker = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" Inc"))).otherwise(F.concat(F.lit("Supplies "), "p_type"))
    named = (F.split("p_name", " ")[1].alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_brand").alias("brand_plain"), maker.alias("manufacturer"), F.concat(F.lit("PN"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("mpn"))
    rest = (F.lit("").alias("series"), F.lit("").alias("with_phrase"), F.lit("Small Hardware").alias("leaf"), F.lit("General Hardware Goods").alias("klass"), slots.alias("slots"))
    part = read(spark, sf_dir, "part")
    return render.channels(catalogue.dealt(part, "p_partkey", part.count()).select("p_partkey", *named, *rest))


@query(f"with {CHANNELS} select p_partkey, concat_ws(' ', p_brand, line, mpn, noun) || ', ' || title as said from y")
def r12_short_desc(spark, sf_dir):
    return channelled(spark, sf_dir).select("p_partkey", F.col("SHORT_DESC").alias("said"))


@query(f"with {CHANNELS} select p_partkey, concat_ws(' ', p_brand, noun) || ', ' || concat_ws(', ', line, cast(p_size as varchar) || ' Holes', len, finish) as said from y")
def r13_long_desc(spark, sf_dir):
    return channelled(spark, sf_dir).select("p_partkey", F.col("LONG_DESC1").alias("said"))


@query(f"with {CHANNELS} select p_partkey, concat_ws(' ', line, noun) || ', ' || title as said from y")
def r14_retail_desc(spark, sf_dir):
    return channelled(spark, sf_dir).select("p_partkey", F.col("RETAIL_DESC").alias("said"))


_PACKED = "list_reduce(l, lambda a, c: case when length(a) >= 60 or length(a || ', ' || c) > 80 then a else a || ', ' || c end, {head})"


@query(
    f"with {CHANNELS}, z as (select *, {_PACKED.format(head='case when p_partkey % 2 = 0 then p_brand else concat_ws(chr(32), maker, p_brand) end')} as one, {_PACKED.format(head='concat_ws(chr(32), maker, p_brand)')} as two from y) "
    "select p_partkey, case when p_partkey % 2 = 0 and length(one) < 60 and length(two) > length(one) and length(two) <= 80 then two else one end as said from z"
)
def r15_mobile_desc(spark, sf_dir):
    return channelled(spark, sf_dir).select("p_partkey", F.col("MOBILE_DESC").alias("said"))


@query(f"with {CHANNELS} select p_partkey, concat_ws(' ', upper({_contracted('noun')}), case when p_size % 5 > 0 then cast(p_size % 9 + 1 as varchar) || 'IN' end, cast(p_size as varchar)) as said from y")
def r16_invoice_desc(spark, sf_dir):
    return channelled(spark, sf_dir).select("p_partkey", F.col("INVOICE_DESC").alias("said"))


@query(
    "with a as (select *, length('PN ' || p_name) <= 14 as u1 from part), b as (select *, case when u1 then 'PN ' || p_name else 'PN' end as t1 from a), c as (select *, length(t1 || ' ' || p_type) <= 14 as u2 from b), "
    "d as (select *, case when u2 then t1 || ' ' || p_type else t1 end as t2 from c), e as (select *, length(t2 || ' ' || p_brand) <= 14 as u3 from d), f as (select *, case when u3 then t2 || ' ' || p_brand else t2 end as t3 from e) "
    "select p_partkey, concat_ws(' | ', cast(u1::int + u2::int + u3::int as varchar) || ' of 3 candidates used', "
    "'dropped: ' || nullif(concat_ws('; ', case when not u1 then '''' || p_name || '''' end, case when not u2 then '''' || p_type || '''' end, case when not u3 then '''' || p_brand || '''' end), ''), case when length(t3) < 14 then 'window NOT satisfied' end) as said from f"
)
def r11_pack_audit(spark, sf_dir):
    packed = render.pack(F.lit("PN"), F.array("p_name", "p_type", "p_brand"), lo=14, hi=14, joiner=" ", required=3)
    return read(spark, sf_dir, "part").select("p_partkey", render.audit(packed, 14).alias("said"))


# Cells and the proposer


@query("select p_partkey, p_size % 3 = 0 and p_type in ('SMALL', 'LARGE') as on_purpose from part")
def p10_intentional_blank(spark, sf_dir):
    source = F.when(F.col("p_type") == "SMALL", "not_derivable").when(F.col("p_type") == "LARGE", "contract_template").otherwise("unresolved")
    return read(spark, sf_dir, "part").select("p_partkey", C.is_intentional_blank(source, F.when(F.col("p_size") % 3 > 0, F.col("p_name")).when(F.col("p_size") % 2 == 0, " ")).alias("on_purpose"))


@query("select p_partkey, p_name as value, 'Size' as header, greatest(0.0::double, least(1.0::double, (p_size - 10) / 32.0::double)) as confidence from part")
def p12_rescored(spark, sf_dir):
    made = C.rescored(C.cell("Size", F.col("p_name"), "regex_extract", "size", 0.92), (F.col("p_size") - 10) / F.lit(32.0))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("c")).select("p_partkey", "c.value", "c.header", "c.confidence")


@query(
    "select p_partkey, p_type as value, case when p_size % 4 > 0 then 'body' end as base, case when p_size % 4 > 0 then p_size % 3 else -1 end as start, case when p_size % 4 > 0 then p_size % 3 + p_size % 4 else -1 end as \"end\", "
    "case when p_size % 4 > 0 then substr(p_name, p_size % 3 + 1, p_size % 4) end as snippet from part"
)
def e15_evidence(spark, sf_dir):
    start = F.col("p_size") % 3
    made = C.cell("Type", F.col("p_type"), "regex_extract", "r", 0.9, None, C.evidence("body", F.col("p_name"), start, start + F.col("p_size") % 4))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("c")).select("p_partkey", "c.value", "c.evidence.base", F.coalesce("c.evidence.start", F.lit(-1)).alias("start"), F.coalesce("c.evidence.end", F.lit(-1)).alias("end"), "c.evidence.snippet")


@query(
    "with q as (select p_partkey as row_index, '{\"blanks\":[' || case when p_size % 3 = 1 then '\"Colour\"' else '\"Colour\",\"Size\"' end || '],\"description\":\"' || p_name || '\",\"classpath\":\"Parts > ' || p_type || '\"}' as request from part where p_size % 3 > 0) "
    "select row_index, request, sha256(request) as key from q"
)
def t29_requests(spark, sf_dir):
    blanks = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("Colour"))).otherwise(F.array(F.lit("Size"), F.lit("Colour")))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("body"), F.concat(F.lit("Parts > "), "p_type").alias("classpath"), blanks.alias("blanks"))
    return propose.requests(rows).select("row_index", "request", "key")


@query("select cast(count_if(p_size % 4 = 0) + count_if(p_type = 'SMALL') as bigint) as accepted, cast(count_if(p_type = 'LARGE') as bigint) as rejected_not_in_lov, cast(count_if(p_size % 4 = 1) as bigint) as rejected_out_of_bounds, cast(count_if(p_size > 25) as bigint) as marketing from part")
def a34_proposer_stats(spark, sf_dir):
    one = lambda outcome: F.when(outcome.isNotNull(), F.struct(F.lit("x").alias("label"), outcome.alias("outcome")))
    size = F.when(F.col("p_size") % 4 == 0, "accepted").when(F.col("p_size") % 4 == 1, "out of bounds")
    kind = F.when(F.col("p_type") == "SMALL", "accepted").when(F.col("p_type") == "LARGE", "not in list")
    rows = read(spark, sf_dir, "part").select(F.array_compact(F.array(one(size), one(kind))).alias("outcomes"), F.when(F.col("p_size") > 25, "words").otherwise("").alias("marketing"))
    return propose.stats(rows)


# Files: what a source reads of what a sink wrote


def _ordered(rows: DataFrame, key: str = "row_index") -> DataFrame:
    """Rows dealt by ranges of the key and sorted, so that part files follow each other in its order."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


_NUMBERED = f"{CATALOG} select row_number() over (order by row_index) - 1 as row_index"
_AS_IS = ", ".join(fixed.PASSTHROUGH)


@query(f"{_NUMBERED}, Mfg_Part_Num, Part_Desc, case when row_index % 3 = 0 then '' else E1_Brand end as E1_Brand, Part_Manuf from c")
def s1_csv_scan(rows):
    """Quotes in quotes, absent values, padded names of columns, several files."""
    path = folder(rows.sparkSession, "s1")
    padded = [F.col("Mfg_Part_Num").alias(" Mfg_Part_Num"), F.col("Part_Desc").alias("Part_Desc "), F.when(F.col("row_index") % 3 > 0, F.col("E1_Brand")).alias("E1_Brand"), F.col("Part_Manuf")]
    _ordered(rows).select(*padded).write.option("header", True).option("escape", '"').csv(path)
    return catalogue.read_csv(rows.sparkSession, path)


@query(f"{_NUMBERED}, Mfg_Part_Num, Part_Desc, Part_Manuf from c")
def s4_gold_scan(rows):
    """Values with blanks around them."""
    path = folder(rows.sparkSession, "s4")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "header": True, "escape": '"'}
    _ordered(rows).select(*(F.concat(F.lit("  "), c, F.lit(" ")).alias(c) for c in ("Mfg_Part_Num", "Part_Desc", "Part_Manuf"))).write.options(**kept).csv(path)
    return catalogue.read_gold(rows.sparkSession, path)


@query(f"{_NUMBERED}, {_AS_IS} from c")
def s2_workbook_scan(rows):
    """A folder of workbooks, read back as one table."""
    path = folder(rows.sparkSession, "s2")
    sheets.write(rows, list(fixed.PASSTHROUGH), path, sheet_rows=5_000)
    return sheets.read(rows.sparkSession, path)


@query(f"{_NUMBERED}, {_AS_IS} from c")
def k1_delivery_csv(rows):
    path = folder(rows.sparkSession, "k1")
    sinks.write_delivery_csv(C.passthrough(rows), list(fixed.PASSTHROUGH), path)
    return catalogue.read_csv(rows.sparkSession, path)


@query(f"with {CELLS}, {QUALITY}, {VERDICT}, n as (select row_index, count(*) as n, count_if(value <> '') as filled from cells where value <> '' or source <> 'unresolved' group by 1) select row_index, confidence, cast(n as bigint) as n, cast(filled as bigint) as filled from n join v using (row_index)")
def k3_provenance_lines(spark, sf_dir):
    path, cells = folder(spark, "k3"), some_cells(spark, sf_dir)
    sinks.write_provenance(cells, score.verdicts(cells, some_checks(spark, sf_dir)), path)
    kept = "row_index long, confidence double, cells array<struct<header:string,value:string,source:string>>"
    lines = catalogue.read_jsonl(spark, path, kept)
    return lines.select("row_index", "confidence", F.size("cells").cast("long").alias("n"), F.size(F.filter("cells", lambda c: c["value"] != "")).cast("long").alias("filled"))


@query(
    "with l as (select event_id // 5000 as file, event_id % 89 as k, event_id, row_number() over (partition by event_id // 5000 order by event_id) as line from events) "
    "select cast(file as bigint) as file, line, case when k = 3 then 'event ' || event_id else '{\"n\":\"' || event_id || 'x\"}' end as text from l where k in (3, 4)"
)
def s8_line_faults(spark, sf_dir):
    """Events as JSON lines, 5,000 a file, with blank lines, lines that are no JSON and numbers that are none."""
    path, n, k = folder(spark, "s8"), F.col("event_id").cast("string"), F.col("event_id") % 89
    line = F.when(k == 2, "").when(k == 3, F.concat(F.lit("event "), n)).when(k == 4, F.concat(F.lit('{"n":"'), n, F.lit('x"}'))).otherwise(F.concat(F.lit('{"n":'), n, F.lit("}")))
    events = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5000).alias("bucket"), "event_id", line.alias("value"))
    events.repartitionByRange("bucket").sortWithinPartitions("bucket", "event_id").drop("event_id").write.partitionBy("bucket").text(path)
    return catalogue.jsonl_faults(spark, path, "n long").select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("file"), "line", "text")


@query("select case when p_size % 8 = 0 then 'val' else 'train' end as split, p_name as text, p_type as label from part")
def k10_training_splits(spark, sf_dir):
    path = folder(spark, "k10")
    sinks.write_splits(read(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("label"), F.when(F.col("p_size") % 8 == 0, "val").otherwise("train").alias("split")), path)
    return spark.read.schema("text string, label string, split string").json(path).select("split", "text", "label")


@query("select p_partkey as row_index, (p_partkey % 128) / 128.0::double as confidence, 'PN' || p_partkey as \"Mfg_Part_Num\", length(p_name) as invoice_chars, length(p_type) as mobile_chars, p_type || ' | ' || p_brand as review_reasons from part where p_size % 3 = 0 and p_partkey % 16 = 0")
def k5_review_file(spark, sf_dir):
    """The queue as a file; confidences are sixteenths of a half, which three decimals state to the digit."""
    path, part = folder(spark, "k5"), read(spark, sf_dir, "part")
    said = {"Part_Desc": "p_name", "BRAND_NAME": "p_brand", "MANUFACTURER_NAME": "p_brand", "Classpath": "p_type", "SHORT_DESC": "p_name", "INVOICE_DESC": "p_name", "MOBILE_DESC": "p_type"}
    rows = part.select(F.col("p_partkey").alias("row_index"), ((F.col("p_partkey") % 128) / F.lit(128.0)).alias("confidence"), ((F.col("p_size") % 3 == 0) & (F.col("p_partkey") % 16 == 0)).alias("needs_review"), F.concat(F.lit("PN"), F.col("p_partkey").cast("string")).alias("Mfg_Part_Num"), *(F.col(c).alias(h) for h, c in said.items()), F.array("p_type", "p_brand").alias("reasons"))
    sinks.write_review_queue(rows, path)
    queue = spark.read.option("header", True).csv(path)
    return queue.select(F.col("row_index").cast("long"), F.col("confidence").cast("double"), "Mfg_Part_Num", F.col("invoice_chars").cast("long"), F.col("mobile_chars").cast("long"), "review_reasons")


@query(
    f"{CATALOG}, {BODY}, s as (select p_name as name, count(*) as n from part group by 1 union all select split_part(p_name, ' ', 2), count(*) from part group by 1) "
    "select row_index, string_agg(name, '|' order by length(name) desc, n desc, name) as names from b join s on contains(' ' || body || ' ', ' ' || name || ' ') group by 1"
)
def e11_series_names(spark, sf_dir):
    """Names of two words and the one that each ends in, as an induced vocabulary; a row's own, the longest first."""
    part = read(spark, sf_dir, "part")
    series = part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(part.groupBy(F.split("p_name", " ")[1].alias("name")).agg(F.count(F.lit(1)).alias("n")))
    told = extract.own_names(bodies(catalogue.bridge(spark, sf_dir)), series)
    return told.where("names is not null").select("row_index", F.array_join("names", "|").alias("names"))


# Dimensions by contract and number of parts; the vocabulary as a document


DIMENSIONS = Rules(
    (),
    {"generic": tuple(Slot(x, "dimension") for x in ("Width", "Length", "Height", "Size")), "turned": tuple(Slot(x, "dimension") for x in ("Height", "Length", "Width", "Size"))},
    {"generic": {2: ("Width", "Length")}, "turned": {2: ("Length", "Width"), 3: ("Height", "Width", "Length")}},
)


@query(
    "with x as (select p_partkey, p_partkey % 3 = 0 as turned, length(p_name) + 1 as a, cast(p_size as varchar) as one, cast(2 * (p_partkey % 4) + 1 as varchar) || '/8' as two, case when p_size % 2 = 1 then cast(p_size % 7 + 1 as varchar) end as three from part), "
    "y as (select *, a + length(one) + length(two) + 3 + coalesce(length(three) + 2, 0) as b from x), "
    "f as (select *, 'Size' as label, one || ' in x ' || two || ' in' || coalesce(' x ' || three || ' in', '') as value, '' as uom from y "
    "union all select *, case when not turned then 'Width' when three is null then 'Length' else 'Height' end, one, 'in' from y "
    "union all select *, case when turned then 'Width' else 'Length' end, two, 'in' from y "
    "union all select *, 'Length', three, 'in' from y where turned and three is not null) "
    'select p_partkey, label, value, uom, cast(a as integer) as start, cast(b as integer) as "end" from f'
)
def e13_dimensions(spark, sf_dir):
    """Two or three measures in a row, told apart by what the contract, or else the generic one, says of so many; a contract
    that does not say it for three names as many as its longest order has."""
    size = F.col("p_size")
    run = F.concat(size.cast("string"), F.lit('"x'), (2 * (F.col("p_partkey") % 4) + 1).cast("string"), F.lit('/8"'), F.when(size % 2 == 1, F.concat(F.lit("x"), (size % 7 + 1).cast("string"), F.lit('"'))).otherwise(""))
    contract = F.when(F.col("p_partkey") % 3 == 0, "turned").when(F.col("p_partkey") % 3 == 1, "generic").otherwise("unknown")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", run, "p_type").alias("body"), contract.alias("contract"))
    return extract.extract(rows, DIMENSIONS).select("p_partkey", F.explode("filled").alias("f")).select("p_partkey", "f.label", "f.value", "f.uom", F.col("f.start").cast("int").alias("start"), F.col("f.end").cast("int").alias("end"))


#: The vocabulary's document over the tables, in SQL: sections of each of its kinds of entries.
_ENTRIES = (
    "with s as (select 'alias_index' as section, lower(s_name) as name, s_name as value, s_suppkey as ord from supplier union all select 'series', p_name, cast(count(*) as varchar), min(p_partkey) from part group by 2 "
    "union all select 'groups', s_name || ' (' || s_suppkey || ')', s_name || '/' || s_suppkey, s_suppkey from supplier union all select 'value_vocab', p_type || ':' || p_brand, cast(count(*) as varchar), 0 from part group by p_type, p_brand) "
)


@query(_ENTRIES + "select section, name, value, case when section = 'value_vocab' then -1 else row_number() over (partition by section order by ord) - 1 end as place from s")
def k8_vocabulary_document(spark, sf_dir):
    """Names, counts, structs and objects of counts, written as one document and read again with the places of entries."""
    path, part, suppliers = folder(spark, "k8"), read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    n, key = F.count(F.lit(1)).alias("n"), F.col("s_suppkey").cast("string")
    tables = {
        "alias_index": suppliers.select(F.col("s_suppkey").alias("ord"), F.lower("s_name").alias("alias"), F.col("s_name").alias("canonical")),
        "series": part.groupBy(F.col("p_name").alias("name")).agg(n, F.min("p_partkey").alias("ord")),
        "groups": suppliers.select(F.col("s_suppkey").alias("ord"), F.concat("s_name", F.lit(" ("), key, F.lit(")")).alias("grp"), F.col("s_name").alias("name"), key.alias("code")),
        "value_vocab": part.groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("value")).agg(n, F.min("p_partkey").alias("ord")),
    }
    vocabulary.write_vocabulary(tables, path)
    back = vocabulary.read_vocabulary(spark, path)
    row = lambda section, name, value, place: back[section].select(F.lit(section).alias("section"), name.alias("name"), value.alias("value"), place.cast("long").alias("place"))
    at = F.col("ord")
    return (
        row("alias_index", F.col("alias"), F.col("canonical"), at)
        .unionByName(row("series", F.col("name"), F.col("n").cast("string"), at))
        .unionByName(row("groups", F.col("grp"), F.concat_ws("/", "name", "code"), at))
        .unionByName(row("value_vocab", F.concat_ws(":", "kind", "value"), F.col("n").cast("string"), F.lit(-1)))
    )
