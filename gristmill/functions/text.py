"""Text rules of catalogue rows as column functions; only Unicode compatibility folding leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: Typographic quotes, primes and dashes, and what stands for them.
_QUOTES_FROM = "“”″′‘’´—–\u00a0"
_QUOTES_TO = "\"\"\"''''-- "
TOKEN = r"[A-Za-z][A-Za-z'\-]*|\d[\d./\-]*|[\"'#]"
_KEPT = "®™©℠″′"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_ends(text: Column, marks: str = r"\s\-,;:") -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{marks}]+$", ""), f"^[{marks}]+", "")


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    import unicodedata

    def fold(s):
        if s is None or s.isascii():
            return s
        return "".join(p if p in _KEPT else unicodedata.normalize("NFKC", p) for p in re.split(f"([{_KEPT}])", s))

    return values.map(fold, na_action="ignore")


def clean(text: Column, *, fold: bool = False) -> Column:
    """Quotes, dashes and white space in one form, without separators at the ends; null is ''.

    `fold` also applies NFKC (marks and primes excepted) in an Arrow function, for text that is not ASCII."""
    out = F.coalesce(text, F.lit(""))
    out = F.translate(_nfkc(out) if fold else out, _QUOTES_FROM, _QUOTES_TO)
    return strip_ends(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def is_placeholder(value: Column) -> Column:
    """Whether a field is missing or holds no information."""

    def empty(text: Column) -> Column:
        bare = F.trim(F.btrim(text, F.lit("-")))
        return (
            (text == "")
            | text.rlike(r"^\s*--+\s*[^-].*?\s*--+\s*$")
            | F.lower(text).isin(*fixed.PLACEHOLDERS)
            | F.lower(bare).isin(*fixed.PLACEHOLDERS)
            | bare.rlike(r"(?i)^\s*no\s+[\w\s]{0,24}\bbrands?\s*$")
            | ~text.rlike(r"[\p{L}\p{N}]")
        )

    return let(F.trim(F.coalesce(value, F.lit(""))), empty)


NOISE = r"(?i)[\s\-,(]*\b(?:" + "|".join(fixed.NOISE) + r")\b[\s)]*"


def noise_markers(text: Column) -> Column:
    """The listing marks in a text, as an array."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(NOISE), F.lit(0)), lambda x: F.btrim(x, F.lit(" -,()"))), lambda x: x != "")


def strip_noise(text: Column) -> Column:
    return let(text, lambda t: F.when(F.size(noise_markers(t)) > 0, clean(F.regexp_replace(t, NOISE, " "))).otherwise(t))


def strip_leading_mpn(text: Column, mpn: Column) -> Column:
    """Without the part number at its head, where something else is left."""

    def cut(t: Column) -> Column:
        body = F.trim(t)
        rest = F.ltrim(F.substring(body, F.length(mpn) + 1, F.length(body)), F.lit(" -,:"))
        found = (F.coalesce(mpn, F.lit("")) != "") & F.startswith(F.upper(body), F.upper(mpn)) & (rest != "")
        return F.when(found, rest).otherwise(t)

    return let(text, cut)


def body_of(desc: Column, mpn: Column) -> Column:
    """A description without its part number and listing marks."""
    return strip_noise(strip_leading_mpn(clean(desc), mpn))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(0))


def lexicon(entries: dict[str, str]) -> Column:
    """A map literal. Two joined strings that fold to one constant keep plans small: a literal an entry would not."""
    keys, values = (F.split(F.lit("\x1f".join(x)), "\x1f", -1) for x in zip(*entries.items()))
    return F.map_from_arrays(keys, values)


def expand_token(token: Column) -> Column:
    return F.element_at(lexicon(fixed.EXPANSIONS), F.lower(F.btrim(F.trim(token), F.lit("."))))


def expand(text: Column, skip: Column | None = None) -> Column:
    """Every shorthand token in full; tokens in the array `skip` (lower case) stay."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})|."), F.lit(0))
    words = lexicon({k: v for k, v in fixed.EXPANSIONS.items() if v.lower() != k})

    def one(p: Column) -> Column:
        full = F.element_at(words, F.lower(p))
        return F.coalesce(full if skip is None else F.when(~F.array_contains(skip, F.lower(p)), full), p)

    return clean(F.array_join(F.transform(parts, one), ""))


def contract_for_invoice(text: Column) -> Column:
    """Abbreviated for the invoice line: longest phrases first, each seeing what the earlier ones left."""
    phrases = sorted(fixed.INVOICE, key=len, reverse=True)
    known = r"(?i)\b(?:" + "|".join(map(re.escape, phrases)) + r")\b"
    shorter = lambda t: reduce(lambda acc, p: F.regexp_replace(acc, rf"(?i)\b{re.escape(p)}\b", fixed.INVOICE[p]), phrases, t)
    out = let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(known), shorter(t)).otherwise(t))
    return F.upper(F.trim(F.regexp_replace(out, r"\s{2,}", " ")))


def title_case(text: Column) -> Column:
    """Title case that keeps acronyms, model numbers and the inside of words."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    lift = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))

    def one(w: Column, i: Column) -> Column:
        bare = F.btrim(w, F.lit(".,;:()"))
        return (
            F.when(F.upper(bare).isin(*fixed.UPPER_WORDS), F.replace(w, bare, F.upper(bare)))
            .when((i > 0) & F.lower(bare).isin(*fixed.LOWER_WORDS), F.lower(w))
            .when((bare == F.upper(bare)) & bare.rlike("[A-Za-z]") & (F.length(bare) > 1) & bare.rlike("[0-9]"), w)
            .when(F.contains(bare, F.lit("-")), F.array_join(F.transform(F.split(w, "-"), lift), "-"))
            .otherwise(lift(w))
        )

    return F.array_join(F.transform(words, one), " ")


_ACCOUNT = r"^(.*?)\s*\(([A-Z0-9]{3,8})\)\s*$"


def account_name(raw: Column) -> Column:
    """The name in `Name (CODE)`; '' for placeholders."""
    name = lambda t: F.when(t.rlike(_ACCOUNT), clean(F.regexp_extract(t, _ACCOUNT, 1))).otherwise(t)
    return let(clean(raw), lambda t: F.when(is_placeholder(t), "").otherwise(name(t)))


def account_code(raw: Column) -> Column:
    return let(clean(raw), lambda t: F.when(is_placeholder(t), "").otherwise(F.regexp_extract(t, _ACCOUNT, 2)))


def group_key(raw: Column) -> Column:
    return let(clean(raw), lambda t: F.when(is_placeholder(t), "<ungrouped>").otherwise(t))


def account_head(name: Column) -> Column:
    """What may be a brand in an account name: up to a slash, without company words at the end, one word at least."""
    text = F.trim(F.element_at(F.split(clean(name), "/"), 1))
    suffix = "|".join(re.escape(w) for w in fixed.ACCOUNT_SUFFIXES)
    return F.btrim(F.regexp_replace(text, rf"(?i)(?:\s+[.,]*(?:{suffix})[.,]*)+$", ""), F.lit(" .,&-"))


def length_status(value: Column) -> Column:
    """How a text's length suits the channels: empty, short (an invoice line), window (a mobile title) or other."""
    n = F.length(value)
    return F.when(n == 0, "empty").when(n <= fixed.INVOICE_MAX, "short").when(n.between(fixed.MOBILE_MIN, fixed.MOBILE_MAX), "window").otherwise("other")


def strip_marks(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[®™©]", ""))


def decorate(brand: Column, attested: Column) -> Column:
    """With the registered mark where the brand is attested and known to carry it."""
    marked = lambda plain: (
        F.when(plain == "", "")
        .when(brand.rlike("[®™©]"), F.trim(brand))
        .when(attested & F.lower(plain).isin(*fixed.REGISTERED), F.concat(plain, F.lit("®")))
        .otherwise(plain)
    )
    return let(strip_marks(brand), marked)


def phrase_pattern(phrase: str) -> str:
    """A pattern for a phrase as whole words: spaces and hyphens are alike or absent, plurals count."""
    parts = [re.escape(p) for p in re.split(r"[\s\-]+", phrase.strip()) if p]
    return r"(?i)(?<![A-Za-z0-9])" + r"[\s\-]*".join(parts) + r"(?:e?s)?(?![A-Za-z0-9])"


def prepare_text(desc: Column, mpn: Column) -> Column:
    """The whole description, its body and the body expanded, those that differ, for the matchers."""

    def joined(full: Column, body: Column, expanded: Column) -> Column:
        keep_body = (body != "") & (F.lower(body) != F.lower(full))
        keep_expanded = (expanded != "") & (F.lower(expanded) != F.lower(full)) & (~keep_body | (F.lower(expanded) != F.lower(body)))
        return F.concat_ws(" | ", full, F.when(keep_body, body), F.when(keep_expanded, expanded))

    return let(clean(desc), lambda full: let(strip_noise(strip_leading_mpn(full, mpn)), lambda body: let(expand(body), lambda expanded: joined(full, body, expanded))))


def fallback_name(body: Column) -> Column:
    """The last three words in full, for rows without a category."""
    words = F.filter(F.regexp_extract_all(body, F.lit(r"([A-Za-z][A-Za-z'\-]*)"), F.lit(0)), lambda w: F.length(w) > 1)
    return title_case(expand(F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " ")))


def asset_stem(brand: Column, mpn: Column) -> Column:
    b = F.regexp_replace(strip_marks(brand), r"(?U)[^\w]+", "")
    m = F.trim(F.regexp_replace(F.coalesce(mpn, F.lit("")), r"(?U)[^\w.-]+", ""))
    return F.when((b != "") & (m != ""), F.concat_ws("_", b, m)).otherwise(F.concat(b, m))


def asset_names(brand: Column, mpn: Column, alternates: int = 4) -> Column:
    """Map of asset columns to file names; null without a stem."""
    stem = asset_stem(brand, mpn)
    names = [F.lit("Product Image"), F.concat(stem, F.lit(".jpg")), F.lit("Specification Sheet"), F.concat(stem, F.lit("_Specification_Sheet.pdf"))]
    for n in range(1, alternates + 1):
        names += [F.lit(f"Alternate Image {n}"), F.concat(stem, F.lit(f"_{n}.jpg"))]
    return F.when(stem != "", F.create_map(*names))


def approvals(text: Column, order: str = "binary") -> Column:
    """Certification marks that the text shows, joined by '|': in binary order, or ignoring case for order='gold'."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike("(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(c) for c in cues.split("|")) + ")(?![A-Za-z0-9])"), mark) for mark, cues in fixed.APPROVALS.items())))
    if order == "gold":
        found = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s["v"])
        return F.array_join(found, "|")
    return F.array_join(F.array_sort(found), "|")


def normalised(value: Column) -> Column:
    """For comparing values: white space in one form, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))


def is_subsequence(needle: str, haystack: Column) -> Column:
    return haystack.rlike(".*".join(re.escape(c) for c in needle))


def first_json(text: Column) -> Column:
    """The first JSON object in a reply, with code fences removed; null where there is none."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def bio_tags(labels: Column) -> Column:
    return F.concat(F.array(F.lit("O")), F.flatten(F.transform(labels, lambda x: F.array(F.concat(F.lit("B-"), x), F.concat(F.lit("I-"), x)))))


def url_of(brand: Column, mpn: Column) -> Column:
    """The product address by the brand's pattern, or by its first word's; null where none is known."""
    key = F.lower(strip_marks(brand))
    known = lexicon(fixed.URL_TEMPLATES)
    template = F.coalesce(F.element_at(known, key), F.element_at(known, F.element_at(F.split(key, " "), 1)))
    return F.when(F.coalesce(mpn, F.lit("")) != "", F.replace(template, F.lit("{mpn}"), mpn))
