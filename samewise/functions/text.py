"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from . import lexicon as lx

NAME_CAP, DETAILS_CAP, FIELD_CAP = 500, 2000, 120


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each computed once.

    The condition always holds, but as it is not deterministic the optimiser copies no
    column into the filters and projections above, where each use would be computed anew.
    """
    return df.select("*", *(F.when(F.monotonically_increasing_id() >= 0, c).alias(k) for k, c in columns.items()))


_UNIFIED = str.maketrans(lx.UNIFIED_FROM, lx.UNIFIED_TO)
_DECORATION = re.compile(lx.DECORATION)
_PHRASE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(lx.PHRASES, key=len, reverse=True))) + r")(?!\w)")
_LETTER_V = re.compile(rf"{lx.LETTER_V}(?=\d)")


def _unified(text: str) -> str:
    """Compatibility form, one kind of dash, quote, digit and Arabic letter; Arabic spellings of Latin names rewritten."""
    plain = _DECORATION.sub("", unicodedata.normalize("NFKC", text).translate(_UNIFIED))
    plain = _PHRASE.sub(lambda m: lx.PHRASES[m[0]], " ".join(plain.split()))
    return _LETTER_V.sub("v", plain)


@pandas_udf(StringType())
def unified(values: pd.Series) -> pd.Series:
    """Spark has no compatibility form, and so many replacements would each be an expression; nulls pass through."""
    return values.map(lambda v: None if v is None else _unified(v))


def lookup(words: dict) -> Column:
    """A constant map column."""
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


def squeeze(c: Column) -> Column:
    """White space of any script as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """Null, empty or only white space of any script."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def clean(c: Column, cap: int = NAME_CAP, ascii_only: bool = False) -> Column:
    """The first cap characters with dashes, quotes, digits and Arabic letters unified and Arabic spellings of Latin names rewritten.

    None of these steps changes ASCII text, so rows of it skip them.
    """
    s = F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, cap)
    if ascii_only:
        return squeeze(s)
    wide = F.octet_length(s) != F.char_length(s)
    return F.when(wide, unified(F.when(wide, s))).otherwise(squeeze(s))


def fold(c: Column) -> Column:
    """Lower case for comparing; ß counts as ss."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def tidy(c: Column) -> Column:
    """Abbreviations written out; only letters, digits and dots inside numbers stay."""
    longest = sorted(lx.ABBREVIATIONS, key=len, reverse=True)
    whole = c
    for short in longest:
        whole = F.regexp_replace(whole, rf"(?<![a-z0-9]){short}(?![a-z0-9])", lx.ABBREVIATIONS[short])
    c = F.when(c.rlike(rf"(?<![a-z0-9])(?:{'|'.join(longest)})(?![a-z0-9])"), whole).otherwise(c)
    c = F.regexp_replace(c, r"(?U)[^\w.]+|_", " ")
    return squeeze(F.regexp_replace(c, r"(?U)(?<!\d)\.|\.(?!\d)", " "))


def normalise_text(c: Column, cap: int = NAME_CAP, ascii_only: bool = False) -> Column:
    return tidy(fold(clean(c, cap, ascii_only)))


def script_of(c: Column) -> Column:
    """arabic or latin if one has more than twice the letters of the other, else mixed."""
    text = F.coalesce(c, F.lit(""))
    arabic, latin = F.regexp_count(text, F.lit("[ء-ي]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when((arabic > 0) & (arabic > latin * 2), "arabic").when((latin >= arabic * 2) & ((arabic == 0) | (latin > arabic * 2)), "latin").otherwise("mixed")


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def found(tokens: Column, table: dict[str, str]) -> Column:
    """The values of the tokens that the table knows, sorted and distinct."""
    known = lookup(table)
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda w: F.try_element_at(known, w)), lambda v: v.isNotNull())))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of the text without spaces between # marks."""
    whole = F.concat(F.lit("#"), F.replace(c, F.lit(" "), F.lit("")), F.lit("#"))
    return let(whole, lambda s: F.when(F.char_length(s) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(s) - 2), lambda i: F.substr(s, i, F.lit(3))))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def name_similarity(tokens_a: Column, trigrams_a: Column, tokens_b: Column, trigrams_b: Column) -> Column:
    """Mean likeness of words and trigrams, to three places (half to even)."""
    return F.bround(jaccard(tokens_a, tokens_b) * 0.5 + jaccard(trigrams_a, trigrams_b) * 0.5, 3)


def same_part(a: Column, b: Column) -> Column:
    """Equal part numbers, or equal without one or two letters before at least three digits; false for nulls."""
    bare = lambda p: F.regexp_replace(p, r"^[a-z]{1,2}(?=\d)", "")
    return F.coalesce((a == b) | ((bare(a) == bare(b)) & (F.regexp_count(bare(a), F.lit(r"\d")) >= 3)), F.lit(False)) & F.coalesce((a != "") & (b != ""), F.lit(False))


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula, behind an apostrophe; plain numbers stay."""
    return let(F.coalesce(c.cast("string"), F.lit("")), lambda s: F.when(s.rlike(r"^[=+\-@\t\r]") & ~s.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?\z"), F.concat(F.lit("'"), s)).otherwise(s))
