"""Column functions on text: cleaning, keys, tokens."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

#: Letters and digits as Python's ``\w`` has them, in Java's and RE2's terms.
WORD = r"\p{L}\p{N}_"
INVISIBLE = "[​-‏‪-‮⁠-⁯﻿­]"
PINCODE = "^[1-9][0-9]{5}$"


def any_of(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mapping(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def squeeze(c: Column) -> Column:
    """White space trimmed and collapsed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_like(c: Column, values: Iterable[str] = words.NULL_LIKE) -> Column:
    """Null where the trimmed value is one of those that stand for none."""
    return F.when(~F.lower(F.trim(c)).isin(*values), c)


def strip_invisible(c: Column) -> Column:
    """Invisible characters and repeated commas removed; blank is null."""
    return blank_to_null(squeeze(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), ",{2,}", ",")))


def nfkc(c: Column) -> Column:
    """Unicode NFKC without invisible characters; only values with other than ASCII are sent to Python."""
    convert = F.pandas_udf(lambda s: s.str.normalize("NFKC"), "string")
    normal = F.coalesce(convert(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    return blank_to_null(F.trim(F.regexp_replace(normal, INVISIBLE, "")))


def plain_symbols(c: Column) -> Column:
    """Dashes and unusual symbols become spaces; blank is null."""
    dashes = F.regexp_replace(c, r"\s*[-–—]\s*", " ")
    return blank_to_null(squeeze(F.regexp_replace(dashes, rf"[^{WORD}\s,./#&'-]", " ")))


def expand_abbreviations(c: Column, values: Mapping[str, str] = words.ADDRESS_ABBREVIATIONS) -> Column:
    """Whole words that are abbreviations, whatever their case, written out."""
    parts = F.regexp_extract_all(c, F.lit(rf"([{WORD}]+|[^{WORD}]+)"), F.lit(1))
    table = mapping(values)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(table, F.lower(p)), p)), "")


def title_words(c: Column) -> Column:
    """First letter of each word upper, the rest lower."""
    return F.initcap(squeeze(c))


def title(c: Column) -> Column:
    """As ``title_words``, but a letter after any other character begins a word as well (``3rd`` -> ``3Rd``)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def pincode(c: Column) -> Column:
    """The valid pincode before the first full stop, else null."""
    value = F.substring_index(F.trim(c), ".", 1)
    return F.when(value.rlike(PINCODE), value)


def coordinate(c: Column, bound: float) -> Column:
    """The trimmed value if it is a number within +-bound, else null."""
    value = F.trim(c)
    number = F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))
    return F.when(number.between(-bound, bound), value)


def plain_number(c: Column) -> Column:
    """A number's text without exponent, digit by digit: ``7.0E-4`` to ``0.0007``; other texts as they are."""
    written = F.regexp_replace(c.try_cast("decimal(38,25)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(c.rlike(r"^-?\d+\.\d+E-?\d+$"), F.coalesce(written, c)).otherwise(c)


def nullable_string(c: Column) -> Column:
    """A source cell: trimmed, collapsed, null-like to null, ``123.0`` to ``123``."""
    value = squeeze(c)
    return F.when(~F.lower(value).isin(*words.NULL_LIKE_SOURCE), F.regexp_replace(value, r"^(\d+)\.0$", "$1"))


def dedup_key(c: Column) -> Column:
    """Lower case, punctuation to spaces, collapsed."""
    return squeeze(F.regexp_replace(F.lower(F.trim(c)), rf"[^{WORD}\s]", " "))


def column_key(c: Column) -> Column:
    """A header cell as it is compared: ``Sl. No.*`` -> ``sl no``."""
    bare = F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("*"), F.lit("")), r"\([^)]*\)", "")
    return squeeze(F.regexp_replace(bare, r"[._\-/]+", " "))


def is_subdistrict(c: Column) -> Column:
    """Whether a header speaks of a sub-district, tehsil or taluk."""
    key = column_key(c)
    return F.replace(key, F.lit(" "), F.lit("")).contains("subdistrict") | key.rlike(r"^(sub district|tehsil|taluk)| (tehsil|taluk)")


def clean_value(c: Column) -> Column:
    """An index value: trimmed, null-like to null."""
    value = F.trim(c)
    return F.when(~F.lower(value).isin("", "nan", "none", "null", "na", "n/a", "<na>"), value)


#: Letters that index analysis folds to ASCII.
FOLDED = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz")


def analyze(c: Column) -> Column:
    """Index terms: lower case, folded to ASCII, words of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), *FOLDED), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def with_synonyms(terms: Column, values: Mapping[str, str] = words.SYNONYMS) -> Column:
    """The terms and the words of their synonyms, each term followed by its own."""
    table = mapping(values)
    return F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.when(F.element_at(table, t).isNotNull(), F.split(F.element_at(table, t), " ")).otherwise(F.expr("cast(array() as array<string>)")))))


def edge_ngrams(terms: Column, least: int = 2, most: int = 20) -> Column:
    """The beginnings of each term."""
    return F.flatten(F.transform(terms, lambda t: F.when(F.length(t) >= least, F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(t)))), lambda n: F.substring(t, 1, n))).otherwise(F.expr("cast(array() as array<string>)"))))
