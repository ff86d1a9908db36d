"""Free-text queries: normal form, tokens, phrases, numbers, intent, errors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import words


def no_tokens() -> Column:
    return F.expr("cast(array() as array<string>)")



def first(values: Column) -> Column:
    """The first that is not null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def index_of(tokens: Column, markers: Iterable[str]) -> Column:
    """Place (from 0) of the first token among the markers."""
    return first(F.transform(tokens, lambda t, i: F.when(t.isin(*markers), i)))


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def is_letters(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def normal_tokens(tokens: Column, spelling: Mapping[str, str] = words.SPELLING, abbreviations: Mapping[str, str] = words.ABBREVIATIONS, states: Mapping[str, str] = words.STATES) -> Column:
    """Spelling, abbreviations and states applied one after another; words that repeat are dropped."""
    tables = [X.mapping(table) for table in (spelling, abbreviations, states)]

    def looked_up(t: Column) -> Column:
        for table in tables:
            t = F.coalesce(F.element_at(table, t), t)
        return t

    tokens = F.transform(tokens, looked_up)
    parts = F.flatten(F.transform(tokens, lambda t: F.split(F.trim(F.replace(t, F.lit("."), F.lit(" "))), r"\s+")))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def raw_tokens(query: Column) -> Column:
    """Lower case, punctuation to spaces, split."""
    return F.filter(F.split(X.dedup_key(F.coalesce(query, F.lit(""))), " "), lambda t: t != "")


def search_tokens(query: Column) -> Column:
    return normal_tokens(raw_tokens(query))


def parser_tokens(query: Column) -> Column:
    return normal_tokens(raw_tokens(query), words.PARSER_SPELLING, words.PARSER_ABBREVIATIONS, words.PARSER_STATES)


def windows(tokens: Column, most: int = 4) -> Column:
    """All runs of 2 to ``most`` tokens, by start, then length."""
    most = max(2, most)
    runs = F.transform(tokens, lambda t, i: F.transform(F.filter(F.array(*[F.lit(n) for n in range(2, most + 1)]), lambda n: i + n <= F.size(tokens)), lambda n: F.array_join(F.slice(tokens, i + 1, n), " ")))
    return F.flatten(runs)


def phrases(tokens: Column) -> Column:
    """Runs of 2 to 4 tokens that no number interrupts."""
    segments = F.filter(F.split(F.array_join(F.transform(tokens, lambda t: F.when(is_digits(t), "\x1f").otherwise(t)), " "), "\x1f"), lambda s: F.trim(s) != "")
    return F.flatten(F.transform(segments, lambda s: windows(F.split(F.trim(s), " "))))


def numbers(query: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("[0-9]+"), F.lit(0))


def potential_pincode(query: Column) -> Column:
    return F.exists(numbers(query), lambda n: F.length(n) == 6)


def has(tokens: Column, markers: Iterable[str]) -> Column:
    return F.arrays_overlap(tokens, X.any_of(markers))


def intent(tokens: Column) -> Column:
    """The first rule that holds."""
    n, single = F.size(tokens), F.get(tokens, F.lit(0))
    pin = F.exists(tokens, lambda t: t.rlike(X.PINCODE))
    states = sorted(set(words.STATES.values()))
    return (
        F.when(n == 0, "AUTO_SEARCH")
        .when((n == 1) & single.rlike(X.PINCODE), "PINCODE_SEARCH")
        .when(has(tokens, words.BUILDING_INTENT) & ((n >= 4) | pin), "FULL_ADDRESS_SEARCH")
        .when(has(tokens, words.LANDMARK_INTENT), "NEARBY_SEARCH")
        .when(has(tokens, words.OFFICE), "OFFICE_SEARCH")
        .when(has(tokens, words.BLOCK), "BLOCK_SEARCH")
        .when(has(tokens, words.VILLAGE), "VILLAGE_SEARCH")
        .when(has(tokens, words.DISTRICT), "DISTRICT_SEARCH")
        .when(has(tokens, words.ROAD_INTENT), "ROAD_SEARCH")
        .when(has(tokens, words.BUILDING_INTENT), "BUILDING_SEARCH")
        .when(has(tokens, states), "STATE_SEARCH")
        .when(n == 1, "CITY_SEARCH")
        .when(n == 2, "LOCALITY_SEARCH")
        .when(n >= 4, "FULL_ADDRESS_SEARCH")
        .otherwise("LOCALITY_SEARCH")
    )


def errors(tokens: Column) -> Column:
    """What is wrong with a query; it is run all the same."""
    n, single = F.size(tokens), F.get(tokens, F.lit(0))
    found = F.array(
        F.when(n == 0, "Query cannot be empty."),
        F.when(F.exists(tokens, lambda t: is_digits(t) & (F.length(t) > 6)), "Query contains unsupported numeric tokens."),
        F.when((n == 1) & is_digits(single) & ~single.rlike(X.PINCODE), "Single numeric token is not a valid pincode."),
        F.when((n == 1) & (F.length(single) < 2), "Query is too short."),
    )
    return F.filter(found, lambda e: e.isNotNull())


def locality_variants(value: Column) -> Column:
    """The normal form of a locality and its other spellings."""
    normal = S.normalize(value)
    others = {a: [b for b in group if b != a] for group in words.LOCALITY_ALIASES for a in group}
    table = F.create_map(*[x for a, bs in others.items() for x in (F.lit(a), X.any_of(bs))])
    return F.when(F.length(F.coalesce(value, F.lit(""))) == 0, no_tokens()).when(normal == "", F.array(value)).otherwise(F.concat(F.array(normal), F.coalesce(F.element_at(table, normal), no_tokens())))


def analyze(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with tokens, normalized_query, phrases, intent and validation_errors."""
    t = F.col("tokens")
    out = queries.withColumn("tokens", search_tokens(F.col(text)))
    return out.withColumns({"normalized_query": F.array_join(t, " "), "phrases": phrases(t), "intent": intent(t), "validation_errors": errors(t)})
