"""Address entities of a query's tokens, by two sets of rules: the search's and the parser's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words
from .query import first, index_of, is_digits, is_letters, no_tokens, parser_tokens

SEARCH_FIELDS = ("pincode", "state", "landmark", "office_name", "road_name", "district", "village", "block", "taluka", "building_name", "flat_number", "locality", "city")
PARSER_FIELDS = ("building_name", "flat_number", "house_number", "road_name", "locality", "area", "village", "city", "district", "state", "pincode", "landmark")
STATE_NAMES = tuple(dict.fromkeys(words.STATES.values()))
#: Markers that are never part of a name.
SEPARATORS = tuple(dict.fromkeys(words.BUILDING + words.ROAD + words.LOCALITY + words.VILLAGE + words.TALUKA + words.DISTRICT + words.OFFICE + words.PREPOSITIONS))
#: City states: the state is the city where no other is named.
CITY_STATES = ("Delhi", "Chandigarh")


def join(tokens: Column) -> Column:
    """Title-cased words, null for none."""
    return F.when(F.size(tokens) > 0, X.title(F.array_join(tokens, " ")))


def at(tokens: Column, i: Column) -> Column:
    return F.get(tokens, i)


def ngrams(tokens: Column, n: int) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(i + n <= F.size(tokens), F.array_join(F.slice(tokens, i + 1, n), " "))), lambda g: g.isNotNull())


def without(tokens: Column, markers: Iterable[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*markers))


def minus(tokens: Column, names: Column) -> Column:
    """Tokens that are not among the words of a name."""
    own = F.split(F.lower(F.coalesce(names, F.lit(""))), " ")
    return F.filter(tokens, lambda t: ~F.array_contains(own, t))


def pincode(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t.rlike(X.PINCODE)), F.lit(0))


def state(tokens: Column) -> Column:
    """A state's name of two, three, then one word; else its abbreviation."""
    named = F.filter(F.concat(ngrams(tokens, 2), ngrams(tokens, 3), tokens), lambda g: g.isin(*STATE_NAMES))
    short = first(F.transform(tokens, lambda t: F.element_at(X.mapping(words.STATES), t)))
    return X.title(F.coalesce(F.get(named, F.lit(0)), short))


def labelled(tokens: Column, markers: Iterable[str]) -> Column:
    """The first marker with a number before it and a word after it."""
    i = index_of(tokens, markers)
    before, after = at(tokens, i - 1), at(tokens, i + 1)
    parts = F.array(F.when(F.coalesce(is_digits(before), F.lit(False)), before), at(tokens, i), F.when(F.coalesce(is_letters(after), F.lit(False)), after))
    return F.when(i.isNotNull(), join(F.filter(parts, lambda p: p.isNotNull())))


def road(tokens: Column, before: int = 3, markers: Iterable[str] = words.ROAD) -> Column:
    """The first road marker with the words before it."""
    i = index_of(tokens, markers)
    start = F.greatest(i - before, F.lit(0))
    return F.when(i.isNotNull(), join(F.slice(tokens, start + 1, i - start + 1)))


def office(tokens: Column) -> Column:
    """The words before an office marker (four at most) and the office markers from there; not after a landmark preposition."""

    def named(t: Column, i: Column) -> Column:
        fits = lambda k: F.coalesce(is_letters(at(tokens, i - k)) & ~at(tokens, i - k).isin(*SEPARATORS), F.lit(False))
        n = F.aggregate(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]), F.lit(0), lambda n, k: F.when((n == k - 1) & (k <= i) & fits(k), k).otherwise(n))
        led = F.coalesce((i > n) & at(tokens, i - n - 1).isin(*words.PREPOSITIONS), F.lit(False))
        last = F.aggregate(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]), F.lit(0), lambda m, k: F.when((m == k - 1) & F.coalesce(at(tokens, i + k).isin(*words.OFFICE), F.lit(False)), k).otherwise(m))
        return F.when(t.isin(*words.OFFICE) & ~led & (n > 0), F.array_join(F.slice(tokens, i - n + 1, n + 1 + last), " "))

    return X.title(first(F.transform(tokens, named)))


def landmark(tokens: Column) -> Column:
    """Up to three words after a landmark preposition, to the first landmark word; numbers, states and prepositions end them."""

    def phrase(t: Column, i: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            x = at(tokens, i + k)
            stop = s["done"] | F.coalesce(is_digits(x) | x.isin(*words.PREPOSITIONS, *STATE_NAMES), F.lit(True))
            return F.struct(F.when(stop, s["n"]).otherwise(k).alias("n"), (stop | F.coalesce(x.isin(*words.LANDMARKS), F.lit(False))).alias("done"))

        n = F.aggregate(F.array(*[F.lit(k) for k in (1, 2, 3)]), F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), step)["n"]
        return F.when(t.isin(*words.PREPOSITIONS) & (n > 0), F.array_join(F.slice(tokens, i + 2, n), " "))

    return X.title(first(F.transform(tokens, phrase)))


def flat_number(tokens: Column) -> Column:
    """``flat N``, ``house number N`` or ``house N``."""

    def number(t: Column, i: Column) -> Column:
        one, two = at(tokens, i + 1), at(tokens, i + 2)
        return (
            F.when((t == "flat") & is_digits(one), one)
            .when((t == "house") & (one == "number") & is_digits(two), two)
            .when((t == "house") & is_digits(one), one)
        )

    return first(F.transform(tokens, number))


def detect(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``df`` with a struct ``entities`` of the search's thirteen entities."""
    t = F.col(tokens)
    out = df.withColumns({
        "_pincode": pincode(t), "_state": state(t), "_landmark": landmark(t), "_office": office(t), "_road": road(t),
        "_district": labelled(t, words.DISTRICT), "_village": labelled(t, words.VILLAGE), "_block": labelled(t, words.BLOCK), "_taluka": labelled(t, words.TALUKA), "_flat": flat_number(t),
        "_marker": index_of(t, words.BUILDING),
    })
    col = F.col
    used = without(minus(minus(t, col("_office")), col("_landmark")), words.PREPOSITIONS)
    left = minus(F.filter(used, lambda x: ~F.coalesce(x == col("_pincode"), F.lit(False))), col("_state"))
    markers = words.BUILDING + words.ROAD + words.LOCALITY + words.VILLAGE + words.BLOCK + words.TALUKA + words.DISTRICT + words.OFFICE
    left = minus(without(left, markers), col("_road"))
    tail = F.slice(t, col("_marker") + 2, F.size(t))
    tail = F.filter(tail, lambda x: ~F.coalesce((x == col("_pincode")) | (x == col("_flat")), F.lit(False)) & ~F.coalesce(x == col("_flat"), F.lit(False)) & ~F.coalesce(x == col("_pincode"), F.lit(False)))
    tail = without(minus(minus(without(tail, words.BUILDING + words.ROAD + words.LOCALITY), col("_office")), col("_landmark")), words.PREPOSITIONS)
    out = out.withColumns({"_left": left, "_tail": F.coalesce(tail, no_tokens())})
    n, m, rest, after = F.size("_left"), F.size("_tail"), col("_left"), col("_tail")
    one = lambda a, i: X.title(F.get(a, i))
    building = F.when(m >= 3, join(F.slice(after, 1, m - 2))).when(m >= 1, one(after, F.lit(0)))
    out = out.withColumns({"_b": building, "_l": F.when(m >= 3, one(after, m - 2)).when(m == 2, one(after, F.lit(1))), "_c": F.when(m >= 3, one(after, m - 1))})
    no = col("_b").isNull()
    name = F.when(~no, col("_b")).when(n >= 4, join(F.slice(rest, 1, 2))).when(n == 3, one(rest, F.lit(0)))
    locality = F.coalesce("_l", F.when(no & (n >= 4), one(rest, n - 2)).when(no & (n == 3), one(rest, F.lit(1))).when(no & (n == 2), one(rest, F.lit(0))), F.when(n >= 2, one(rest, n - 2)))
    city = F.coalesce("_c", F.when(n >= 1, one(rest, n - 1)))
    alone = F.when(col("_state").isNotNull() & (F.size(t) == 1), F.get(t, F.lit(0)))
    fields = {
        "pincode": col("_pincode"), "state": col("_state"), "landmark": col("_landmark"), "office_name": col("_office"), "road_name": col("_road"),
        "district": col("_district"), "village": col("_village"), "block": col("_block"), "taluka": col("_taluka"), "building_name": name, "flat_number": col("_flat"),
        "locality": locality, "city": F.coalesce(city, F.when(col("_state").isin(*CITY_STATES), col("_state")), alone),
    }
    out = out.withColumn("entities", F.struct(*[v.alias(k) for k, v in fields.items()]))
    return out.select(*df.columns, "entities")


def marked(tokens: Column, markers: Iterable[str], after: int) -> Column:
    """The first marker and the words after it."""
    i = index_of(tokens, markers)
    return F.when(i.isNotNull(), join(F.slice(tokens, i + 1, after + 1)))


def parser_state(tokens: Column) -> Column:
    """An abbreviation of a state first, then its name."""
    short = first(F.transform(tokens, lambda t: F.element_at(X.mapping(words.PARSER_STATES), t)))
    named = F.filter(F.concat(ngrams(tokens, 2), ngrams(tokens, 3), ngrams(tokens, 4), tokens), lambda g: g.isin(*words.PARSER_STATE_NAMES))
    return X.title(F.coalesce(short, F.get(named, F.lit(0))))


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``parsed``: twelve entities without repeated values, intent and confidence."""
    out = df.withColumn("_t", parser_tokens(F.col(text)))
    t, col = F.col("_t"), F.col
    out = out.withColumns({
        "_pincode": pincode(t), "_state": parser_state(t), "_road": road(t, 2, words.PARSER_ROAD), "_landmark": marked(t, words.PARSER_LANDMARK, 2),
        "_district": marked(t, words.DISTRICT, 1), "_village": marked(t, words.VILLAGE, 1), "_marker": index_of(t, words.PARSER_BUILDING),
    })
    no_pin = lambda a: F.filter(a, lambda x: ~F.coalesce(x == col("_pincode"), F.lit(False)))
    left = minus(minus(minus(no_pin(t), col("_state")), col("_road")), col("_landmark"))
    left = without(left, words.PARSER_BUILDING + words.PARSER_LOCALITY + words.VILLAGE + words.DISTRICT)
    after = at(t, col("_marker") + 1)
    out = out.withColumns({"_left": left, "_flat": F.when(is_digits(after), after), "_after": no_pin(F.slice(t, col("_marker") + 2, F.size(t)))})
    tail = F.when(F.coalesce(F.get("_after", F.lit(0)) == col("_flat"), F.lit(False)), F.slice("_after", F.lit(2), F.size("_after"))).otherwise(col("_after"))
    out = out.withColumn("_tail", F.coalesce(without(tail, words.PARSER_BUILDING + words.PARSER_ROAD), no_tokens()))
    n, m, rest, tail = F.size("_left"), F.size("_tail"), col("_left"), col("_tail")
    one = lambda a, i: X.title(F.get(a, i))
    out = out.withColumns({
        "_b": F.when(m >= 3, join(F.slice(tail, 1, m - 2))).when(m >= 1, one(tail, F.lit(0))),
        "_l": F.when(m >= 3, one(tail, m - 2)).when(m == 2, one(tail, F.lit(1))), "_c": F.when(m >= 3, one(tail, m - 1)),
    })
    no, single = col("_b").isNull(), F.size(t) == 1
    name = F.when(~no, col("_b")).when(n >= 4, join(F.slice(rest, n - 1, F.lit(2)))).when(n == 3, join(F.slice(rest, 2, 2)))
    locality = F.coalesce("_l", F.when(no & ((n >= 2) | ((n == 1) & ~single)), one(rest, F.lit(0))))
    city = F.coalesce("_c", F.when(no & (n >= 4), one(rest, n - 3)).when(no & (n.isin(2, 3)), one(rest, F.lit(1))), F.when(n == 1, one(rest, F.lit(0))))
    lone = single & city.isNull() & col("_state").isNull() & col("_pincode").isNull()
    out = out.withColumns({"_name": name, "_locality": F.when(~lone, locality), "_city": F.when(lone, one(t, F.lit(0))).otherwise(city)})
    values = {
        "building_name": col("_name"), "flat_number": col("_flat"), "house_number": col("_flat"), "road_name": col("_road"), "locality": col("_locality"), "area": col("_locality"),
        "village": col("_village"), "city": col("_city"), "district": col("_district"), "state": col("_state"), "pincode": col("_pincode"), "landmark": col("_landmark"),
    }
    # A value that an earlier field already has is dropped.
    kept, seen = {}, []
    for k in PARSER_FIELDS:
        key = F.lower(F.trim(values[k]))
        kept[k] = F.when(~F.coalesce(F.array_contains(F.array(*seen), key), F.lit(False)), values[k]) if seen else values[k]
        seen.append(F.coalesce(key, F.lit("")))
    out = out.withColumn("_e", F.struct(*[v.alias(k) for k, v in kept.items()]))
    e = col("_e")
    filled = sum((e[k].isNotNull().cast("int") for k in PARSER_FIELDS), F.lit(0))
    out = out.withColumn("_n", filled)
    tokens = F.size(t)
    confidence = F.bround(F.least(F.lit(0.99), F.lit(0.25) + 0.08 * col("_n") + F.when(e["pincode"].isNotNull(), 0.12).otherwise(0.0) + F.when(tokens >= 4, 0.15).otherwise(0.0)), 4)
    some = lambda *ks: F.coalesce(*[e[k] for k in ks]).isNotNull()
    intent = (
        F.when(tokens == 0, "EMPTY_QUERY")
        .when((tokens == 1) & some("pincode"), "PINCODE_SEARCH")
        .when((tokens == 1) & some("city"), "CITY_SEARCH")
        .when(some("building_name") & (some("pincode", "locality", "area", "city", "district", "state") | (tokens >= 4)), "FULL_ADDRESS_SEARCH")
        .when((col("_n") >= 3) & (tokens >= 4), "FULL_ADDRESS_SEARCH")
        .when(some("building_name"), "BUILDING_SEARCH")
        .when(some("road_name"), "ROAD_SEARCH")
        .when(some("locality", "area"), "LOCALITY_SEARCH")
        .when(some("city"), "CITY_SEARCH")
        .when(some("district"), "DISTRICT_SEARCH")
        .when(some("state"), "STATE_SEARCH")
        .otherwise("AUTO")
    )
    parsed = F.struct(*[e[k].alias(k) for k in PARSER_FIELDS], intent.alias("intent"), confidence.alias("confidence"))
    return out.withColumn("parsed", parsed).select(*df.columns, "parsed")
