"""Cleaning, validation, duplicates, quality and statistics of address tables.

Every step is a projection but for the keyed ones: rows and addresses that
repeat are found by hash, so wide keys are not shuffled whole, and minima
(first row, first name of a code) are taken before the shuffle. ``order`` names
the column that says which row comes first.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words
from .store import kept


def strings(df: DataFrame, keep: Iterable[str] = ()) -> list[str]:
    """The string columns, of which all are cleaned."""
    return [c for c, kind in df.dtypes if kind == "string" and c not in set(keep)]


def apply(df: DataFrame, columns: Iterable[str], function) -> DataFrame:
    """``df`` with a column function applied to those of the columns that it has."""
    return df.withColumns({c: function(F.col(c)) for c in columns if c in df.columns})


def row_dedup(df: DataFrame, order: str, subset: Iterable[str] | None = None) -> DataFrame:
    """The first of rows that agree on ``subset`` (all columns but the serial number and the order)."""
    keys = list(subset) if subset else [c for c in df.columns if c not in ("serial_number", order)]
    return first_rows(df, row_key(keys), order)


def first_rows(df: DataFrame, key: Column, order: str, sums: Iterable[str] = ()) -> DataFrame:
    """The row of the smallest ``order`` for each key, in one pass: rows are reduced before the shuffle. ``sums`` are added up over a key's rows."""
    own = [c for c in df.columns if c not in set(sums)]
    first = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*own), order).alias("_row"), *[F.sum(c).alias(c) for c in sums])
    return first.select("_row.*", *sums)


def blank(c: Column) -> Column:
    return c.isNull() | F.trim(c.cast("string")).isin("", "nan", "None", "<NA>")


def drop_empty_rows(df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    cells = [blank(F.col(c)) for c in df.columns if c not in set(ignore)]
    return df.where(~F.forall(F.array(*cells), lambda x: x)) if cells else df


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value: one aggregate over the table, one row to the driver. A table without rows has none."""
    if not df.columns:
        return []
    seen = df.agg(*[F.max(~blank(F.col(c))) for c in df.columns]).first()
    return [c for c, some in zip(df.columns, seen) if some is False]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def code_names(df: DataFrame, code: str, name: str, order: str) -> DataFrame:
    """(code, name): the first name of each code, both trimmed and not blank."""
    pairs = df.select(F.trim(code).alias("code"), F.trim(name).alias("name"), F.col(order).alias("o")).where("code <> '' and name <> ''")
    return pairs.groupBy("code").agg(F.min(F.struct("o", "name"))["name"].alias("name"))


def hierarchy_names(df: DataFrame, order: str, mappings: Iterable[tuple[str, str]]) -> DataFrame:
    """(column, code, name): the first name of each code, for all pairs in one aggregate."""
    pairs = [F.struct(F.lit(n).alias("column"), F.trim(c).alias("code"), F.trim(n).alias("name")) for c, n in mappings]
    rows = df.select(F.col(order).alias("o"), F.explode(F.array(*pairs)).alias("x")).select("o", "x.*").where("code <> '' and name <> ''")
    return rows.groupBy("column", "code").agg(F.min(F.struct("o", "name"))["name"].alias("name"))


def fill_hierarchy(df: DataFrame, order: str, mappings: Iterable[tuple[str, str]] = words.HIERARCHY) -> DataFrame:
    """Names that are null filled from the first name of their code.

    The lookup has a row per code and is worked out once, as a written table. It is
    left to the optimiser to broadcast it where its measured size allows. ``df`` is
    read twice, so write it first if it is dear.
    """
    own = [(c, n) for c, n in mappings if {c, n} <= set(df.columns)]
    if not own:
        return df
    return fill_names(df, kept(hierarchy_names(df, order, own), "names"), own)


def fill_names(df: DataFrame, known: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Names that are null filled from a table (column, code, name)."""
    for code, name in pairs:
        found = known.where(F.col("column") == name).select(F.col("code").alias("_code"), F.col("name").alias("_name"))
        df = df.join(found, F.trim(code) == F.col("_code"), "left").withColumn(name, F.coalesce(name, "_name")).drop("_code", "_name")
    return df


def fill_attempts(df: DataFrame, mappings: Iterable[tuple[str, str]] = words.HIERARCHY) -> DataFrame:
    """(column, attempts): rows whose name is null while their code is not."""
    pairs = [(c, n) for c, n in mappings if c in df.columns and n in df.columns]
    counts = df.agg(*[F.count_if(F.col(n).isNull() & F.col(c).isNotNull()).alias(n) for c, n in pairs])
    return counts.select(F.explode(F.create_map(*[x for _, n in pairs for x in (F.lit(n), F.col(n))])).alias("column", "attempts"))


def standardize(df: DataFrame, columns: Iterable[str], canonical: DataFrame | None = None) -> DataFrame:
    """Title case, or the canonical spelling where a (key, name) table knows the value."""
    df = apply(df, columns, lambda c: X.blank_to_null(X.title_words(c)))
    if canonical is not None:
        for c in [c for c in columns if c in df.columns]:
            known = canonical.select(F.col("key").alias("_key"), F.col("name").alias("_name"))
            df = df.join(known, X.dedup_key(F.col(c)) == F.col("_key"), "left").withColumn(c, F.coalesce("_name", c)).drop("_key", "_name")
    return df


def validate(df: DataFrame) -> DataFrame:
    """Pincodes and coordinates that are not valid become null."""
    rules = {"pincode": X.pincode, "latitude": lambda c: X.coordinate(c, 90), "longitude": lambda c: X.coordinate(c, 180)}
    return df.withColumns({c: f(F.col(c)) for c, f in rules.items() if c in df.columns})


def invalid(columns: Iterable[str]) -> dict[str, Column]:
    """Whether a row's pincode, latitude and longitude, of those that the table has, are present and not valid."""
    rules = {"pincode": X.pincode, "latitude": lambda c: X.coordinate(c, 90), "longitude": lambda c: X.coordinate(c, 180)}
    own = {c: (F.col(c), f) for c, f in rules.items() if c in set(columns)}
    return {f"invalid_{k}": F.coalesce(c.isNotNull() & (F.trim(c) != "") & f(c).isNull(), F.lit(False)) for k, (c, f) in own.items()}


def invalid_counts(df: DataFrame) -> DataFrame:
    """One row: how many pincodes, latitudes and longitudes are present and not valid."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in invalid(df.columns).items()])


def full_address(df: DataFrame, parts: Iterable[str] = words.ADDRESS_PARTS) -> Column:
    """The parts that have a value, comma-joined; an address that is there already wins."""
    value = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "null", "<na>"), F.trim(c))
    built = F.nullif(F.concat_ws(", ", *[value(c) for c in parts if c in df.columns]), F.lit(""))
    return F.coalesce(value("full_address"), built) if "full_address" in df.columns else built


def address_hash(address: Column) -> Column:
    """SHA-256 of the address as it is compared; null for null and blank."""
    return F.when(F.trim(address) != "", F.sha2(X.dedup_key(address), 256))


def address_dedup(df: DataFrame, order: str, sums: Iterable[str] = ()) -> DataFrame:
    """The first row of each address hash, and all rows without one."""
    alone = F.when(F.col("address_hash").isNull(), F.monotonically_increasing_id())
    return first_rows(df, F.struct(F.col("address_hash"), alone.alias("row")), order, sums)


def has_value(c: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin(*words.NULL_LIKE_QUALITY), F.lit(False))


def quality_score(df: DataFrame, weights: Mapping[str, float] = words.QUALITY_WEIGHTS) -> Column:
    """Earned share, in percent, of the weights of the columns that the table has."""
    own = {c: w for c, w in weights.items() if c in df.columns}
    if not own:
        return F.lit(0.0)
    earned = sum((F.when(has_value(F.col(c)), float(w)).otherwise(0.0) for c, w in own.items()), F.lit(0.0))
    return F.bround(earned / F.lit(float(sum(own.values()))) * 100, 2)


def duplicate_hashes(df: DataFrame) -> DataFrame:
    """One row: rows whose address hash stands more than once."""
    counts = df.where("address_hash is not null").groupBy("address_hash").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


def quality_summary(df: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return df.agg(F.min(q).alias("min"), F.max(q).alias("max"), F.bround(F.avg(q), 2).alias("mean"), F.median(q).alias("median"), F.count_if(q < 50).alias("below_50"))


def null_percentages(df: DataFrame) -> DataFrame:
    """(column, null_pct), null or blank."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    share = df.agg(*[F.bround(F.count_if(empty(c)) / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias(c) for c in df.columns])
    return share.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("column", "null_pct"))


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, distinct_values): (column, value) rows are made distinct before they are counted."""
    own = [c for c in columns if c in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in own])).alias("x")).select("x.*").distinct()
    return long.groupBy("column").agg(F.count("value").alias("distinct_values"))


def coverage(df: DataFrame, columns: Iterable[str] = ("pincode", "latitude", "longitude")) -> DataFrame:
    """(column, present, pct)."""
    own = [c for c in columns if c in df.columns]
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNotNull() & (F.trim(c) != "")).alias(c) for c in own])
    rows = counts.select("n", F.explode(F.create_map(*[x for c in own for x in (F.lit(c), F.col(c))])).alias("column", "present"))
    return rows.select("column", "present", F.bround(F.col("present") / F.greatest("n", F.lit(1)) * 100, 2).alias("pct"))


def cleaned(df: DataFrame, text: Iterable[str]) -> DataFrame:
    """Values without invisible characters, normalised, null where they stand for none."""
    # One step at a time: nested, each would repeat the one before in its expression.
    for step in (X.strip_invisible, X.nfkc, X.null_like):
        df = apply(df, text, step)
    return df


def row_key(columns: Iterable[str]) -> Column:
    """What rows that repeat agree on."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def written_out(df: DataFrame) -> DataFrame:
    """Abbreviations expanded, symbols plain, names in title case."""
    df = apply(df, words.ABBREVIATION_COLUMNS, X.expand_abbreviations)
    df = apply(df, words.SYMBOL_COLUMNS, X.plain_symbols)
    return standardize(df, words.NAME_COLUMNS)


def addressed(df: DataFrame) -> DataFrame:
    """Valid pincodes and coordinates, the full address and its hash."""
    df = validate(df)
    df = df.withColumn("full_address", full_address(df))
    return df.withColumn("address_hash", address_hash(F.col("full_address")))


def cleaned_rows(df: DataFrame, order: str) -> DataFrame:
    """The first of equal rows, without empty rows and columns, its values cleaned: a written table, for which ``df`` is read once.

    Whether a column has any value is observed as the table is written. A column
    without values goes; if it held different blanks, which made equal rows differ,
    the table is written again without it.
    """
    if not df.columns:
        return df
    seen = Observation()
    value = {f"value_{i}": F.max(~blank(F.col(c))) for i, c in enumerate(df.columns)}
    some = {f"some_{i}": F.max(F.col(c).isNotNull()) for i, c in enumerate(df.columns)}
    out = drop_empty_rows(row_dedup(df.observe(seen, *[c.alias(k) for k, c in (value | some).items()]), order), [order])
    out = kept(cleaned(out, strings(out, [order])), "cleaned")
    got = seen.get
    empty = [i for i in range(len(df.columns)) if got[f"value_{i}"] is False]
    if any(got[f"some_{i}"] for i in empty):
        return cleaned_rows(df.drop(*[df.columns[i] for i in empty]), order)
    return out.drop(*[df.columns[i] for i in empty])


def preprocess(df: DataFrame, order: str, tally: bool = False) -> DataFrame:
    """All steps in order: duplicates, empties, cleaning, filling, expansion, validation, address, quality.

    ``df`` is read once; what follows reads the table of cleaned rows, once for the
    names of codes and once for the result. With ``tally`` each row of the result
    carries, as ``_`` columns, how many rows it stands for and what was wrong with
    them, so the counts of all steps are sums over the result and need no pass of
    their own.
    """
    df = cleaned_rows(df, order)
    marks: dict[str, Column] = {}
    if tally:
        fills = {f"filled_{n}": F.col(n).isNull() & F.col(c).isNotNull() for c, n in words.HIERARCHY if {c, n} <= set(df.columns)}
        df, marks = df.withColumns({f"_{k}": c.cast("long") for k, c in fills.items()} | {"_rows": F.lit(1).cast("long")}), {**fills, "rows": F.lit(1)}
    df = written_out(fill_hierarchy(df, order))
    if tally:
        wrong = invalid(df.columns)
        df, marks = df.withColumns({f"_{k}": c.cast("long") for k, c in wrong.items()}), marks | wrong
    df = address_dedup(addressed(df), order, [f"_{k}" for k in marks])
    return df.withColumn("quality_score", quality_score(df))


def report(source: DataFrame, result: DataFrame, order: str) -> DataFrame:
    """(statistic, value): what ``preprocess`` did to ``source``, and what its tallied ``result`` holds.

    Three aggregates, each of one row before its cells become rows: over the
    source, over its empty rows and over the result. A count that needs more
    than one of them is a sum of their parts. Attempts to fill count rows whose
    name is missing while their code is there. An empty table has counts of 0
    and no quality.
    """
    tallies = [c[1:] for c in result.columns if c.startswith("_")]
    kept = [c for c in source.columns if c in result.columns]
    empty = F.forall(F.array(*[blank(F.col(c)) for c in source.columns if c != order]), lambda x: x)
    keys = F.sha2(F.to_json(F.struct(*[c for c in kept if c not in ("serial_number", order)]), {"ignoreNullFields": "false"}), 256)
    n, q = F.count(F.lit(1)), F.col("quality_score")
    total = lambda c: F.coalesce(F.sum(f"_{c}"), F.lit(0))
    cell = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    of_source = {"rows_input": n, "duplicate_rows_removed": n, "empty_columns_removed": F.lit(len(source.columns) - len(kept))}
    of_empty = {"empty_rows_removed": F.count_distinct(keys), "duplicate_rows_removed": -F.count_distinct(keys)}
    of_result = {"rows_output": n, "duplicate_rows_removed": -total("rows"), "duplicate_addresses_removed": total("rows") - n, **{c: total(c) for c in tallies if c != "rows"}}
    of_result |= {"quality_min": F.min(q), "quality_max": F.max(q), "quality_mean": F.bround(F.avg(q), 2), "quality_median": F.bround(F.median(q), 2), "quality_below_50": F.count_if(q < 50)}
    of_result |= {f"covered_{c}": cell(c) for c in ("pincode", "latitude", "longitude") if c in result.columns}
    of_result |= {f"null_pct_{c}": F.bround((1 - cell(c) / F.greatest(n, F.lit(1))) * 100, 2) for c in result.columns if not c.startswith("_") and c != order}

    def rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        one = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(f"`{k}`").alias("value")) for k in values])).alias("x")).select("x.*")

    parts = rows(source, of_source).unionAll(rows(source.where(empty), of_empty)).unionAll(rows(result, of_result))
    return parts.groupBy("statistic").agg(F.sum("value").alias("value"))
