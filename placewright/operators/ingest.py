"""Differently shaped tables into the standard schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import words

FUZZY = 88.0


def aliases() -> dict[str, str]:
    """Header key -> standard column. By rule a column is known by its own name, with and without "(in english)"; the rest is listed."""
    own = {c.replace("_", " "): c for c in words.STANDARD_COLUMNS}
    return own | {a: c for c, names in words.COLUMN_ALIASES.items() for a in names}


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, standard, place): a fixed list, so it may be broadcast."""
    return spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(aliases().items())], "alias string, standard string, place int")


def resolve_columns(headers: DataFrame, known: DataFrame) -> DataFrame:
    """(header, standard, confidence, match) for a table of headers: exact by key, else the best alias of ratio >= 88.

    Headers are compared with the fixed alias list of about 200 rows, so the
    pairs grow with the headers alone.
    """
    keyed = headers.select("header", X.column_key(F.col("header")).alias("key")).distinct()
    exact = keyed.join(F.broadcast(known), F.col("key") == F.col("alias")).select("header", "standard", F.lit(100.0).alias("confidence"), F.lit("exact").alias("match"))
    rest = keyed.join(exact.select("header"), "header", "left_anti").where("key <> ''")
    sub = X.is_subdistrict(F.col("header"))
    fits = F.when(sub, ~F.col("standard").startswith("district_")).otherwise(~F.col("standard").startswith("subdistrict_"))
    score = F.round(S.indel(F.col("key"), F.col("alias")) * 100, 6)
    # Every header meets the fixed list once: not a product of two growing tables.
    listed = rest.select("header", "key", F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("standard"), F.lit(i).alias("place")) for i, (a, c) in enumerate(aliases().items())])).alias("k")).select("header", "key", "k.*")
    near = F.greatest(F.length("key"), F.length("alias")) * 1.0 <= F.least(F.length("key"), F.length("alias")) * (200 - FUZZY) / FUZZY + 1e-9
    scored = listed.where(fits & near).withColumn("score", score).where(F.col("score") >= FUZZY)
    best = scored.groupBy("header").agg(F.max_by(F.struct("standard", "score"), F.struct(F.col("score"), -F.col("place"))).alias("b"))
    fuzzy = best.select("header", "b.standard", F.col("b.score").alias("confidence"), F.lit("fuzzy").alias("match"))
    unmapped = headers.select("header").distinct().join(exact.unionByName(fuzzy).select("header"), "header", "left_anti").select("header", F.lit(None).cast("string").alias("standard"), F.lit(0.0).alias("confidence"), F.lit("unmapped").alias("match"))
    return exact.unionByName(fuzzy).unionByName(unmapped)


def resolve(spark: SparkSession, headers: Sequence[str]) -> list[tuple[str, str | None, float, str]]:
    """The same for the headers of one file, in their order."""
    table = spark.createDataFrame([(h,) for h in headers], "header string")
    found = {r["header"]: r for r in resolve_columns(table, alias_table(spark)).collect()}  # as many rows as headers
    return [(h, found[h]["standard"], found[h]["confidence"], found[h]["match"]) for h in headers]


def standardize(df: DataFrame, mapping: Iterable[tuple[str, str | None]], source_file: str | Column) -> DataFrame:
    """The standard columns in order; of several sources of a column the first that is not blank; missing ones are null."""
    sources: dict[str, list[str]] = {}
    for header, standard in mapping:
        if standard and header.strip() and not header.startswith("Unnamed"):
            sources.setdefault(standard, []).append(header)

    def column(name: str) -> Column:
        if name == "source_file":
            return F.lit(source_file).alias(name) if isinstance(source_file, str) else source_file.alias(name)
        values = [X.nullable_string(F.col(f"`{h}`").cast("string")) for h in sources.get(name, [])]
        value = F.coalesce(*values) if values else F.lit(None).cast("string")
        return (value.try_cast("double") if name in ("latitude", "longitude") else value).alias(name)

    return df.select([column(c) for c in words.STANDARD_COLUMNS])


def merge(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def validate_columns(columns: Sequence[str]) -> list[str]:
    """Errors of a table's header."""
    errors = []
    if not columns:
        errors.append("no columns")
    if columns and all(c.startswith("Unnamed") or not c.strip() for c in columns):
        errors.append("all columns unnamed")
    if len({c.strip() for c in columns}) < len(columns):
        errors.append("duplicate column names")
    return errors


def header_scores(lines: DataFrame) -> DataFrame:
    """(line, score) of candidate header rows (line, cells array<string>).

    All empty -100; one value among more than three cells -50; else the distinct
    aliases, less half a point for each number, and half a point more if any
    alias and no two equal cells.
    """
    known = X.any_of(aliases())
    cells = F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    keys = F.transform(cells, X.column_key)
    hits = F.size(F.array_intersect(keys, known))
    numbers = F.size(F.filter(cells, lambda c: F.replace(F.trim(c), F.lit(","), F.lit("")).rlike(r"^-?\d+(\.\d+)?$")))
    unique = F.size(F.array_distinct(cells)) == F.size(cells)
    score = F.when(F.size(cells) == 0, -100.0).when((F.size(cells) == 1) & (F.size("cells") > 3), -50.0).otherwise(hits - 0.5 * numbers + F.when((hits > 0) & unique, 0.5).otherwise(0.0))
    return lines.select("line", score.alias("score"))
