"""CSV files of unknown encoding and header row, and the sinks of each step."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words
from ..operators import ingest
from ..streaming.upsert import latest
from . import records
from .records import Surveyed

#: Tried in turn; the first in which every byte of the file has a meaning is taken. UTF-8, windows-1252 and the one-byte encodings of Python are known;
#: ISO-8859-1 always fits, so give windows-1252 instead for files that need it.
ENCODINGS = ("UTF-8", "ISO-8859-1")


@dataclass
class Loaded:
    """What became of one file."""

    path: str
    status: str = "success"
    header_row: int = 0
    encoding: str = "UTF-8"
    rows: int | None = None
    mapping: list = field(default_factory=list)
    confidence: float | None = None
    warnings: list = field(default_factory=list)
    errors: list = field(default_factory=list)


def discover(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Files below a folder, sorted; only their names reach the driver. A folder that is not there has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    try:
        return sorted(unquote(p) for p in files.load(folder).inputFiles())  # empty ones too
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def named(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    """Cells as columns; an empty cell is null, missing ones too."""
    return rows.select([F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)])


def filled(rows: DataFrame) -> DataFrame:
    """Records with a cell that is not blank."""
    return rows.where(F.exists("cells", lambda c: F.trim(c) != ""))


def described(file: Surveyed, encodings: Sequence[str]) -> Loaded:
    report = Loaded(unquote(file.path), header_row=file.header_row, encoding=file.encoding or "")
    if file.encoding is None:
        report.status, report.errors = "failed", ["no encoding fits"]
    if file.header_row:
        report.warnings.append(f"header in row {file.header_row}")
    if file.encoding != encodings[0]:
        report.warnings.append(f"read as {file.encoding}")
    return report


def load(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> tuple[DataFrame, Loaded]:
    """The records below the header of a file as strings; values may hold line ends."""
    found = records.survey(spark, [path], encodings)
    if not found:
        raise ValueError("empty file")
    report = described(found[0], encodings)
    if report.errors:
        raise ValueError(report.errors[0])
    return named(filled(records.records(spark, [path], found)), dedupe(found[0].header)), report


def dedupe(header: list[str]) -> list[str]:
    """Header names made distinct: a second ``Name`` becomes ``Name.1``."""
    seen: dict[str, int] = {}
    out = []
    for h in header:
        n = seen.get(h.lower(), 0)
        seen[h.lower()] = n + 1
        out.append(f"{h}.{n}" if n else h)
    return out


def standard_rows(rows: DataFrame, mapped: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """(path, cells) in the standard schema; ``mapped`` has, for each path, cell numbers with their standard columns.

    Which cells are whose is a table of a row for each file, so files of any number
    of shapes are one plan.
    """
    spark = rows.sparkSession
    places = {p: [[i for i, s in pairs if s == c] for c in words.STANDARD_COLUMNS] for p, pairs in mapped.items()}
    most = [max((len(x[k]) for x in places.values()), default=0) for k in range(len(words.STANDARD_COLUMNS))]
    table = spark.createDataFrame([(p, unquote(p).rsplit("/", 1)[-1], x) for p, x in places.items()], "path string, file string, at array<array<int>>")

    def column(k: int, name: str) -> Column:
        if name == "source_file":
            return F.col("file").alias(name)
        values = [X.nullable_string(F.get("cells", F.get(F.get("at", F.lit(k)), F.lit(j)))) for j in range(most[k])]
        value = F.coalesce(*values) if values else F.lit(None).cast("string")
        return (value.try_cast("double") if name in ("latitude", "longitude") else value).alias(name)

    return rows.join(table, "path").select([column(k, c) for k, c in enumerate(words.STANDARD_COLUMNS)])


def ingest_folder(spark: SparkSession, folder: str, count: bool = False, encodings: Sequence[str] = ENCODINGS) -> tuple[DataFrame | None, list[Loaded]]:
    """All CSV files of a folder in the standard schema, and a report per file; a file that fails is reported and left out.

    Files are surveyed together in one job, their columns resolved in a second, and
    read in one plan. With ``count`` each report has its number of rows, which reads
    all files once more.
    """
    paths = discover(spark, folder)
    if not paths:
        return None, []
    surveyed = records.survey(spark, paths, encodings)
    headers = {f.path: dedupe(f.header) for f in surveyed}
    plain = lambda c: c.rsplit(".", 1)[0] if c.rsplit(".", 1)[-1].isdigit() else c
    resolved = {h: (s, c, m) for h, s, c, m in ingest.resolve(spark, sorted({plain(c) for hs in headers.values() for c in hs}))}
    reports, mapped = [], {}
    for f in surveyed:
        report = described(f, encodings)
        found = [(plain(c), *resolved[plain(c)]) for c in headers[f.path]]
        report.mapping, report.errors = found, report.errors + ingest.validate_columns(headers[f.path])
        report.confidence = round(sum(x[2] for x in found) / len(found), 4) if found else None
        report.warnings += [f"column {x[0]} has no standard name" for x in found if not x[1]]
        if report.status == "success":
            mapped[f.path] = [(i, x[1]) for i, x in enumerate(found) if x[1] and x[0].strip() and not x[0].startswith("Unnamed")]
        reports.append(report)
    seen = {r.path for r in reports}
    reports += [Loaded(p, status="failed", errors=["empty file"]) for p in map(unquote, paths) if p.split(":", 1)[-1].lstrip("/") not in {q.split(":", 1)[-1].lstrip("/") for q in seen}]
    if not mapped:
        return None, sorted(reports, key=lambda r: r.path)
    rows = filled(records.records(spark, paths, surveyed))
    if count:
        n = {unquote(r["path"]): r["n"] for r in rows.groupBy("path").agg(F.count("*").alias("n")).collect()}  # a row for each file
        for r in reports:
            r.rows = n.get(r.path, 0) if r.status == "success" else None
            if r.rows == 0:
                r.warnings.append("no rows below the header")
    return standard_rows(rows, mapped), sorted(reports, key=lambda r: r.path)


def write_reports(spark: SparkSession, reports: list[Loaded], path: str) -> None:
    """Reports as JSON lines."""
    spark.createDataFrame([(json.dumps(asdict(r)),) for r in reports], "value string").coalesce(1).write.mode("overwrite").text(path)


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[kind](path)


def merge_by_key(old: DataFrame, new: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` over those of ``old`` that have the same key: an upsert that may be repeated. Of rows of ``new`` with one key the greatest ``order``, else the greatest row, stays."""
    last = latest(new, key, order)
    return old.join(last.select(key), key, "left_anti").unionByName(last)
