"""CSV records of many files at once, cut in parallel though quoted values may hold line ends.

A file is read line by line, in the blocks in which Spark splits it. Whether a
line begins inside a quoted value depends on all lines before it, so a first
pass finds, for each block, the state after it for both states before it, the
first lines of the file and whether its bytes are UTF-8: one scan for all files,
one row a block. Composing the blocks of a file gives the state in which each
begins. The second pass cuts each block on its own; what a block does not hold
whole (a record's end in the next block) is put together by the block in which
the record begins, and only that is shuffled.

Values are those of a comma-separated file with doubled quotes, where a quote
counts only at the beginning of a value. Lines end with LF, CR LF or CR; a file
that has no LF at all is one line, so it is not split.

The driver holds a row for each block, as it does for each task that reads one.
Both passes must cut files alike: ``pinned`` fixes what that depends on, and a
block that the first pass has not seen ends the second one with an error.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest

PREVIEW = 20
#: Blocks that begin below this may hold one of the first ``PREVIEW`` records, so their first lines are kept.
HEAD_BYTES = 1 << 20
MARK = b"\xef\xbb\xbf"
BLOCK = "path string, block long, lines long, bad long, from_outside boolean, from_inside boolean, opened boolean, head array<binary>"
CUT = "path string, cells array<string>, head long, block long, line long, piece binary"
#: What the bytes 128 to 159 mean in windows-1252, those without a meaning left out.
WINDOWS = {b: bytes([b]).decode("cp1252") for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")}


@dataclass
class Surveyed:
    """A file: its encoding (None if none fits), the blocks that begin inside a record with the block in which that record begins, and its header."""

    path: str
    encoding: str | None
    header_row: int
    header: list[str]
    blocks: frozenset[int]
    inside: dict[int, int]
    #: Block and line at which the header begins; records up to there are left out.
    at: tuple[int, int]
    #: Whether the file ends inside a quoted value, which is a record all the same.
    unclosed: bool = False


def pinned(spark: SparkSession) -> None:
    """Fix how many parts a scan aims at, so that executors that come or go between two scans do not change where files are cut."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def physical(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, path, block): lines as bytes, in order within a block; a block is read by one task."""
    pinned(spark)
    text = spark.read.option("lineSep", "\n").text(list(paths))
    return text.select(F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("valid"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted value is open after a line."""
    state = "quoted" if inside else "start"
    for piece in line.split(b'"')[:-1]:
        if state == "quoted":
            state = "closed"
        elif piece.endswith(b",") or (not piece and state != "plain"):
            state = "quoted"  # a value begins, or a doubled quote goes on
        else:
            state = "plain"
    return state == "quoted"


def ends(value: bytes) -> list[tuple[bytes, bytes]]:
    """The lines of what stands before an LF, each with its own line end."""
    *first, last = value.split(b"\r")
    out = [(f, b"\r") for f in first]
    if last or not first:
        return [*out, (last, b"\n")]
    return [*out[:-1], (first[-1], b"\r\n")]


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, block, from, to) of stretches of one block."""
    path, block = batch.column("path").to_pylist(), batch.column("block").to_pylist()
    i = 0
    while i < len(path):
        j = i + 1
        while j < len(path) and block[j] == block[i] and path[j] == path[i]:
            j += 1
        yield path[i], block[i], i, j
        i = j


def quoted(values: pa.Array) -> pa.Array:
    """Which lines need a look: those with quotes or with a CR that is not their last byte."""
    cr = pc.count_substring(values, b"\r")
    plain = pc.or_(pc.equal(cr, 0), pc.and_(pc.equal(cr, 1), pc.ends_with(values, b"\r")))
    return pc.or_(pc.match_substring(values, b'"'), pc.invert(plain))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in BLOCK.split(", ")]
    now: dict | None = None

    def row(b: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b[n]], k) for n, k in zip(names, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.binary())))], names=names)

    for batch in batches:
        values, valid = batch.column("value"), batch.column("valid")
        for path, block, i, j in runs(batch):
            if now is None or (now["path"], now["block"]) != (path, block):
                if now:
                    yield row(now)
                now = {"path": path, "block": block, "lines": 0, "bad": 0, "from_outside": False, "from_inside": True, "opened": False, "head": []}
            part = values.slice(i, j - i)
            if block < HEAD_BYTES and len(now["head"]) < 4 * PREVIEW:
                now["head"] += part.slice(0, 4 * PREVIEW - len(now["head"])).to_pylist()
            now["lines"] += j - i
            now["bad"] += pc.sum(pc.invert(valid.slice(i, j - i))).as_py() or 0
            for value in part.filter(quoted(part)).to_pylist():
                for line, _ in ends(value):
                    now["from_outside"], now["from_inside"] = inside_after(line, now["from_outside"]), inside_after(line, now["from_inside"])
                    now["opened"] |= not now["from_inside"]
    if now:
        yield row(now)


def decoder(encoding: str):
    """Bytes to text; a byte that windows-1252 gives no meaning is the control character of its number."""
    name = encoding.lower()
    if name in ("utf-8", "utf8"):
        return lambda b: b.decode("utf-8")
    if name in ("windows-1252", "cp1252"):
        return lambda b: b.decode("latin-1").translate(WINDOWS)
    return lambda b: b.decode(name)


def preview(blocks: list[dict], encoding: str) -> list[tuple[tuple[int, int], list[str]]]:
    """((block, line), cells) of the first records."""
    out, pending, inside, begun = [], b"", False, (0, 0)
    text = decoder(encoding)
    for b in blocks:
        number = 0
        for value in b["head"]:
            for line, end in ends(value.removeprefix(MARK) if (b["block"], number) == (0, 0) else value):
                if not inside:
                    pending, begun = b"", (b["block"], number)
                number += 1
                inside = inside_after(line, inside)
                pending += line + (end if inside else b"")
                if not inside:
                    out.append((begun, cut([text(pending)])[0]))
                    if len(out) == PREVIEW:
                        return out
        if b["lines"] > len(b["head"]):
            break
    return out


def cut(records: Sequence[str]) -> list[list[str]]:
    """Records, each a text, cut into values; an empty line has none."""
    csv.field_size_limit(sys.maxsize)
    return [next(csv.reader(io.StringIO(r, newline="")), []) if "\n" in r or "\r" in r else next(csv.reader((r,)), []) for r in records]


def survey(spark: SparkSession, paths: Sequence[str], encodings: Sequence[str]) -> list[Surveyed]:
    """What there is to know of each file that has a line: the first encoding that fits, the best header of its first records, and its blocks."""
    by_path: dict[str, list[dict]] = {}
    for r in physical(spark, paths).mapInArrow(_survey, BLOCK).orderBy("path", "block").collect():  # a row for each block
        by_path.setdefault(r["path"], []).append(r.asDict())
    firsts = {}
    for path, blocks in by_path.items():
        bad = any(b["bad"] for b in blocks)
        encoding = next((e for e in encodings if e.upper() != "UTF-8" or not bad), None)
        firsts[path] = encoding, preview(blocks, encoding) if encoding else []
    lines = [((path, i), cells) for path, (_, rows) in firsts.items() for i, (_, cells) in enumerate(rows)]
    best: dict[str, int] = {}
    if lines:
        scored = ingest.header_scores(spark.createDataFrame(lines, "line struct<path:string,i:int>, cells array<string>"))
        top = scored.groupBy("line.path").agg(F.max_by("line.i", F.struct("score", -F.col("line.i"))).alias("i"))
        best = {r["path"]: r["i"] for r in top.collect()}
    out = []
    for path, blocks in by_path.items():
        encoding, rows = firsts[path]
        inside, state, begun = {}, False, 0
        for b in blocks:
            if state:
                inside[b["block"]] = begun
            after = b["from_inside"] if state else b["from_outside"]
            if after and (not state or b["opened"]):
                begun = b["block"]
            state = after
        at, cells = rows[best[path]] if rows else ((0, -1), [])
        header = [c.strip() or f"Unnamed: {i}" for i, c in enumerate(cells)]
        out.append(Surveyed(path, encoding, best.get(path, 0), header, frozenset(b["block"] for b in blocks), inside, at, state))
    return out


def records(spark: SparkSession, paths: Sequence[str], files: Sequence[Surveyed]) -> DataFrame:
    """(path, cells) of every record below its file's header; empty lines are left out. ``paths`` are those that were surveyed, ``files`` what was found."""
    known = {f.path: f for f in files}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: tuple[str, int] | None = None
        inside, pending, head, begun, number = False, b"", None, 0, 0
        pieces: list[tuple] = []
        kinds = pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        names = ["path", "cells", "head", "block", "line", "piece"]

        def done(path: str, cells: pa.Array) -> pa.RecordBatch:
            n = len(cells)
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), cells, *[pa.nulls(n, k) for k in kinds[2:]]], names=names)

        def close() -> None:
            """What is open at a block's end belongs to the block in which it begins."""
            if where and inside:
                pieces.append((where[0], None, where[1] if head is None else head, where[1], begun if head is None else None, pending))

        for batch in batches:
            values = batch.column("value")
            for path, block, i, j in runs(batch):
                file = known.get(path)
                if file is None or file.encoding is None:
                    continue
                if where != (path, block):
                    close()
                    where, number, pending = (path, block), 0, b""
                    if block not in file.blocks:
                        raise ValueError(f"{path} was not cut at {block} when it was surveyed: read it again")
                    inside, head = block in file.inside, file.inside.get(block)
                part, text = values.slice(i, j - i), decoder(file.encoding)
                if block == 0 and number == 0:
                    part = pa.concat_arrays([pa.array([part[0].as_py().removeprefix(MARK)], part.type), part.slice(1)])
                if not inside and not pc.any(quoted(part)).as_py():
                    skip = max(0, min(len(part), file.at[1] + 1 - number)) if block == file.at[0] else len(part) if block < file.at[0] else 0
                    number += len(part)
                    own = part.slice(skip)
                    own = own.filter(pc.greater(pc.binary_length(own), 0))
                    lines = own.cast(pa.string()) if file.encoding.upper() == "UTF-8" else pa.array([text(v) for v in own.to_pylist()], pa.string())
                    lines = pc.utf8_rtrim(lines, "\r")
                    yield done(path, pc.split_pattern(lines.filter(pc.not_equal(lines, "")), ","))
                    continue
                whole = []
                for value in part.to_pylist():
                    for line, end in ends(value):
                        if not inside:
                            pending, head, begun = b"", None, number
                        number += 1
                        was, inside = inside, inside_after(line, inside) if b'"' in line else inside
                        pending += line + (end if inside else b"")
                        if inside:
                            continue
                        if was and head is not None:
                            pieces.append((path, None, head, block, None, pending))
                        elif (block, begun) > file.at and pending:
                            whole.append(text(pending))
                        head = None
                yield done(path, pa.array(cut(whole), pa.list_(pa.string())))
        close()
        columns = list(zip(*pieces)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, cut([decoder(known[p].encoding)(b"".join(x["piece"] for x in parts))])[0]) for p, head, parts in zip(*[batch.column(c).to_pylist() for c in ("path", "head", "parts")]) if (head, parts[0]["line"]) > known[p].at]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["path", "cells"])

    if not files:
        return spark.createDataFrame([], "path string, cells array<string>")
    every = physical(spark, paths).mapInArrow(run, CUT)
    whole = every.where("piece is null").select("path", "cells")
    if not any(f.inside or f.unclosed for f in files):
        return whole
    parts = every.where("piece is not null").groupBy("path", "head").agg(F.sort_array(F.collect_list(F.struct("block", "line", "piece"))).alias("parts"))
    return whole.unionByName(parts.mapInArrow(joined, "path string, cells array<string>"))
