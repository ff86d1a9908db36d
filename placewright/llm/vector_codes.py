"""Vector code compression: product quantisation in integers, searched with ball trees.

Components become integers, floor(``SCALE`` * x). A vector is cut into ``PARTS``
equal parts; each part position has a codebook of ``ENTRIES`` entries, fitted by
``ROUNDS`` rounds of assigning parts to their nearest entry (least squared
distance, ties to the lower index) and replacing each entry by the floor of its
parts' mean.

Entries of a part position form a ball tree: a node has a centre, which is an
entry, and a radius, rounded up; leaves hold a few entries. A search goes down
the nearer child first and skips a ball only if its nearest point is surely
farther than the best found: bounds are rounded towards visiting, and a ball
that may tie is visited. Distances that decide are integers.

A round broadcasts the codebooks, whose size does not depend on the data, and
returns counts and sums of each entry, added up in each task and then by Spark,
so no key is hot: entries times parts rows reach the driver.

Defined cases: null vectors and those with null or non-finite components are
dropped; vectors must agree in length, a multiple of ``PARTS``, and components
lie within 2**27 of 0 after scaling, as a long could not hold the sums otherwise
(ValueError); fewer vectors than ``ENTRIES`` make fewer entries; rows without
vec_id come after all others, ties by their components; repeated rows count each
for itself; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import nextafter, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, PARTS, ENTRIES, ROUNDS, LEAF = 4096, 8, 16, 6, 3
LIMIT = 1 << 27
#: Relative room for the rounding of square roots, which is far smaller.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is whole and finite."""
    big = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~big)


def integers(vectors: pa.Array) -> np.ndarray:
    """Vectors x components as integers."""
    if not len(vectors):
        return np.zeros((0, 0), np.int64)
    width = len(vectors[0])
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if width % PARTS or len(flat) != width * len(vectors) or any(np.diff(vectors.offsets.to_numpy()) != width):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    x = np.floor(flat * SCALE)
    if np.abs(x).max(initial=0) > LIMIT:
        raise ValueError("a component is too large for integer codes")
    return x.astype(np.int64).reshape(len(vectors), width)


@dataclass
class Ball:
    """A node: its entries' numbers, the centre (one of the entries), a radius that surely covers them, and its children."""

    members: list[int]
    centre: np.ndarray
    radius: float
    children: list[Ball] = field(default_factory=list)


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((points - centre) ** 2).sum(axis=-1)


def ball(entries: np.ndarray, members: list[int]) -> Ball:
    """The tree over some entries: two entries far apart draw the others to the nearer of them."""
    own = entries[members]
    middle = members[int(np.argmin([int(squares(own, p).max()) for p in own]))]
    radius = nextafter(sqrt(int(squares(own, entries[middle]).max())) * (1 + SLACK), float("inf"))
    node = Ball(members, entries[middle], radius)
    if len(members) > LEAF and radius > 0:
        a = int(np.argmax(squares(own, entries[middle])))
        b = int(np.argmax(squares(own, own[a])))
        nearer = squares(own, own[a]) <= squares(own, own[b])
        if nearer.any() and not nearer.all():
            node.children = [ball(entries, [m for m, x in zip(members, nearer) if x == side]) for side in (True, False)]
    return node


def nearest(points: np.ndarray, entries: np.ndarray, tree: Ball, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties to the lower number) and its squared distance. ``visits`` gathers how many distances leaves took."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(entries))

    def visit(node: Ball, rows: np.ndarray, away: np.ndarray) -> None:
        """Rows with the squared distance of each to the node's centre."""
        near = np.sqrt(away.astype(np.float64)) * (1 - SLACK) - node.radius
        keep = near <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
        rows, away = rows[keep], away[keep]
        if not len(rows):
            return
        if not node.children:
            for m in node.members:
                d = squares(points[rows], entries[m])
                closer = (d < best[rows]) | ((d == best[rows]) & (m < index[rows]))
                best[rows[closer]], index[rows[closer]] = d[closer], m
            if visits is not None:
                visits.append(len(rows) * len(node.members))
            return
        left, right = node.children
        to_left, to_right = squares(points[rows], left.centre), squares(points[rows], right.centre)
        first = to_left <= to_right
        visit(left, rows[first], to_left[first])
        visit(right, rows[~first], to_right[~first])
        visit(right, rows[first], to_right[first])
        visit(left, rows[~first], to_left[~first])

    visit(tree, np.arange(len(points)), squares(points, tree.centre))
    return index, best


def assigned(x: np.ndarray, books: np.ndarray, trees: list[Ball]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances, vectors x parts."""
    parts = x.reshape(len(x), len(books), -1)
    both = [nearest(parts[:, p], books[p], trees[p]) for p in range(len(books))]
    return np.stack([b[0] for b in both], axis=1), np.stack([b[1] for b in both], axis=1)


def grown(books: np.ndarray) -> list[Ball]:
    return [ball(entries, list(range(len(entries)))) for entries in books]


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks, parts x entries x components; None without vectors."""
    rows = usable(vectors).select("vec_id", "embedding")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()  # as many rows as entries
    if not first:
        return None
    x = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())))
    books = np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = updated(rows, books)
    return books


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    width = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = grown(books)
        count = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for batch in batches:
            x = integers(batch.column("embedding"))
            if not len(x):
                continue
            if x.shape[1] != books.shape[0] * width:
                raise ValueError("vectors must have one length")
            index, _ = assigned(x, books, trees)
            parts = x.reshape(len(x), PARTS, width)
            for p in range(PARTS):
                count[p] += np.bincount(index[:, p], minlength=books.shape[1])
                np.add.at(total[p], index[:, p], parts[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    per_task = rows.select("embedding").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    # Sums of all tasks may need more than 64 bits.
    added = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for r in added.collect():  # parts x entries rows
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def encode(vectors: DataFrame, books: np.ndarray | None) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to the entries."""
    rows = usable(vectors).select("vec_id", "label", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = grown(books)
        for batch in batches:
            x = integers(batch.column("embedding"))
            if len(x):
                index, away = assigned(x, books, trees)
                code = [r.tobytes().hex() for r in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(away.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, embedding): the vectors that codes stand for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(c) / SCALE) for c in e]) for e in part]) for part in books])
    number = lambda p: F.conv(F.substr("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return codes.select("vec_id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(table, p), number(p)))).alias("embedding"))


def digest(books: np.ndarray | None) -> str:
    """Of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in (books.ravel() if books is not None else ())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, salts: int = 16) -> DataFrame:
    """The rows with ``label_error``, the errors of all rows of the label (null is one); a label's rows meet its sum in ``salts`` places."""
    per_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    spread = per_label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = coded.withColumn("salt_", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt_") == F.col("salt")))
    return joined.drop("of", "salt", "salt_")
