"""Ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all grades; ordered thresholds turn the score
into P(grade >= k), of which the expected grade is the sum. Features of a text:
its words, each word's shape (which kinds of characters, how it ends), whether
words repeat the one before, hashed into 2**18 cells; a cell's value is the
square root of its share of the words.

Fitting takes a bounded sample: the ``sample_rows`` labelled rows whose hashed
id is smallest (all, where there are fewer). Everything else sees all rows.

Defined cases: null or empty texts have no features and are graded by the
thresholds alone; ratings whose grade is null are left out of the fit; without
any rating every row is kept; of a repeated label id the highest grade counts;
repeated documents are scored each for itself; very long texts are read whole,
in slices of whole texts; an empty table gives no rows; extra columns stay, and
the column that ``score`` adds is named by the caller, so none clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .textops import SPACE, U, mix, prefix_hashes, slices, span_hashes, words

BITS = 18
_KIND = np.full(256, 1, np.uint8)  # symbols
_KIND[48:58] = 2
_KIND[65:91] = 4
_KIND[97:123] = 8
_KIND[128:] = 16
_KIND[list(b".,;:?'\"()-")] = 32
_KIND[list(b"!")] = 64


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 good quality but toxic, 2 good and not toxic."""
    rated = labels.where("quality is not null and toxic is not null")
    return rated.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell) of every feature occurrence, and the words of each text."""
    starts, ends, first = words(data, offsets, SPACE)
    counts = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    text = np.repeat(np.arange(len(counts)), counts)
    prefix = prefix_hashes(data, lower=False)
    word = span_hashes(prefix, starts, ends)
    # Words never touch, so the kinds of each lie between its start and the next.
    kinds = np.bitwise_or.reduceat(np.where(SPACE[data], 0, _KIND[data]).astype(np.uint8), starts)
    shape = mix((kinds.astype(U) << U(16)) + (_KIND[data[starts]].astype(U) << U(8)) + _KIND[data[ends - 1]] + U(1 << 40))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    owner = np.concatenate([text, text, text[again]])
    value = np.concatenate([word, shape, np.full(int(again.sum()), 7, U)])
    return owner, (value & U((1 << BITS) - 1)).astype(np.int64), counts


def values(owner: np.ndarray, cell: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, n = np.unique((owner << BITS) | cell, return_counts=True)
    owner = both >> BITS
    return owner, both & ((1 << BITS) - 1), np.sqrt(n / np.maximum(1, counts[owner]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from the sampled ratings (doc_id, grade)."""
    sample = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            owner, cell, value = values(*cells(data, offsets))
            at = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("grade"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cell, pa.int32())), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value, pa.float32()))], names=["doc_id", "grade", "cells", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        held = pa.Table.from_batches(batches).combine_chunks()
        row = np.repeat(np.arange(held.num_rows), np.diff(held.column("cells").chunk(0).offsets.to_numpy()))
        w, theta = linear.fit(row, held.column("cells").chunk(0).flatten().to_numpy().astype(np.int64), held.column("values").chunk(0).flatten().to_numpy(), held.column("grade").to_numpy().astype(np.int64), n_grades, 1 << BITS)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - np.arange(len(theta))])), pa.array(np.concatenate([w[at].astype(np.float64), theta]))], names=["cell", "weight"])

    # The sample's size is bounded by sample_rows, so it may be broadcast and fitted in one task.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    model = rows.mapInArrow(featured, "doc_id long, grade int, cells array<int>, values array<float>").repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "cell long, weight double").collect()
    weights, thresholds = np.zeros(1 << BITS, np.float32), np.full(n_grades - 1, -np.inf)
    for cell, weight in model:
        if cell >= 0:
            weights[cell] = weight
        else:
            thresholds[-1 - cell] = weight
    return weights, thresholds


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "tails") -> DataFrame:
    """All columns of ``docs`` and ``name``: P(grade >= k) for k = 1, 2, ..., whose sum is the expected grade."""
    weights, thresholds = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            owner, cell, counts = cells(data, offsets)
            known = weights[cell] != 0
            owner, cell, value = values(owner[known], cell[known], counts)
            s = np.bincount(owner, value * weights[cell], minlength=rows.num_rows)
            tails = linear.sigmoid(s[:, None] - thresholds[None, :])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.FixedSizeListArray.from_arrays(pa.array(tails.ravel()), len(thresholds)).cast(pa.list_(pa.float64()))], names=[*rows.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def expected_grade(name: str = "tails") -> Column:
    return F.aggregate(name, F.lit(0.0), lambda a, x: a + x)


def selected(k: int = 1, least: float = 0.5, name: str = "tails") -> Column:
    """Rows whose P(grade >= k) is at least ``least``."""
    return F.get(name, F.lit(k - 1)) >= least
