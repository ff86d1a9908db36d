"""Counterfactual-regularised toxicity classifier on hashed words and word beginnings.

A labelled text that mentions an identity term is also read with each such term
swapped for another; the loss adds ``penalty`` times the squared change of the
score, so that mentions of groups as such do not raise it. Features: distinct
words and their first 4 to 7 bytes, lower-cased A-Z, hashed into 2**20 cells.

Fitting takes a bounded sample: the ``sample_rows`` labelled rows whose hashed
id is smallest. Labels, languages, sources and ids are no inputs of a score.

Defined cases: null or empty texts score by the intercept alone; labels that
are null are left out; without labels every score is 0.5; of a repeated label
id the higher label counts; repeated documents are scored each for itself and
weigh once each in the fit; very long texts are read whole, in slices of whole
texts; an empty table gives no rows; columns other than doc_id and text are not
read, whatever their names. Terms are found in any case, with letters that fold
to theirs too (long s, Kelvin sign, dotted and dotless i).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .textops import NOT_ALNUM, U, distinct, mix, prefix_hashes, slices, span_hashes, strings, words

BITS = 20
#: Neutral group terms that may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"), ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
)
_SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, t in enumerate(group)}


def folded(term: str) -> str:
    """The term in lower case, its long s, Kelvin sign and dotted or dotless i as s, k and i."""
    return term.casefold().replace("i\u0307", "i").replace("\u0131", "i")


def swapped(text: str) -> str | None:
    """The text with every identity term swapped for the next of its group, or None if it has none."""
    import regex

    out, n = regex.subn(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", lambda m: _SWAP[folded(m[0])], text, flags=regex.IGNORECASE)
    return out if n else None


def cells(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, cell); only the wanted cells if given."""
    starts, ends, first = words(data, offsets, NOT_ALNUM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    prefix = prefix_hashes(data)
    owners, found = [], []
    for size in (0, 4, 5, 6, 7):
        if size:
            long = ends - starts > size
            value, owner = mix(span_hashes(prefix, starts[long], starts[long] + size) + U(size)), text[long]
        else:
            value, owner = span_hashes(prefix, starts, ends), text
        cell = (value >> U(64 - BITS)).astype(np.int64)
        if wanted is not None:
            keep = wanted[cell]
            owner, cell = owner[keep], cell[keep]
        owners.append(owner)
        found.append(cell)
    return distinct(np.concatenate(owners), np.concatenate(found))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, intercept) from (doc_id, toxic) labels."""
    sample = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            owner, cell = cells(data, offsets)
            at = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            other = [swapped(t or "") for t in rows.column("text").to_pylist()]
            other_owner, other_cell = cells(*strings(pa.array(other, pa.string())))
            own = np.searchsorted(other_owner, np.arange(rows.num_rows + 1))
            lists = [other_cell[own[i] : own[i + 1]] if t is not None else None for i, t in enumerate(other)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cell, pa.int32())), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "cells", "swapped"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        held = pa.Table.from_batches(batches).combine_chunks()
        lists = held.column("cells").chunk(0)
        row = np.repeat(np.arange(held.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy().astype(np.int64)
        pair, at, sign = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, other in enumerate(held.column("swapped").to_pylist()):
            if other is not None:
                own = lists[i].as_py()
                gone, come = np.setdiff1d(own, other), np.setdiff1d(other, own)
                pair.append(np.full(len(gone) + len(come), len(pair) - 1))
                at.append(np.concatenate([gone, come]).astype(np.int64))
                sign.append(np.concatenate([np.ones(len(gone)), -np.ones(len(come))]))
        w, theta = linear.fit(row, flat, np.ones(len(flat), np.float32), held.column("toxic").to_numpy().clip(0, 1).astype(np.int64), 2, 1 << BITS, np.concatenate(pair), np.concatenate(at), np.concatenate(sign), penalty)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at].astype(np.float64), -theta[0]))], names=["cell", "weight"])

    # The sample's size is bounded by sample_rows, so it may be broadcast and fitted in one task.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    model = rows.mapInArrow(featured, "doc_id long, toxic int, cells array<int>, swapped array<int>").repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "cell long, weight double").collect()
    weights, intercept = np.zeros(1 << BITS, np.float32), 0.0
    for cell, weight in model:
        if cell >= 0:
            weights[cell] = weight
        else:
            intercept = weight
    return weights, intercept


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score)."""
    weights, intercept = model
    kept = np.flatnonzero(weights)
    strength = weights[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BITS, np.float32)
        full[kept] = strength
        wanted = full != 0
        for rows, data, offsets in slices(batches):
            owner, cell = cells(data, offsets, wanted)
            s = np.bincount(owner, full[cell], minlength=rows.num_rows) + intercept
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(linear.sigmoid(s))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
