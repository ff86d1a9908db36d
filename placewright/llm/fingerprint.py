"""One-permutation MinHash fingerprints with optimal densification and b-bit packing.

A text's set is its distinct shingles of five words (``[^\x20\x09-\x0D]+``,
lower-cased A-Z); a text of fewer words has its whole sequence as one. Each
shingle is hashed once: the high bits choose one of ``BINS`` bins, the bin
keeps the smallest rest. An empty bin copies a full one found by its own
sequence of hashes (optimal densification), and each bin keeps its low
``BITS`` bits. Likeness counts equal bins and takes off the share that agrees
by chance.

Defined cases: null and wordless texts have the fingerprint of the empty set
("" packed as no bins), which is like itself (1) and unlike all others (0);
equal texts have equal fingerprints; repeated rows are fingerprinted each for
itself; an empty table gives no rows; columns other than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import kept
from .textops import SPACE, U, mix, shingles, slices, strings, word_hashes, words

BINS, BITS, WORDS = 256, 4, 5


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of every bin (texts x BINS), and which texts have any shingle."""
    out, some = [], []
    for _, data, offsets in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        starts, ends, first = words(data, offsets, SPACE)
        owner, value = shingles(word_hashes(data, starts, ends), first, WORDS)
        n = len(offsets) - 1
        bins = np.full(n * BINS, ~U(0), U)
        np.minimum.at(bins, owner * BINS + (value >> U(64 - 8)).astype(np.int64), value & U((1 << 56) - 1))
        bins = bins.reshape(n, BINS)
        empty = bins == ~U(0)
        any_full = ~empty.all(axis=1)
        row, col = np.nonzero(empty & any_full[:, None])
        attempt = 0
        while len(row):
            attempt += 1
            source = (mix(col.astype(U) * U(0x10001) + U(attempt << 32)) % U(BINS)).astype(np.int64)
            found = ~empty[row, source]
            bins[row[found], col[found]] = bins[row[found], source[found]]
            row, col = row[~found], col[~found]
        out.append((bins & U((1 << BITS) - 1)).astype(np.uint8))
        some.append(any_full)
    if not out:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(some)


def packed_bytes(bits: np.ndarray, some: np.ndarray) -> list[bytes]:
    """The packed low bits; empty for the empty set."""
    both = (bits[:, 0::2] << 4) | bits[:, 1::2]
    return [b.tobytes() if s else b"" for b, s in zip(both, some)]


def packed(bits: np.ndarray, some: np.ndarray) -> list[str]:
    """The same as hex text."""
    return [b.hex() for b in packed_bytes(bits, some)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of two rows of fingerprints, 0 to 1."""
    chance = 1 / (1 << BITS)
    agree = (a == b).mean(axis=1)
    out = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, out, np.where(a_some | b_some, 0.0, 1.0))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(packed(*fingerprints(pc.fill_null(rows.column("text"), ""))), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


DIGESTS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def digests(ids: list, texts: list[str], following: list[str], in_turn: bool) -> pa.RecordBatch:
    """The rows of texts and those that follow them; ``in_turn`` if each text follows the one before."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
    a, a_some = fingerprints(pa.array(texts, pa.string()))
    e, e_some = fingerprints(pa.array(edited, pa.string()))
    f, f_some = fingerprints(pa.array(following[-1:] if in_turn else following, pa.string()))
    if in_turn:
        f, f_some = np.concatenate([a[1:], f]), np.concatenate([a_some[1:], f_some])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()), pa.array(packed_bytes(a, a_some), pa.binary()), pa.array(packed_bytes(e, e_some), pa.binary()), pa.array(likeness(a, a_some, e, e_some), pa.float64()), pa.array(likeness(a, a_some, f, f_some), pa.float64())],
        names=[c.split()[0] for c in DIGESTS.split(", ")],
    )


def compare(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and their likenesses.

    The edited text has the last half of the code points replaced by the first
    as many of the next document by id (the first document follows the last; a
    lone document follows itself). Rows of one id follow each other by text.

    Documents are dealt over tasks by ranges of ids and sorted there. A task's
    last document is followed by the first of the next task that has any: both
    ends of each task are written with the rows, and the ends are paired by an
    equi-join, so nothing but task numbers is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows(found: pa.RecordBatch) -> pa.RecordBatch:
            n = found.num_rows
            return pa.RecordBatch.from_arrays([*found.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*found.schema.names, "part", "place", "text"])

        def end(doc: int | None, place: str, text: str) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *none, pa.array([part], pa.int32()), pa.array([place]), pa.array([text])], names=[*(c.split()[0] for c in DIGESTS.split(", ")), "part", "place", "text"])

        held, size, begun = [], 0, False
        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                text = text or ""
                if not begun:
                    begun = True
                    yield end(doc, "first", text)
                held.append((doc, text))
                size += len(text)
                if len(held) > 1 and size > 1 << 20:
                    yield rows(digests([d for d, _ in held[:-1]], [t for _, t in held[:-1]], [t for _, t in held[1:]], True))
                    held, size = held[-1:], len(text)
        if len(held) > 1:
            yield rows(digests([d for d, _ in held[:-1]], [t for _, t in held[:-1]], [t for _, t in held[1:]], True))
        if held:
            yield end(*held[-1][:1], "last", held[-1][1])

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                yield digests(*(c.to_pylist() for c in some.columns), False)

    order = F.col("doc_id").asc_nulls_first()
    ranges = docs.select("doc_id", "text").repartitionByRange(order).sortWithinPartitions(order, "text")
    found = kept(ranges.mapInArrow(run, f"{DIGESTS}, part int, place string, text string"), "fingerprints")
    # One row for each task: its number and that of the next.
    every = Window.orderBy("part")
    tasks = found.where("place = 'first'").select("part").withColumn("next", F.coalesce(F.lead("part").over(every), F.first("part").over(every)))
    last = found.where("place = 'last'").select("part", "doc_id", "text").join(tasks, "part")
    first = found.where("place = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = last.join(first, "next").select("doc_id", "text", "following").mapInArrow(closing, DIGESTS)
    every_row = found.where("place is null").drop("part", "place", "text").unionByName(ends)
    return every_row.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
