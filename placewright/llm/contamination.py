"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of shards, written to the shared folder, each of a bounded
number of training tokens: its documents, its distinct terms (64-bit hashes) and
for each term the sorted positions at which it stands. A search takes the test phrases shard by shard:
a phrase's terms are ordered by their number of postings, the rarest list gives
the candidate starts (position less the term's place in the phrase), and each
further list is intersected with them, so most phrases end at their first or
second list. Phrases never cross documents because the positions of two
documents never follow one another. Shards are independent: nothing is
shuffled, and a hot document or term stays in its shard.

Test items are broadcast only below ``BROADCAST_BYTES``; a larger benchmark is
searched in blocks of items, each below it, all in the one stored index.

Defined cases: null texts have no words and match nothing; items without words
match nothing; a document that holds an item twice counts its words once;
repeated documents and items each count for themselves (an item id once); an
empty table gives no rows, an empty benchmark no hits; extra columns of the
documents are not read, and ``decontaminated`` rows keep theirs (names that
clash are evaded).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, kept
from .textops import NOT_ALNUM, U, longs, slices, word_hashes, words

WINDOW = 13
BROADCAST_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
SHARDS = "shard long, doc_ids array<long>, n_words array<int>, terms binary, ends binary, positions binary"
#: Positions left free between documents, and the widest ``slop``.
GAP = 64


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, distinct terms, the end of each term's list, and all lists: one shard."""
    starts, ends, first = words(data, offsets, NOT_ALNUM)
    n = np.diff(first)
    hashes = word_hashes(data, starts, ends)
    position = np.arange(len(hashes)) + np.repeat(np.arange(len(n)) * GAP, n)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    last = np.ones(len(hashes), bool)
    last[:-1] = hashes[1:] != hashes[:-1]
    return n, hashes[last], (np.flatnonzero(last) + 1).astype(np.int32), position[order].astype(np.int32)


def build_index(docs: DataFrame) -> DataFrame:
    """Shards of the positional index; write them with ``.write.parquet`` to search them again later. A shard's number is that of its task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rows, data, offsets in slices(batches, limit=SHARD_BYTES):
            n, terms, ends, positions = postings(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in (terms, ends, positions))],
                names=["shard", "doc_ids", "n_words", "terms", "ends", "positions"],
            )
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, SHARDS)


class Shard:
    """One row of the index."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray) -> None:
        self.n_words, self.terms, self.ends, self.positions = n_words, terms, ends, positions
        self.first = np.concatenate([[0], np.cumsum(self.n_words + GAP)])

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each term's postings (equal where there are none)."""
        if not len(self.terms):
            z = np.zeros(len(terms), np.int64)
            return z, z
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        end = self.ends[k].astype(np.int64)
        begin = np.where(k > 0, self.ends[k - 1], 0)
        return np.where(self.terms[k] == terms, begin, end), end

    def phrase(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts at which the terms stand one after another."""
        order = np.argsort(ends - begins, kind="stable")
        at = self.positions[begins[order[0]] : ends[order[0]]] - order[0]
        for k in order[1:]:
            if not len(at):
                break
            other = self.positions[begins[k] : ends[k]]
            place = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
            at = at[other[place] == at + k]
        return at

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def phrases(items: list[tuple[object, str | None]], size: int = WINDOW) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(item, hashes of its words, starts of its windows); items without words are left out."""
    out = []
    data = [t or "" for _, t in items]
    for (item, _), text in zip(items, data):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]), NOT_ALNUM)
        if len(starts):
            out.append((item, word_hashes(raw, starts, ends), np.arange(max(1, len(starts) - size + 1))))
    return out


class Phrases:
    """Test items with their windows, looked up in one shard after another."""

    def __init__(self, items: list[tuple[object, str | None]], size: int, slop: int = 0, anchors: int = 3) -> None:
        self.tests, self.size, self.slop, self.anchors = phrases(items, size), size, slop, anchors
        self.every = np.concatenate([h for _, h, _ in self.tests]) if self.tests else np.zeros(0, U)
        self.at = np.concatenate([[0], np.cumsum([len(h) for _, h, _ in self.tests])]).astype(np.int64)

    def search(self, shard: Shard) -> tuple[np.ndarray, list[list[str]], list[list[list[int]]], list[list[str]]]:
        """For each document of the shard: hit words, items with an occurring window, hit spans, items near by."""
        n, at = len(shard.n_words), self.at
        begins, ends = shard.lookup(self.every)
        there = ends > begins
        found: list[set] = [set() for _ in range(n)]
        near: list[set] = [set() for _ in range(n)]
        change = np.zeros(int(shard.first[-1]) + 1, np.int32)
        for k, (item, h, windows) in enumerate(self.tests):
            b, e = begins[at[k] : at[k + 1]], ends[at[k] : at[k + 1]]
            w = min(self.size, len(h))
            missing = np.concatenate([[0], np.cumsum(~there[at[k] : at[k + 1]])])
            for s in windows[missing[windows + w] == missing[windows]]:
                starts = shard.phrase(b[s : s + w], e[s : s + w])
                if len(starts):
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + w, -1)
                    for d in np.unique(shard.document(starts)):
                        found[d].add(item)
            if self.slop and there[at[k] : at[k + 1]].all():
                for d in proximity(shard, b, e, min(self.anchors, len(h)), self.slop):
                    near[d].add(item)
        hit = np.cumsum(change) > 0
        counts = np.concatenate([[0], np.cumsum(hit)])
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        spans: list[list] = [[] for _ in range(n)]
        for d, x, y in zip(shard.document(lo), lo, hi):
            spans[d].append([int(x - shard.first[d]), int(y - shard.first[d])])
        return counts[shard.first[1:]] - counts[shard.first[:-1]], [sorted(map(str, x)) for x in found], spans, [sorted(map(str, x)) for x in near]


def search(index: DataFrame, items: list[tuple[object, str | None]], size: int = WINDOW, slop: int = 0, anchors: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, near) for every indexed document.

    ``items``: those with an occurring window; ``spans``: the hit words as
    [begin, end) in words. With ``slop``, ``near`` lists the items whose
    ``anchors`` rarest terms all stand within ``slop`` words of each other.
    """
    return _search(index, items, size, slop, anchors).drop("shard", "place")


def _search(index: DataFrame, items: list[tuple[object, str | None]], size: int, slop: int, anchors: int = 3) -> DataFrame:
    """``search`` with each document's shard and place in it."""
    if slop > GAP:
        raise ValueError(f"slop is {slop}, documents lie {GAP} words apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Phrases(items, size, slop, anchors)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(np.array(row["n_words"], np.int64), *(np.frombuffer(row[k], t) for k, t in (("terms", U), ("ends", np.int32), ("positions", np.int32))))
                n_hit, found, spans, near = tests.search(shard)
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(n_hit), pa.int64()), pa.array(np.arange(len(n_hit))), pa.array(row["doc_ids"], pa.int64()), pa.array(shard.n_words), pa.array(n_hit.astype(np.int64)), pa.array(found, text), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(near, text)],
                    names=["shard", "place", "doc_id", "n_words", "n_hit", "items", "spans", "near"],
                )

    return index.mapInArrow(run, "shard long, place long, doc_id long, n_words long, n_hit long, items array<string>, spans array<array<int>>, near array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept; each batch is a shard that is indexed and searched in place."""
    items = benchmark.select("item_id", "text").where("item_id is not null")
    total = items.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if total > BROADCAST_BYTES:
        # Written, so that a row's number stays the same when a task is run again.
        name = fresh(docs.columns, "row")
        numbered = kept(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
        found = find(numbered.select(F.col(name).alias("doc_id"), "text"), benchmark, size).where(contaminated())
        return numbered.join(found.select(F.col("doc_id").alias(name)), name, "left_anti").select(docs.columns)
    tests = [tuple(r) for r in items.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Phrases(tests, size)
        for rows, data, offsets in slices(batches, limit=SHARD_BYTES):
            shard = Shard(*postings(data, offsets))
            n_hit = look.search(shard)[0]
            yield rows.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= shard.n_words))))

    return docs.mapInArrow(run, docs.schema)


def proximity(shard: Shard, begins: np.ndarray, ends: np.ndarray, anchors: int, slop: int) -> np.ndarray:
    """Documents in which the ``anchors`` rarest terms stand within ``slop`` words of an occurrence of the rarest."""
    order = np.argsort(ends - begins, kind="stable")[:anchors]
    at = shard.positions[begins[order[0]] : ends[order[0]]]
    for k in order[1:]:
        other = shard.positions[begins[k] : ends[k]]
        place = np.searchsorted(other, at - slop)
        at = at[(place < len(other)) & (other[np.minimum(place, len(other) - 1)] <= at + slop)]
    return np.unique(shard.document(at))


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """``search`` of all documents for all items of a benchmark (item_id, text)."""
    items = benchmark.select("item_id", "text").where("item_id is not null")
    total = items.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // BROADCAST_BYTES) or 1
    index = kept(build_index(docs), "index")
    if blocks == 1:
        return search(index, [tuple(r) for r in items.collect()], size, slop)
    # Too large to broadcast at once: the index is searched in blocks of items, then the blocks' hits are joined.
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = [_search(index, [tuple(r) for r in items.where(block == k).collect()], size, slop) for k in range(blocks)]
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = reduce(DataFrame.unionByName, parts).groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), flat("items").alias("items"), flat("spans").alias("hits"), flat("near").alias("near"))

    def joined(out: Column, s: Column) -> Column:
        """Sorted spans with those that meet made one."""
        tail = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.array(tail[0], F.greatest(tail[1], s[1]))))
        return F.when((F.size(out) > 0) & (s[0] <= tail[1]), longer).otherwise(F.concat(out, F.array(s)))

    spans = F.aggregate("hits", F.expr("cast(array() as array<array<int>>)"), joined)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return merged.withColumn("spans", spans).select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", "near")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def plain_words(text: str) -> list[str]:
    """The words of a text, for tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
