"""Exact removal of long repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else goes. Documents with equal texts are handled once, by the MD5 of the text.

1. In every window of LENGTH bytes the position whose ``GRAM`` bytes hash
   smallest is the window's anchor, so equal windows have equal anchors at equal
   distances. About one byte in 170 is an anchor. The grams of each distinct text
   are counted; texts with a gram that stands more than once find its anchors
   again and send the bytes of the windows these serve.
2. The suffixes that begin at the anchors of one gram are merge-sorted. Two of
   them are compared at their first difference, found by binary search over
   prefix polynomial hashes. Windows of one distance to the anchor are equal if
   their right parts share an interval of the sorted suffixes and their left
   parts one hash; every run of equal windows is verified byte by byte at both
   ends.
3. A gram of more than ``hot`` anchors is not gathered in one task: its distinct
   windows of each text become rows (gram, hash of LENGTH bytes, digest of the
   same bytes) with their number, summed before the shuffle. Windows are equal if
   both agree, so a collision of the polynomial hash is caught by the independent
   BLAKE2 digest. Windows that repeat within a text need no other and are compared
   byte by byte; text of one short period has few distinct ones.

Defined cases: null texts are empty; texts shorter than LENGTH keep everything;
repeated rows and equal texts of LENGTH bytes or more are removed whole, the
first one too, as strings are judged on the input; an empty table gives no rows;
columns other than the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept
from .textops import U, longs, powers, prefix_hashes, slices, span_hashes

LENGTH, GRAM = 400, 64
WIDTH = LENGTH - GRAM + 1
#: A text has fewer bytes than 2 to this power.
POSITION_BITS = 31


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (leftmost of equals) value in every window."""
    n = len(hashes)
    value = (hashes >> U(POSITION_BITS)) << U(POSITION_BITS) | np.arange(n, dtype=U)
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~U(0), U)
    padded[:n] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & U((1 << POSITION_BITS) - 1)).astype(np.int64)


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first window, last window) for every run of windows with one anchor; positions in the text."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    prefix = prefix_hashes(data, lower=False)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(prefix, at, at + GRAM)
    anchor = sliding_argmin(grams, WIDTH)
    start = np.arange(len(anchor))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + LENGTH <= offsets[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(start) - 1) if len(first) else first
    base = offsets[text[first]]
    return text[first], grams[anchor[first]], anchor[first] - base, start[first] - base, start[last] - base


def grams(docs: DataFrame) -> DataFrame:
    """(text_key, keys): the anchors' gram hashes of each text, as often as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            text, keys, *_ = find_anchors(data, offsets)
            at = pa.array(np.searchsorted(text, np.arange(rows.num_rows + 1)), pa.int32())
            sums = [hashlib.md5(data[offsets[i] : offsets[i + 1]]).digest() for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.binary()), pa.ListArray.from_arrays(at, longs(keys))], names=["text_key", "keys"])

    return docs.select("text").mapInArrow(run, "text_key binary, keys array<long>")


class Suffixes:
    """Sorted suffixes of one buffer: ``begin`` to ``end`` each, within groups of consecutive items."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray) -> None:
        self.data, self.begin, self.end, self.group = data, begin, end, group
        self.prefix = prefix_hashes(data, lower=False)
        self.power, _ = powers(len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes a and b, by binary search on hashes."""
        x, y = self.begin[a], self.begin[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.end[a] - x, self.end[b] - y)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = (self.prefix[x + mid] - self.prefix[x]) * self.power[y] == (self.prefix[y + mid] - self.prefix[y]) * self.power[x]
            low, high = np.where(same & open_, mid, low), np.where(same | ~open_, high, mid - 1)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; at most a logarithm of hash comparisons each."""
        n = self.common(a, b)
        x, y = self.begin[a] + n, self.begin[b] + n
        a_ends, b_ends = x >= self.end[a], y >= self.end[b]
        last = len(self.data) - 1
        less = self.data[np.minimum(x, last)] < self.data[np.minimum(y, last)]
        return np.where(a_ends, ~b_ends | (a < b), ~b_ends & less)

    def sort(self) -> np.ndarray:
        """Items in suffix order within each group, by bottom-up merging of all groups at once."""
        n = len(self.begin)
        order = np.arange(n)
        starts = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        size = np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            place = np.arange(n)
            rel = place - first
            run = rel // width
            left = run % 2 == 0
            other = first + np.where(left, run + 1, run - 1) * width
            stop = np.minimum(other + width, first + size)
            has = other < first + size
            at = np.flatnonzero(has)
            low, high = other[at].copy(), stop[at].copy()
            mine = order[at]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                rank_above = self.before(order[mid], mine[open_])
                low[open_[rank_above]] = mid[rank_above] + 1
                high[open_[~rank_above]] = mid[~rank_above]
            to = place.copy()
            pair_start = first + (run // 2) * 2 * width
            own = rel - run * width
            to[at] = pair_start[at] + own[at] + (low - other[at])
            merged = np.empty_like(order)
            merged[to] = order
            order = merged
            width *= 2
        return order


def repeated_windows(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, anchor: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, first, last): runs of an item's windows that also stand in another item of its group.

    Item i's bytes are ``bounds[i]`` to ``bounds[i + 1]``, its anchor lies
    ``anchor[i]`` bytes in; each of its windows begins at or before the anchor.
    """
    begin, end = bounds[:-1], bounds[1:]
    suffixes = Suffixes(data, begin + anchor, end, group)
    order = suffixes.sort()
    right = np.zeros(len(order), np.int64)  # common with the one before in order
    same = group[order[1:]] == group[order[:-1]]
    right[1:][same] = suffixes.common(order[1:][same], order[:-1][same])
    best = np.maximum(right, np.append(right[1:], 0))
    least = np.maximum(anchor - (end - begin - LENGTH), 0)[order]  # windows lie at distances least..anchor
    least = np.maximum(least, LENGTH - best)
    most = anchor[order]
    prefix, (_, inverse) = suffixes.prefix, powers(len(data) + 1)
    at = (begin + anchor)[order]
    found_item, found_start, found_with = [], [], []
    for distance in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        active = np.flatnonzero((least <= distance) & (distance <= most))
        if len(active) < 2:
            continue
        interval = np.cumsum(right < LENGTH - distance)[active]
        x = at[active]
        left = (prefix[x] - prefix[x - distance]) * inverse[x - distance]
        rank = np.lexsort((left, interval))
        equal = np.zeros(len(rank) + 1, bool)
        equal[1:-1] = (interval[rank[1:]] == interval[rank[:-1]]) & (left[rank[1:]] == left[rank[:-1]])
        hit = np.flatnonzero(equal[1:] | equal[:-1])
        if not len(hit):
            continue
        partner = np.where(equal[hit], hit - 1, hit + 1)
        item = order[active[rank[hit]]]
        found_item.append(item)
        found_start.append((anchor[item] - distance))
        found_with.append(order[active[rank[partner]]])
    if not found_item:
        return []
    item, start, other = (np.concatenate(x) for x in (found_item, found_start, found_with))
    rank = np.lexsort((start, item))
    item, start, other = item[rank], start[rank], other[rank]
    cut = np.ones(len(item), bool)
    cut[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1)
    # Verify bytes at both ends of every run, and at every change of the partner.
    check = cut.copy()
    check[:-1] |= cut[1:]
    check[-1] = True
    check[1:] |= other[1:] != other[:-1]
    check = np.flatnonzero(check)
    for k in range(0, len(check), 4000):
        some = check[k : k + 4000]
        mine = data[(begin[item[some]] + start[some])[:, None] + np.arange(LENGTH)]
        theirs = data[(begin[other[some]] + anchor[other[some]] - anchor[item[some]] + start[some])[:, None] + np.arange(LENGTH)]
        if (mine != theirs).any():
            return exact_windows(data, begin, end, group, anchor)
    first = np.flatnonzero(cut)
    last = np.append(first[1:] - 1, len(item) - 1)
    return list(zip(item[first].tolist(), start[first].tolist(), start[last].tolist()))


def exact_windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, anchor: np.ndarray) -> list[tuple[int, int, int]]:
    """The same by the windows' bytes themselves, should a hash collide."""
    seen: dict[tuple, list] = {}
    for i in range(len(begin)):
        for s in range(min(int(anchor[i]), int(end[i] - begin[i]) - LENGTH) + 1):
            seen.setdefault((int(group[i]), int(anchor[i]) - s, data[begin[i] + s : begin[i] + s + LENGTH].tobytes()), []).append((i, s, s))
    return [x for rows in seen.values() if len(rows) > 1 for x in rows]


def own_windows(data: np.ndarray, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes of one text's windows, the place of the first of each, their number, and the sorted starts of those that stand more than once.

    Equal hashes are verified byte by byte against the first; what differs from
    it, should a hash collide, is counted by its bytes.
    """
    distinct, at_first, inverse, counts = np.unique(window, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    for k in range(0, len(again), 4000):
        some = again[k : k + 4000]
        if (data[start[some][:, None] + np.arange(LENGTH)] != data[start[at_first[inverse[some]]][:, None] + np.arange(LENGTH)]).any():
            seen: dict[bytes, list[int]] = {}
            for i, x in enumerate(start.tolist()):
                seen.setdefault(data[x : x + LENGTH].tobytes(), []).append(i)
            at_first, counts = np.array([v[0] for v in seen.values()]), np.array([len(v) for v in seen.values()])
            return window[at_first], at_first, counts, np.sort(start[[i for v in seen.values() if len(v) > 1 for i in v]])
    return distinct, at_first, counts, np.sort(start[again])


def removals(docs: DataFrame, hot: int = 16384) -> tuple[DataFrame, DataFrame]:
    """(distinct texts as (text_key, text), (text_key, n, ranges)): how often each text stands, and its repeated [begin, end) bytes."""
    key = text_key().alias("text_key")
    counts = docs.select(key).groupBy("text_key").agg(F.count("*").alias("n"))
    unique = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_key"])
    # Both are written, so that grams are found once and a hot gram's side of the join can be split.
    single = kept(grams(docs).where(F.size("keys") > 0).dropDuplicates(["text_key"]), "grams")
    rows = single.select("text_key", F.explode("keys").alias("key"))
    many = kept(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "repeated")
    repeated = rows.join(many, "key").groupBy("text_key").agg(F.collect_set(F.struct("key", (F.col("m") > hot).alias("hot"))).alias("at"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(11)]
        size = 0

        def batch() -> pa.RecordBatch:
            many = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), many, many, many, many, many, pa.list_(pa.list_(pa.int32()))]
            r = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["key", "text_key", "first", "anchor", "bytes", "grams", "hashes", "checks", "counts", "starts", "own"])
            for x in out:
                x.clear()
            return r

        for rows in batches:
            for name, text, at in zip(rows.column("text_key").to_pylist(), rows.column("text").to_pylist(), rows.column("at").to_pylist()):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                asked = {a["key"]: a["hot"] for a in at}
                _, keys, anchors, firsts, lasts = find_anchors(data, np.array([0, len(data)]))
                keys = keys.view(np.int64)
                for key, anchor, first, last in zip(keys.tolist(), anchors.tolist(), firsts.tolist(), lasts.tolist()):
                    if asked.get(key) is False:
                        for x, v in zip(out, (key, name, first, anchor - first, raw[first : last + LENGTH], *[None] * 6)):
                            x.append(v)
                        size += last - first + LENGTH
                        if size > 4 << 20:
                            size = 0
                            yield batch()
                crowded = np.array([asked.get(k) is True for k in keys.tolist()], bool)
                if crowded.any():
                    n = (lasts - firsts + 1)[crowded]
                    start = np.repeat(firsts[crowded] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    window = span_hashes(prefix_hashes(data, lower=False), start, start + LENGTH)
                    distinct, at_first, counts, twice = own_windows(data, start, window)
                    checks = np.array([int.from_bytes(hashlib.blake2b(raw[x : x + LENGTH], digest_size=8).digest(), "little", signed=True) for x in start[at_first].tolist()], np.int64)
                    cut = np.flatnonzero(np.diff(twice) > 1)
                    own = np.column_stack([twice[np.concatenate([[0], cut + 1])], twice[np.append(cut, len(twice) - 1)] + LENGTH]) if len(twice) else np.zeros((0, 2), np.int64)
                    for x, v in zip(out, (None, name, None, None, None, np.repeat(keys[crowded], n)[at_first], distinct.view(np.int64), checks, counts, start[at_first], own.tolist())):
                        x.append(v)
                    size += 40 * len(distinct)
        if out[0]:
            yield batch()

    served = unique.join(repeated, "text_key").select("text_key", "text", "at").mapInArrow(windows, "key long, text_key binary, first int, anchor int, bytes binary, grams array<long>, hashes array<long>, checks array<long>, counts array<long>, starts array<long>, own array<array<int>>")

    def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            data, bounds = strings_bytes(t.column("bytes"))
            key, first = t.column("key").to_numpy(), t.column("first").to_numpy()
            runs = repeated_windows(data, bounds, key, t.column("anchor").to_numpy().astype(np.int64))
            item = np.array([r[0] for r in runs], np.int64)
            begin, end = np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64)
            return pa.RecordBatch.from_arrays([t.column("text_key").combine_chunks().take(pa.array(item)), pa.array((first[item] + begin).astype(np.int32)), pa.array((first[item] + end + LENGTH).astype(np.int32))], names=["text_key", "b", "e"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last gram may go on
                if cut:
                    yield emit(t.slice(0, cut))
                    held, size = t.slice(cut).to_batches(), t.slice(cut).nbytes
        if held:
            yield emit(pa.Table.from_batches(held))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = served.where("key is not null").select("key", "text_key", "first", "anchor", "bytes").repartition(parts, "key").sortWithinPartitions("key")
    ranges = cold.mapInArrow(sorted_groups, "text_key binary, b int, e int")
    crowded = served.where("key is null").select("text_key", "own", "grams", "hashes", "checks", "counts", "starts")
    window = crowded.select("text_key", F.inline(F.arrays_zip("grams", "hashes", "checks", "counts", "starts"))).toDF("text_key", "gram", "hash", "check", "n", "b")
    twice = window.groupBy("gram", "hash", "check").agg(F.sum("n").alias("c")).where("c > 1").drop("c")
    ranges = ranges.unionByName(window.where("n = 1").join(twice, ["gram", "hash", "check"]).select("text_key", F.col("b").cast("int").alias("b"), (F.col("b") + LENGTH).cast("int").alias("e")))
    ranges = ranges.unionByName(crowded.select("text_key", F.explode("own").alias("r")).select("text_key", F.col("r")[0].alias("b"), F.col("r")[1].alias("e")))
    found = ranges.groupBy("text_key").agg(F.collect_list(F.struct("b", "e")).alias("ranges"))
    return unique, counts.join(found, "text_key", "left")


def strings_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct_texts(docs: DataFrame, hot: int = 16384) -> DataFrame:
    """(text_key, n_bytes, spans, kept): for each distinct text the removed [begin, end) bytes, and the bytes that stay."""
    unique, found = removals(docs, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                some = rows.slice(at, 500)
                spans, left, sizes = [], [], []
                for text, n, ranges in zip(some.column("text").to_pylist(), some.column("n").to_pylist(), some.column("ranges").to_pylist()):
                    raw = text.encode()
                    out: list[list[int]] = []
                    for b, e in [(0, len(raw))] if n > 1 and len(raw) >= LENGTH else sorted((r["b"], r["e"]) for r in ranges or ()):
                        if out and b <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], e)
                        else:
                            out.append([b, e])
                    spans.append(out)
                    ends = [0, *(x for s in out for x in s), len(raw)]
                    left.append(b"".join(raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays([some.column("text_key"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(left, pa.binary())], names=["text_key", "n_bytes", "spans", "kept"])

    return unique.join(found, "text_key").select("text_key", "text", "n", "ranges").mapInArrow(cut, "text_key binary, n_bytes long, spans array<array<int>>, kept binary")


def text_key() -> Column:
    """The name of a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def dedup(docs: DataFrame, hot: int = 16384) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document."""
    return docs.select("doc_id", text_key().alias("text_key")).join(distinct_texts(docs, hot), "text_key").drop("text_key")
