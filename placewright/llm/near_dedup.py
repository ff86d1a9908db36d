"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of words ``[^\x20\x09-\x0D]+``,
lower-cased A-Z; a text of fewer words has its whole sequence as one.

1. Documents with equal sets form a class; only one of each class goes on.
2. Each tree of ``TREES`` branches a document by minwise tokens: the path so
   far chooses the next of the tree's own ``HASHES / TREES`` minwise values, and
   the path with that value is the child. Paths depend on the document alone, so
   all trees are one range-partitioned sort. Nodes of at most ``LIMIT`` documents
   are compared exhaustively by 2-bit sketches and set sizes; larger ones branch
   on. A pair of similarity 0.8 shares a node of depth d in one tree with
   probability 0.8**d; 16 trees miss it at depth 3 about once in 50 000. Ties are
   dealt by hashed id, so a large node is spread over many tasks.
3. In a node, pairs that look alike are taken from the most alike on; those whose
   ends are joined already by pairs that look at least ``LIKELY`` are left out, so
   a group of n copies gives about n pairs, not n * n. Of a node that is still
   large at ``DEPTH`` only the pairs with a few leaders are taken so.
4. Every pair is confirmed on the full sets, and connected components follow.
   Where the members of a node's group end in different components, the pairs
   between these components that were left out are confirmed as well.
5. Large nodes, and nodes that a bound between two tasks cuts, are compared whole
   on the full sets as far as their members lie in different components. Nodes
   that share a component are one pool, so a pair that meets in many trees is
   compared once. A pool's documents are dealt over blocks of bounded bytes and
   number, and every two blocks meet in a task, but for blocks that hold one and
   the same component: a group of copies that the leaders have joined costs no
   more than its stragglers times its blocks. Only copies that stay unlike one
   another cost the square of their blocks.

Defined cases: null, empty and wordless texts have the empty set and link with
nothing; equal sets are one class; rows without id are returned unlinked; rows
that repeat an id share its component; very long texts are compared whole, by
their sets; an empty table gives no rows; columns other than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import kept
from .textops import SPACE, U, distinct, fixed_rows, longs, mix, shingles, slices, strings, word_hashes, words

HASHES, TREES, DEPTH, LIMIT = 128, 16, 5, 64
#: Leaders with which the documents of a large node are paired; what they don't join is compared whole.
LEADERS = 8
#: Bytes of text and documents of a block of a pool.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 4096
#: Sketch likeness from which a pair is a candidate (four deviations below 0.8), and from which it joins a group.
CUT, LIKELY = 0.63, 0.82
MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=U) * U(0x5851F42D4C957F2D)) | U(1)
KEY = 4 * DEPTH
SETS = "doc_id long, n_shingles long, fp_a long, fp_b long, sketch binary, paths binary"


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle), sorted, and the bounds of each text."""
    starts, ends, first = words(data, offsets, SPACE)
    owner, value = distinct(*shingles(word_hashes(data, starts, ends), first, size))
    return owner, value, np.searchsorted(owner, np.arange(len(offsets)))


def minwise(value: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The HASHES minwise values of each non-empty run of ``value``."""
    out = np.empty((len(begins), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((value * MULTIPLIERS[k]) >> U(32)).astype(np.uint32), begins)
    return out


def paths(minima: np.ndarray) -> np.ndarray:
    """For each document and tree the hash of its path at each depth, big-endian, one after another.

    A tree has HASHES / TREES values of its own, in DEPTH ranges; the path chooses one of each range.
    """
    n, own = len(minima), HASHES // TREES
    ranges = [own * d // DEPTH for d in range(DEPTH + 1)]
    out = np.zeros((n, TREES, DEPTH), ">u4")
    for tree in range(TREES):
        path = np.full(n, (tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64), U)
        for depth in range(DEPTH):
            path = mix(path + U(depth + 1))
            chosen = tree * own + ranges[depth] + ((path >> U(40)) % U(ranges[depth + 1] - ranges[depth])).astype(np.int64)
            path = mix(path ^ (minima[np.arange(n), chosen].astype(U) + (chosen.astype(U) << U(32))))
            out[:, tree, depth] = (path >> U(32)).astype(np.uint32)
    return out.reshape(n, TREES * DEPTH)


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """The set of each document: its size, a 128-bit fingerprint, a sketch, and its path in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            owner, value, bounds = sets(data, offsets, size)
            n = np.diff(bounds)
            some = n > 0
            a, b = np.zeros(len(n), U), np.zeros(len(n), U)
            sketch, path = np.zeros((len(n), HASHES // 4), np.uint8), np.zeros((len(n), TREES * DEPTH), ">u4")
            if some.any():
                begins = bounds[:-1][some]
                a[some], b[some] = np.add.reduceat(mix(value ^ U(0xA5A5)), begins), np.add.reduceat(mix(value ^ U(0x5A5A5A)), begins)
                minima = minwise(value, begins)
                low = (mix(minima.astype(U)) & U(3)).astype(np.uint8)
                sketch[some] = low[:, 0::4] | low[:, 1::4] << 2 | low[:, 2::4] << 4 | low[:, 3::4] << 6
                path[some] = paths(minima)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n.astype(np.int64)), longs(a), longs(b), fixed_rows(sketch), fixed_rows(path)], names=["doc_id", "n_shingles", "fp_a", "fp_b", "sketch", "paths"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def spanning(first: np.ndarray, second: np.ndarray, est: np.ndarray) -> tuple[list[int], dict[int, list[int]]]:
    """Which candidate pairs to keep, the most alike first, and the groups of three or more that likely pairs join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = []
    for k in np.argsort(-est, kind="stable").tolist():
        a, b = find(int(first[k])), find(int(second[k]))
        if a != b:
            keep.append(k)
            if est[k] >= LIKELY:
                root[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for x in [*root]:
        groups.setdefault(find(x), []).append(x)
    return keep, {g: sorted({g, *xs}) for g, xs in groups.items() if len({g, *xs}) > 2}


def unpack(sketch: np.ndarray) -> np.ndarray:
    return np.concatenate([sketch & 3, sketch >> 2 & 3, sketch >> 4 & 3, sketch >> 6], axis=1)


def alike(sketch: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs of unpacked sketches."""
    out = np.empty(len(first))
    for at in range(0, len(first), 20_000):
        i, j = first[at : at + 20_000], second[at : at + 20_000]
        out[at : at + len(i)] = ((sketch[i] == sketch[j]).mean(axis=1) - 0.25) / 0.75
    return out


def sizes_allow(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as that; exact."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def led(rows: np.ndarray, sketch: np.ndarray, counts: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large node's rows with the first few of them that look like them."""
    out = []
    for _ in range(LEADERS):
        if len(rows) < 2:
            break
        leader, rows = rows[0], rows[1:]
        near = sizes_allow(counts[rows], counts[leader], percent)
        near[near] = ((sketch[rows[near]] == sketch[leader]).mean(axis=1) - 0.25) / 0.75 >= LIKELY
        out.append((np.full(int(near.sum()), leader), rows[near]))
        rows = rows[~near]
    return out


def compare(keys: np.ndarray, sketch: np.ndarray, counts: np.ndarray, rep: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[tuple[int, int]]]:
    """Candidate pairs among rows sorted by (tree, path), the groups within which pairs were left out, and the bounds of nodes too large to compare here."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    groups: list[list[int]] = []
    large: list[tuple[int, int]] = []
    small: dict[int, list[int]] = {}

    def add(i: np.ndarray, j: np.ndarray, est: np.ndarray) -> None:
        keep, joined = spanning(i, j, est)
        pairs.append((i[keep], j[keep]))
        groups.extend(joined.values())

    def node(lo: int, hi: int, depth: int) -> None:
        if hi - lo <= LIMIT:
            small.setdefault(hi - lo, []).append(lo)
        elif depth == keys.shape[1]:
            large.append((lo, hi))
            # The smallest ids lead, so that a group has the same leaders in every tree.
            pairs.extend(led(lo + np.argsort(rep[lo:hi], kind="stable"), sketch, counts, percent))
        else:
            for a, b in runs(lo, hi, depth):
                node(a, b, depth + 1)

    def runs(lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
        column = keys[lo:hi, depth]
        cuts = np.concatenate([[lo], lo + 1 + np.flatnonzero(column[1:] != column[:-1]), [hi]])
        for k in np.flatnonzero(np.diff(cuts) > 1):
            yield int(cuts[k]), int(cuts[k + 1])

    for a, b in runs(0, len(keys), 0):  # the tree
        for c, d in runs(a, b, 1):
            node(c, d, 2)
    for n, begins in small.items():
        i, j = np.triu_indices(n, 1)
        step = max(1, 400_000 // len(i))
        for at in range(0, len(begins), step):
            lo = np.array(begins[at : at + step])
            first, second = (lo[:, None] + i).ravel(), (lo[:, None] + j).ravel()
            may = np.flatnonzero(sizes_allow(counts[first], counts[second], percent))
            est = alike(sketch, first[may], second[may])
            near, est = may[est >= CUT], est[est >= CUT]
            if n == 2:
                pairs.append((first[near], second[near]))
                continue
            node_of = near // len(i)
            for part in np.split(np.arange(len(near)), np.flatnonzero(np.diff(node_of)) + 1):
                if len(part):
                    add(first[near[part]], second[near[part]], est[part])
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *(p[0] for p in pairs)]), np.concatenate([z, *(p[1] for p in pairs)]), groups, large


def cut_nodes(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, length of the common key) of the nodes at either end of sorted rows, which may go on in another task."""
    out = []
    for row in (0, len(keys) - 1):
        for depth in range(2, keys.shape[1] + 1):
            same = np.flatnonzero((keys[:, :depth] == keys[row, :depth]).all(axis=1))
            lo, hi = int(same[0]), int(same[-1]) + 1
            if hi - lo <= LIMIT or depth == keys.shape[1]:
                out.append((lo, hi, depth))
    return out


def candidates(classes: DataFrame, percent: int = 80) -> DataFrame:
    """Of class representatives (rep, n_shingles, sketch, paths): pairs (a, b, null) that met in a node and look alike, members (a, null, grp) of groups within which pairs were left out, and members (a, null, grp, true) of nodes to compare whole."""
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("paths", t * KEY + 1, KEY))).alias("tree", "path")
    rows = classes.select("rep", "n_shingles", "sketch", tree).select("tree", "path", F.xxhash64("rep", "tree").alias("tie"), "rep", F.col("n_shingles").cast("int").alias("n"), "sketch")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "tree", "path", "tie").sortWithinPartitions("tree", "path", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            trees = t.column("tree").to_numpy()
            keys = np.column_stack([trees.astype(np.uint32), strings_matrix(t.column("path"), ">u4")])
            rep = t.column("rep").to_numpy()
            i, j, groups, large = compare(keys, unpack(strings_matrix(t.column("sketch"), np.uint8)), t.column("n").to_numpy().astype(np.int64), rep, percent)
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            # A group's name: its tree and its ends. A node's: its tree and path, the same in every task.
            ends = [(int(trees[g[0]]), int(rep[g].min()), int(rep[g].max())) for g in groups]
            nodes = sorted({*((lo, hi, keys.shape[1]) for lo, hi in large), *cut_nodes(keys)})
            names = np.array([hash(e) for e in ends] + [hash((d, *keys[lo, :d].tolist())) for lo, hi, d in nodes], np.int64)
            sizes = [len(g) for g in groups] + [hi - lo for lo, hi, _ in nodes]
            member = np.concatenate([np.array([x for g in groups for x in g], np.int64), *(np.arange(lo, hi) for lo, hi, _ in nodes)])
            m, n, left = len(a), len(member), sum(sizes[: len(groups)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, rep[member]]), pa.int64()),
                    pa.array(np.concatenate([b, np.zeros(n, np.int64)]), pa.int64(), mask=np.repeat([False, True], [m, n])),
                    pa.array(np.concatenate([np.zeros(m, np.int64), np.repeat(names, sizes)]).astype(np.int64), pa.int64(), mask=np.repeat([True, False], [m, n])),
                    pa.array(np.repeat([False, True], [m + left, n - left])),
                ],
                names=["a", "b", "grp", "large"],
            )

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 60_000:
                # What follows the last change of the first path element waits for the next rows,
                # unless one such node fills the buffer: where it is cut, its nodes are compared whole.
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                head = strings_matrix(t.column(1), ">u4")[:, 0]
                tree = t.column(0).to_numpy()
                change = np.flatnonzero((head[1:] != head[:-1]) | (tree[1:] != tree[:-1]))
                cut = int(change[-1]) + 1 if len(change) and size - change[-1] < 40_000 else t.num_rows
                yield emit([t.slice(0, cut)])
                held, size = [t.slice(cut)] if cut < t.num_rows else [], t.num_rows - cut
        if size:
            yield emit(held)

    return rows.mapInArrow(run, "a long, b long, grp long, large boolean").where("grp is not null or a <> b").distinct()


def close(counts: np.ndarray, value: np.ndarray, part: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that join all linked rows of different parts, by their sets (``value``, one after another).

    Rows of different sides are compared, or all if there is but one. Left out
    are pairs that are joined already, that sizes rule out, or that a bitmap of
    the shingles rules out: a set's shingles that share a bit with another of its
    own count as shared, so the bound is never too low.
    """
    n = len(counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    _, code = np.unique(value, return_inverse=True)
    bits = 1 << int(np.clip(np.ceil(np.log2(12 * np.median(counts))), 8, 13))
    owner = np.repeat(np.arange(n), counts)
    bit = (value % U(bits)).astype(np.int64)
    maps = np.zeros((n, bits // 64), U)
    np.bitwise_or.at(maps, (owner, bit >> 6), U(1) << (bit & 63).astype(U))
    excess = counts - np.bitwise_count(maps).sum(axis=1)
    order = np.argsort(counts, kind="stable")
    counts_, maps_, excess_, side_ = counts[order], maps[order], excess[order], side[order]
    label = np.unique(part, return_inverse=True)[1][order]
    mark = np.zeros(int(code.max(initial=-1)) + 1, np.uint8)
    two, out = len(np.unique(side)) > 1, []
    for i in range(n):
        upto = int(np.searchsorted(counts_, 100 * int(counts_[i]) // percent, "right"))
        may = label[i + 1 : upto] != label[i]
        if not may.any():
            continue
        if two:
            may &= side_[i + 1 : upto] != side_[i]
        j = i + 1 + np.flatnonzero(may)
        if not len(j):
            continue
        shared = np.bitwise_count(maps_[j] & maps_[i]).sum(axis=1, dtype=np.int64) + np.minimum(excess_[i], excess_[j])
        j = j[(100 + percent) * shared >= percent * (counts_[i] + counts_[j])]
        if not len(j):
            continue
        own = code[bounds[order[i]] : bounds[order[i]] + counts_[i]]
        mark[own] = 1
        for some in np.split(j, range(512, len(j), 512)):
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            ends = np.cumsum(counts_[some])
            at = np.arange(ends[-1]) + np.repeat(bounds[order[some]] - ends + counts_[some], counts_[some])
            shared = np.add.reduceat(mark[code[at]], ends - counts_[some], dtype=np.int64)
            for k in some[100 * shared >= percent * (counts_[i] + counts_[some] - shared)].tolist():
                if label[k] != label[i]:
                    out.append((int(order[i]), int(order[k])))
                    label[label == label[k]] = label[i]
        mark[own] = 0
    return out


def pools(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, a, part): the members a of nodes that hold several components, by pool of nodes that share one; part is a's component."""
    own = nodes.join(found.withColumnRenamed("id", "a"), "a", "left").select("grp", "a", F.coalesce("component", "a").alias("part"))
    ends = own.groupBy("grp").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("grp", "lo")
    own = kept(own.join(ends, "grp"), "pools")
    joined = components(own.select(F.col("lo").alias("a"), F.col("part").alias("b")).where("a <> b").distinct())
    return own.select("a", "part").distinct().join(joined.select(F.col("id").alias("part"), F.col("component").alias("grp")), "part").select("grp", "a", "part")


def whole(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links that join all linked members (grp, a, part) of each pool that lie in different parts, whatever its size.

    Every two blocks of a pool meet in one task, with the texts of both. Parts of
    a block's bytes or rows and more have blocks of their own, which needn't meet.
    """
    rows = kept(members.join(docs.select(F.col("doc_id").alias("a"), "text"), "a"), "pooled")
    each = rows.groupBy("grp", "part").agg(F.greatest(F.sum(F.octet_length("text")) / BLOCK_BYTES, F.count("*") / BLOCK_ROWS).alias("blocks"))
    small = each.where("blocks < 1").groupBy("grp").agg(F.ceil(F.sum("blocks")).cast("int").alias("small"))
    # As many rows as the pool has whole blocks, at most.
    big = each.where("blocks >= 1").select("grp", "part", F.ceil("blocks").cast("int").alias("n"))
    big = big.withColumn("before", (F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n")).cast("int"))
    total = big.groupBy("grp").agg(F.sum("n").cast("int").alias("big")).join(small, "grp", "full").select("grp", F.coalesce("small", F.lit(0)).alias("small"), (F.coalesce("small", F.lit(0)) + F.coalesce("big", F.lit(0))).alias("total"))
    rows = rows.join(total, "grp").join(big, ["grp", "part"], "left").withColumn("first", F.col("small") + F.col("before"))
    rows = rows.withColumn("own", F.when(F.col("n").isNotNull(), F.col("first") + F.pmod(F.xxhash64("a"), "n")).otherwise(F.pmod(F.xxhash64("a"), "small")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("total") - 1))).where(F.col("n").isNull() | (F.col("k") < F.col("first")) | (F.col("k") >= F.col("first") + F.col("n")))
    rows = rows.select("grp", F.least("own", "k").alias("x"), F.greatest("own", "k").alias("y"), "own", "a", "part", "text")
    rows = rows.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "own", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> pa.RecordBatch:
            owner, value, bounds = sets(*strings(t.column("text")), size)
            a, own, part = (t.column(c).to_numpy() for c in ("a", "own", "part"))
            counts = np.diff(bounds)
            some = counts > 0
            # Rows of one side in a cell of two blocks meet in the cell of their own block.
            alone = t.column("x")[0].as_py() != t.column("y")[0].as_py() and own[0] == own[-1]
            found = close(counts[some], value, part[some], own[some], percent) if some.any() and not alone else []
            i, j = (a[some][[p[k] for p in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cell = np.column_stack([t.column(c).to_numpy() for c in ("grp", "x", "y")])
            cuts = [0, *(1 + np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))).tolist(), len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and [held[0].column(c)[0].as_py() for c in ("grp", "x", "y")] != cell[lo].tolist():
                    yield emit(pa.concat_tables(held).combine_chunks())
                    held = []
                held.append(t.slice(lo, hi - lo))
        if held:
            yield emit(pa.concat_tables(held).combine_chunks())

    return rows.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def left_out(members: DataFrame, found: DataFrame, tested: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): pairs of a group (grp, a) in different components (id, component) that look alike and were not tested.

    Groups are parts of one node, so of bounded size; only those that fell apart are opened.
    """
    own = members.join(found.withColumnRenamed("id", "a"), "a", "left").select("grp", "a", F.coalesce("component", "a").alias("component"))
    apart = own.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("grp")
    sets_ = own.join(apart, "grp").groupBy("grp").agg(F.collect_list(F.struct("a", "component")).alias("m"))
    cross = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["a"] > x["a"]) & (y["component"] != x["component"])), lambda y: F.struct(x["a"].alias("a"), y["a"].alias("b")))))
    pairs = sets_.select(F.explode(cross).alias("p")).select("p.a", "p.b").distinct().join(tested, ["a", "b"], "left_anti")
    pairs = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                x, y = (unpack(strings_matrix(rows.column(c), np.uint8)) for c in ("x", "y"))
                yield rows.select(["a", "b"]).filter(pa.array(((x == y).mean(axis=1) - 0.25) / 0.75 >= CUT))

    return pairs.mapInArrow(run, "a long, b long")


def strings_matrix(column, kind) -> np.ndarray:
    """Equally long binary values as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1), kind)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1).view(kind)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = batch.slice(at, 100)
                _, x, x_at = sets(*strings(rows.column("text_a")), size)
                _, y, y_at = sets(*strings(rows.column("text_b")), size)
                n = rows.num_rows
                nx, ny = np.diff(x_at), np.diff(y_at)
                owner = np.concatenate([np.repeat(np.arange(n), nx), np.repeat(np.arange(n), ny)])
                union = len(distinct(owner, np.concatenate([x, y]))[0]) if len(owner) else 0
                each = np.bincount(distinct(owner, np.concatenate([x, y]))[0], minlength=n) if union else np.zeros(n, np.int64)
                keep = (100 * (nx + ny - each) >= percent * each) & (each > 0)
                yield rows.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): one row per document.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the
    smallest id reachable by links.
    """
    each = kept(shingled(docs, size), "sets")
    named = each.where("n_shingles > 0 and doc_id is not null")
    classes = kept(named.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    leaders = named.join(classes, ["fp_a", "fp_b", "n_shingles"]).where("doc_id = rep").dropDuplicates(["rep"])
    met = kept(candidates(leaders.select("rep", "n_shingles", "sketch", "paths"), percent), "pairs")
    texts = docs.where("doc_id is not null")
    pairs = met.where("b is not null").select("a", "b")
    found = components(confirmed(pairs, texts, size, percent))
    again = kept(left_out(met.where("grp is not null and not large").select("grp", "a"), found, pairs, leaders.select("rep", "sketch")), "pairs")
    pool = kept(pools(met.where("large").select("grp", "a"), found), "pools")
    more = [confirmed(again, texts, size, percent)] if not again.isEmpty() else []
    more += [whole(pool, texts, size, percent)] if not pool.isEmpty() else []
    if more:
        # Components stay as they are, joined by the new links.
        star = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(functools.reduce(DataFrame.unionByName, more, star))
    members = each.select("doc_id", "n_shingles", "fp_a", "fp_b").join(classes, ["fp_a", "fp_b", "n_shingles"], "left")
    members = members.withColumn("class_id", F.when(F.col("doc_id").isNotNull() & F.col("rep").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    out = members.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
