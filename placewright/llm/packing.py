"""Hierarchical multi-length packing of tokenised documents.

Every partition tokenises its documents and packs them in buffers of a bounded
number of tokens, so nothing is shuffled and a task's memory does not follow
the partition. A document is cut into full windows of the longest tier and a
remainder; the remainder goes to the shortest tier that holds it. Tiers are
packed from the longest to the shortest: a window takes the longest remaining
piece of its tier, its gap takes the longest shorter pieces that fit, and the
last gap takes the head of a longer remaining piece (documents may be cut
freely). Windows are therefore exactly full. What a partition has left at its
end becomes one exactly full window per power of two. Windows are dealt to step
groups of about ``step_tokens`` tokens, longest first to the emptiest group.

Defined cases: null or empty text is a document of the end token alone; equal
or repeated rows are packed each for itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TIERS = (512, 1024, 2048, 4096)
#: How a tokenizer file normalises and splits texts whose words may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
#: Most distinct words that a worker remembers.
REMEMBERED = 800_000


class Encoder:
    """Token ids of texts by the given tokenizer file, word by word.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its white-space separated words in order. A word's ids are
    computed once and remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        #: Whether the file is of the kind whose words may be encoded one by one; else texts go to the tokenizer whole.
        self.by_word = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER and parts["model"]["type"] == "BPE" and all(x["content"].startswith("<|") for x in parts["added_tokens"])
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x21-\x7EÀ-ÿ]+").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        #: Ids as bytes, which take a third of the memory of lists of numbers.
        self.pieces: dict[str, bytes] = {}
        self.flat = bytearray()
        self.ends = array("q")

    def word(self, word: str) -> bytes:
        """The word's ids, 4 bytes each."""
        if "<|" in word or not self.plain(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        out = b""
        for part in self.parts(word.lower()):
            ids = self.pieces.get(part)
            if ids is None:
                ids = self.pieces[part] = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.byte_names))]).tobytes()
            out += ids
        return out

    def learn(self, words: list[str]) -> np.ndarray:
        """The number under which each word is remembered."""
        if len(self.known) + len(words) > REMEMBERED:
            self.clear()
        known, out = self.known, np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = known.get(w)
            if k is None:
                self.flat += self.word(w)
                k = known[w] = len(self.ends)
                self.ends.append(len(self.flat) >> 2)
            out[i] = k
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset of each text's first id."""
        if not self.by_word:
            each = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in each])]).astype(np.int64)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        numbers = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        flat, ends = np.frombuffer(bytes(4) if not self.flat else self.flat, np.uint32), np.frombuffer(self.ends, np.int64) if self.ends else np.zeros(1, np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        lengths = (ends - begins)[numbers] if len(numbers) else np.zeros(0, np.int64)
        word_at = np.concatenate([[0], np.cumsum(lengths)])
        total = int(word_at[-1])
        ids = flat[np.repeat(begins[numbers] - word_at[:-1], lengths) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return ids, word_at[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_lengths(lengths: list[int], tiers: tuple[int, ...], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of (piece, begin, length) that are exactly full, and the pieces left over (none if ``last``).

    Each length is at most the longest tier; windows are as long as their tier,
    or a power of two for the leftovers.
    """
    left = sorted((n, i, 0) for i, n in enumerate(lengths) if n)
    windows: list[list[tuple[int, int, int]]] = []

    def fill(window: int) -> None:
        rows, gap = [], window
        while gap:
            k = bisect_right(left, (gap, len(lengths), 0)) - 1
            n, i, begin = left.pop(k if k >= 0 else 0)
            rows.append((i, begin, min(n, gap)))
            if n > gap:
                insort(left, (n - gap, i, begin + gap))
            gap -= min(n, gap)
        windows.append(rows)

    total = sum(lengths)
    for k in range(len(tiers) - 1, -1, -1):
        shorter = tiers[k - 1] if k else 0
        while left and left[-1][0] > shorter and total >= tiers[k]:
            fill(tiers[k])
            total -= tiers[k]
    if not last:
        return windows, [(i, begin, n) for n, i, begin in left]
    while total:
        size = 1 << (min(total, tiers[-1]).bit_length() - 1)
        fill(size)
        total -= size
    return windows, []


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: the longest windows first, each to the group with the fewest tokens."""
    groups = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = 4_000_000, step_tokens: int = 1 << 18) -> DataFrame:
    """One row per piece: whose tokens, which of them (``ids``: little-endian unsigned 32-bit), and where they lie."""
    longest = tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path).encode
        held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        counts = [0, 0]  # windows, groups

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            windows, left = pack_lengths([len(x[3]) for x in held], tiers, last)
            sizes = [sum(n for _, _, n in w) for w in windows]
            groups = step_groups(sizes, step_tokens)
            for at in range(0, len(windows), 512):
                rows = [(held[i][0], held[i][1] + b, n, held[i][3][b : b + n], held[i][2], (part << 32) + counts[0] + w, w) for w in range(at, min(at + 512, len(windows))) for i, b, n in windows[w]]
                w = np.array([r[6] for r in rows])
                n = np.array([r[2] for r in rows])
                before = np.concatenate([[0], np.cumsum(n)[:-1]])
                first = np.concatenate([[True], w[1:] != w[:-1]])
                offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(w))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([r[3].tobytes() for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64()), pa.array(offset, pa.int64()), pa.array(np.array(sizes)[w], pa.int64()), pa.array((part << 32) + counts[1] + np.array(groups)[w], pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"],
                )
            counts[0] += len(windows)
            counts[1] += max(groups, default=-1) + 1
            held = [(held[i][0], held[i][1] + b, held[i][2], held[i][3][b : b + n]) for i, b, n in left]

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, first = encode(some.column(1))
                for k, doc in enumerate(some.column(0).to_pylist()):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    held += [(doc, s, len(own), own[s : s + longest]) for s in range(0, len(own), longest)]
                    waiting += len(own)
                    if waiting >= buffer_tokens:
                        yield from flush(False)
                        waiting = sum(len(x[3]) for x in held)
        if held:
            yield from flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
