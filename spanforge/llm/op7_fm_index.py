"""Exact word-window deduplication with a compressed FM-index per shard (operator 7).

A window is `length` consecutive words.  A word goes if a window over it also starts in a document of smaller id.
The dataflow of repeats.py brings windows that may repeat, with the stretch of words around them, to the bucket of
their anchor.  A bucket is cut into shards; each shard's stretches are indexed once: the Burrows-Wheeler transform of
their words as a wavelet matrix with rank counts, one bit vector a level.  The stretches are then streamed through
backward search, all windows side by side, which gives the matching statistic of each place up to the threshold; where
it reaches the threshold, the interval of the index is the window's name, and the smallest id of an interval is kept
beside it.

Defined cases: a null text has no words; texts of fewer words than a window lose nothing; equal ids never remove from
each other; a null id counts as the largest; repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import real_id
from .repeats import Method, Symbols, mixed, own_spans, with_spans

LENGTH = 13
GRAM = 5
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all rows start and end."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word])
    start = word & (~before[:-1] | edge[:-1])
    after = np.concatenate([word, [False]])[1:]
    return np.flatnonzero(start), np.flatnonzero(word & (~after | edge[1:])) + 1


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    starts, ends = word_bounds(data, offsets)
    size = 1 << max(16, int(len(data) + 1).bit_length())
    up, down = powers(BASE, size), powers(INVERSE, size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = len(word)
    gram = np.zeros(n, np.uint64)
    for i in range(min(GRAM, n)):
        gram[: n - i] = gram[: n - i] * np.uint64(0xC2B2AE3D27D4EB4F) + word[i:]
    raw = data.tobytes()
    first, last = starts.tolist(), ends.tolist()
    return Symbols(mixed(gram), np.searchsorted(starts, offsets), lambda p, q: b" ".join(raw[first[p] : last[q - 1]].split()))


class FmIndex:
    """Counts and wavelet matrix of the transform of a sequence of word numbers; searches words backward, side by side."""

    def __init__(self, words: np.ndarray, depth: int):
        n = len(words)
        rank, reach = words.astype(np.int64), 1
        while reach < depth:
            step = min(reach, depth - reach)
            later = np.zeros(n, np.int64)
            later[: n - step] = rank[step:] + 1
            _, rank = np.unique(rank * np.int64(n + int(words.max()) + 2) + later, return_inverse=True)
            reach += step
        # the suffix array is needed for the transform alone and not kept
        transform = words[np.argsort(rank, kind="stable") - 1]
        self.size = n
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(words))]).astype(np.int64)
        self.levels = []
        for level in reversed(range(int(words.max()).bit_length() or 1)):
            bit = (transform >> level & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            blocks = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])[:-1]
            zeros = n - int(bit.sum())
            self.levels.append((level, blocks, before.astype(np.int32), zeros))
            transform = np.concatenate([transform[bit == 0], transform[bit == 1]])
        # where each word's block starts after the last level
        self.zero = self._through(np.arange(int(words.max()) + 1), np.zeros(int(words.max()) + 1, np.int64))

    def _through(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, blocks, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(blocks[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(word >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Times that each word occurs in the transform before each place."""
        return self._through(word, at) - self.zero[word]

    def intervals(self, words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each end: interval of the suffixes that match, and the matching statistic up to depth."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        match, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for i in range(1, depth + 1):
            word = words[ends[live] - i]
            a = self.starts[word] + self.rank(word, low[live])
            b = self.starts[word] + self.rank(word, high[live])
            kept = b > a
            live = live[kept]
            low[live], high[live] = a[kept], b[kept]
            match[live] = i
        return low, high, match


def smallest_ids(contexts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each window of the contexts, and the number of windows of each."""
    number: dict[bytes, int] = {}
    cut = [c.split(b" ") for c in contexts]
    sizes = np.array([len(c) for c in cut], np.int64)
    # 0 parts the contexts; a window never holds it
    words = np.array([x for c in cut for x in (0, *[number.setdefault(w, len(number) + 1) for w in c])] + [0], np.int64)
    index = FmIndex(words, length)
    bounds = np.cumsum(sizes + 1) - sizes
    windows = sizes - length + 1
    ends = np.repeat(bounds + length - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    low, high, match = index.intervals(words, ends, length)
    if (match < length).any():
        raise AssertionError("a window of the shard isn't in its own index")
    # every occurrence of a window was searched itself, so those with one interval are all there are of it
    names, which = np.unique(low, return_inverse=True)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, which, np.repeat(ids, windows))
    return least[which], windows


METHOD = Method(LENGTH, GRAM, word_symbols, smallest_ids)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _h, n_words, spans, kept): the removed spans in words and the words that are left, joined by one space."""

    def run(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(2).to_pylist(), own_spans(batch.column(1), batch.column(3))):
                words = text.encode().split()
                cuts = [0, *(x for s in gone for x in s), len(words)]
                kept = [w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]
                out.append((len(words), [{"a": a, "b": b} for a, b in gone], len(words) - len(kept), b" ".join(kept).decode()))
            n, gone, lost, kept = zip(*out) if out else ((), (), (), ())
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(gone, span), pa.array(kept, pa.string())],
                ["_id", "_h", "n_words", "n_removed", "spans", "kept"],
            )

    found = with_spans(docs, METHOD, id_col, text_col).mapInArrow(run, "_id long, _h long, n_words long, n_removed long, spans array<struct<a: long, b: long>>, kept string")
    return found.select(real_id("_id").alias(id_col), "_h", "n_words", "n_removed", "spans", "kept")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
