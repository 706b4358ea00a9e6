"""The Spark dataflow that operators 4 and 7 share: which windows of L symbols also start in a document of smaller id.

A window's anchor is the q-gram of smallest hash inside it, the first of equals, so equal windows have equal anchors at
equal places.  Consecutive windows with one anchor form a run, a tenth or so as many as there are symbols.

1. Every run sends its anchor's hash, packed; runs whose anchor occurs in two documents or more are candidates and only
   their numbers return to their documents (an equi-join on id).
2. Candidates send their context, the symbols that their windows cover, to the bucket of their anchor.  All equal
   windows meet there, and an exact index of the bucket (each operator has its own) finds their smallest id.
3. Removed spans return to their documents by another join on id, which reuses the shuffle of the texts.

Hot passages: within a slice of rows an anchor or a context is sent once, for its smallest id; the slice's other
documents that have it are known to repeat and bypass the bucket.  So a bucket gets a row for each slice and context
and not for each document, and nothing is dropped, capped or sampled.

Hot anchors: a phrase with other surroundings in every document has as many contexts as documents.  Anchors fall into
classes, many to a bucket; one with more than a sixteenth of its bucket's contexts is hot, and step 1 marks its runs.
A marked run goes to step 2 window by window, each under the hash of the whole window: equal windows still meet, because
their anchors are in one class, and different ones spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed_texts, partitions, text_slices, utf8

SLICE_BYTES = 1_500_000
#: Windows of a long text are cut into pieces of so many, which also keeps positions below the 24 bits beside a hash.
PIECE = 1 << 21
PLACE = np.uint64((1 << 24) - 1)
#: From here on ids stand for null ids, told apart by their texts' hashes but equal in rank.
NULLS = 2**63 - 2**40
KEY = np.uint64((1 << 48) - 1)
#: Classes of anchors to a bucket, the part of a bucket's contexts and their number above which a class is hot.
CLASSES = 256
HOT_PART = 16
HOT_CONTEXTS = 4096
#: Beside the number of a run: its anchor is hot.
HOT = np.uint32(1 << 31)


@dataclass
class Symbols:
    """The symbols of a slice of rows: hashes[i] belongs to the q-gram at i; row r has symbols bounds[r] to bounds[r + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    context: Callable[[int, int], bytes]


@dataclass
class Method:
    """What differs between the operators: window and q-gram length, reading a slice, and the exact index of a bucket."""

    window: int
    gram: int
    read: Callable[[np.ndarray, np.ndarray], Symbols]
    #: contexts, smallest id of each, window length -> smallest id of each window, contexts one after another, and windows of each
    smallest: Callable[[list[bytes], np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def rank(ids: np.ndarray) -> np.ndarray:
    """What of two documents decides which is smaller: the id, with null ids equal and last."""
    return np.minimum(ids, NULLS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def runs(s: Symbols, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, number in its row, first window, last window, hash) of each run of windows with one anchor."""
    parts, rows = [], len(s.bounds) - 1
    if rows == 1 and s.bounds[1] - window + 1 > PIECE:
        for a in range(0, int(s.bounds[1]) - window + 1, PIECE):
            z = min(a + PIECE + window - 1, int(s.bounds[1]))
            parts.append([x if i == 0 or i == 3 else x + a for i, x in enumerate(_runs(s.hashes[a:z], np.array([0, z - a]), window, gram))])
    else:
        parts.append(_runs(s.hashes, s.bounds, window, gram))
    row, first, last, key = (np.concatenate(x) for x in zip(*parts))
    starts = np.searchsorted(row, np.arange(rows))
    return row, np.arange(len(row)) - starts[row] if len(row) else row, first, last, key


def _runs(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    n, reach = len(hashes), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return [none, none, none, none.astype(np.uint64)]
    least = (hashes & ~PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(bounds[:-1], bounds[1:] - window + 1), 1)
    np.add.at(edge, bounds[1:], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1])[: len(least)] == 0)
    if not len(at):
        return [none, none, none, none.astype(np.uint64)]
    anchor = (least[at] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    return [np.searchsorted(bounds, first, side="right") - 1, first, last, hashes[anchor[new]]]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, sizes = zstandard.ZstdDecompressor().decompress(data), [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def spread(ids: np.ndarray, n: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def classes(key: np.ndarray, n: int) -> np.ndarray:
    return (mixed(key) % np.uint64(n * CLASSES)).astype(np.uint32)


def different(key: np.ndarray, edge: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Contexts of each anchor, told apart by what is at their two ends; key is sorted and sizes counts its equals."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    many = np.flatnonzero(sizes[group] > 1)
    order = many[np.lexsort((edge[many], group[many]))]
    again = np.flatnonzero((group[order][1:] == group[order][:-1]) & (edge[order][1:] == edge[order][:-1])) + 1
    return (sizes - np.bincount(group[order[again]], minlength=len(sizes))).astype(np.uint32)


def ask(method: Method, n: int) -> Callable:
    """Rows (bucket, kind, data): anchors to look for elsewhere (kind 0: key, id, number, contexts) and runs known to repeat (kind 1: id, number, class)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            found = []
            for a, b in text_slices(offsets, SLICE_BYTES):
                symbols = method.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, number, first, last, key = runs(symbols, method.window, method.gram)
                edge = mixed(symbols.hashes[first]) ^ symbols.hashes[last + method.window - method.gram] ^ (last - first).astype(np.uint64)
                found.append((key & KEY, ids[a + row], number, edge))
            if not found:
                continue
            key, at, number, edge = (np.concatenate(x) for x in zip(*found))
            if not len(key):
                continue
            order = np.lexsort((at, key))
            key, at, number = key[order], at[order], number[order].astype(np.uint32)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            least, most = np.repeat(rank(at[starts]), sizes), np.repeat(rank(np.maximum.reduceat(at, starts)), sizes)
            asked, known = np.flatnonzero(rank(at) == least), np.flatnonzero(least != most)
            load, of = np.zeros(len(key), np.uint32), classes(key, n)
            load[starts] = different(key, edge[order], sizes)
            out = [(b, 0, packed(key[asked[p]], delta(at[asked[p]]), number[asked[p]], load[asked[p]])) for b, p in split((of[asked] % np.uint32(n)).astype(np.int64))]
            out += [(b, 1, packed(at[known[p]], number[known[p]], of[known[p]])) for b, p in split(spread(at[known], n))]
            yield rows_of(out, ["bucket", "kind", "data"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


def rows_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def answer(n: int, hot_contexts: int) -> Callable:
    """Rows (bucket, kind, data), packed: the runs whose anchor another document has too (kind 0: id, number), those that
    were known to (kind 1: id, number, class), and for every bucket the hot classes (kind 2)."""

    def run(batches):
        asked, known, out = [], [], []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if kind == 0:
                    key, at, number, load = unpacked(data.as_buffer(), "u8", "i8", "u4", "u4")
                    asked.append((key, np.cumsum(at), number, load))
                else:
                    known.append(tuple(unpacked(data.as_buffer(), "i8", "u4", "u4")))
        if asked:
            key, at, number, load = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(key, kind="stable")
            key, at, number = key[order], at[order], number[order]
            names, of = np.unique(classes(key, n), return_inverse=True)
            loads = np.bincount(of, weights=load[order])
            hot = loads > max(hot_contexts, loads.sum() / HOT_PART)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = (rank(f.reduceat(at, starts)) for f in (np.minimum, np.maximum))
            shared = np.repeat(low != high, np.diff(np.append(starts, len(key))))
            out += in_order(0, n, at[shared], number[shared] | np.where(hot[of[shared]], HOT, np.uint32(0)))
            if hot.any():
                out += [(b, 2, packed(names[hot])) for b in range(n)]
        if known:
            out += in_order(1, n, *(np.concatenate(x) for x in zip(*known)))
        if out:
            yield rows_of(out, ["bucket", "kind", "data"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def in_order(kind: int, n: int, at: np.ndarray, number: np.ndarray, *more: np.ndarray) -> list[tuple]:
    order = np.lexsort((number, at))
    at, number, *more = (x[order] for x in (at, number, *more))
    return [(b, kind, packed(delta(at[p]), number[p], *(x[p] for x in more))) for b, p in split(spread(at, n))]


def gather(batches):
    """Rows (_id, numbers): the candidate runs of each document of the bucket, marked where their anchor is hot."""
    parts, hot = [], [np.zeros(0, np.uint32)]
    for batch in batches:
        for kind, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            if kind == 2:
                hot += unpacked(data.as_buffer(), "u4")
            else:
                at, *rest = unpacked(data.as_buffer(), "i8", *["u4"] * (1 + kind))
                parts.append((np.cumsum(at), *rest))
    if not parts:
        return
    hot = np.concatenate(hot)
    at = np.concatenate([x[0] for x in parts])
    number = np.concatenate([x[1] if len(x) == 2 else x[1] | np.where(np.isin(x[2], hot), HOT, np.uint32(0)) for x in parts])
    order = np.lexsort((number, at))
    at, raw = at[order], number[order].astype("<u4").tobytes()
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    for a in range(0, len(bounds) - 1, 10_000):
        part = bounds[a : a + 10_001]
        yield pa.RecordBatch.from_arrays([pa.array(at[part[:-1]]), pa.array([raw[4 * x : 4 * y] for x, y in zip(part[:-1].tolist(), part[1:].tolist())], pa.binary())], ["_id", "numbers"])


def offer(method: Method, n: int) -> Callable:
    """Rows (bucket, kind, data, texts): contexts of candidates (kind 0) and spans known to repeat (kind 1: id, hash, from, to)."""
    L = method.window

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids, marks, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            first_of: dict[bytes, int] = {}
            contexts, hashes, least, owner, known = [], [], [], [], []
            for a, b in text_slices(offsets, SLICE_BYTES):
                symbols = method.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, number, first, last, key = runs(symbols, L, method.gram)
                starts = np.append(np.searchsorted(row, np.arange(b - a)), len(row))
                marked = [np.unique(np.frombuffer(x, "<u4")) for x in numbers.slice(a, b - a).to_pylist()]
                in_row = [((x & ~HOT).astype(np.int64), (x & HOT) > 0) for x in marked]
                chosen = np.concatenate([x[x < z - y] + y for (x, _), y, z in zip(in_row, starts[:-1], starts[1:])] or [np.zeros(0, np.int64)])
                hot = np.concatenate([h[x < z - y] for (x, h), y, z in zip(in_row, starts[:-1], starts[1:])] or [np.zeros(0, bool)])
                start, stop, chosen, hot = contexts_of(first[chosen], last[chosen], chosen, hot, L)
                base = symbols.bounds[row[chosen]]
                who = a + row[chosen]
                for me, mark, p, q, k, h, z in zip(ids[who].tolist(), marks[who].tolist(), start.tolist(), stop.tolist(), (key[chosen] & KEY).tolist(), hot.tolist(), base.tolist()):
                    text = symbols.context(p, q)
                    if h:
                        k = xxhash.xxh64_intdigest(text) & int(KEY)
                    seen = first_of.setdefault(text, len(contexts))
                    if seen == len(contexts):
                        contexts.append(text)
                        hashes.append(k)
                        least.append(min(me, NULLS))
                    elif least[seen] < min(me, NULLS):
                        known.append((me, mark, p - z, q - z))
                        continue
                    owner.append((me, mark, p - z, seen))
            out = []
            if contexts:
                keys = np.array(hashes, np.uint64)
                owners = np.array(owner, np.int64)
                by_context = np.argsort(owners[:, 3], kind="stable")
                bounds = np.searchsorted(owners[by_context, 3], np.arange(len(contexts) + 1))
                for bucket, part in split((keys % np.uint64(n)).astype(np.int64)):
                    mine = np.concatenate([by_context[bounds[i] : bounds[i + 1]] for i in part.tolist()])
                    local = np.repeat(np.arange(len(part)), bounds[part + 1] - bounds[part])
                    texts = [contexts[i] for i in part.tolist()]
                    head = packed(owners[mine, 0].copy(), owners[mine, 1].copy(), owners[mine, 2].astype(np.uint32), local.astype(np.uint32))
                    sizes = packed(keys[part], np.array([len(t) for t in texts], np.uint32))
                    out.append((bucket, 0, head, sizes, zstandard.ZstdCompressor(level=3).compress(b"".join(texts))))
            if known:
                spans = joined(np.array(known, np.int64))
                out += [(b, 1, packed(*(spans[p, i].copy() for i in range(4))), None, None) for b, p in split(spread(spans[:, 0], n))]
            yield rows_of(out, ["bucket", "kind", "data", "sizes", "texts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    return run


def contexts_of(first: np.ndarray, last: np.ndarray, run: np.ndarray, hot: np.ndarray, L: int) -> tuple[np.ndarray, ...]:
    """(from, to, run, hot) of the contexts to send: one for a run, or one for each window of a run whose anchor is hot."""
    many = np.where(hot, last - first + 1, 1)
    of = np.repeat(np.arange(len(run)), many)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return start, np.where(hot[of], start, last[of]) + L, run[of], hot[of]


def joined(spans: np.ndarray) -> np.ndarray:
    """Rows (id, hash, from, to) with overlapping or touching spans of one (id, hash) as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    new = np.concatenate([[True], (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] != spans[:-1, 1])])
    group = np.cumsum(new) - 1
    wide = int(spans[:, 3].max()) + 2
    reach = np.maximum.accumulate(spans[:, 3] + group * wide) - group * wide
    start = new | np.concatenate([[True], spans[1:, 2] > reach[:-1]])
    at = np.flatnonzero(start)
    return np.column_stack([spans[at, 0], spans[at, 1], spans[at, 2], reach[np.append(at[1:], len(spans)) - 1]])


def decide(method: Method, n: int, shard_bytes: int = 1_000_000) -> Callable:
    """Rows (bucket, data), packed id, hash, from and to: the spans of the bucket's documents that repeat, in symbols."""
    L = method.window

    def run(batches):
        number_of: dict[bytes, int] = {}
        texts, keys, owners, found_before = [], [], [], []
        for batch in batches:
            for kind, data, sizes, text in zip(batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4))):
                if kind:
                    found_before.append(np.column_stack(unpacked(data.as_buffer(), "i8", "i8", "i8", "i8")))
                    continue
                me, mark, at, local = unpacked(data.as_buffer(), "i8", "i8", "u4", "u4")
                key, size = unpacked(sizes.as_buffer(), "u8", "u4")
                raw, ends = zstandard.ZstdDecompressor().decompress(text.as_buffer()), np.cumsum(size.astype(np.int64)).tolist()
                index = np.empty(len(size), np.int64)
                for i, (x, y) in enumerate(zip([0, *ends], ends)):
                    piece = raw[x:y]
                    index[i] = number_of.setdefault(piece, len(texts))
                    if index[i] == len(texts):
                        texts.append(piece)
                        keys.append(int(key[i]))
                owners.append(np.column_stack([index[local], me, mark, at]))
        if found_before:
            yield spans_batch(np.concatenate(found_before), n)
        if not texts:
            return
        owners = np.concatenate(owners)
        owners = owners[np.lexsort((owners[:, 1], owners[:, 0]))]
        least = rank(owners[np.searchsorted(owners[:, 0], np.arange(len(texts))), 1])
        windows, worst, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        for part in shards(order, [keys[i] for i in order.tolist()], [len(texts[i]) for i in order.tolist()], shard_bytes):
            smallest, windows[part] = method.smallest([texts[i] for i in part.tolist()], least[part], L)
            cuts = np.concatenate([[0], np.cumsum(windows[part])])
            worst[part] = np.maximum.reduceat(smallest, cuts[:-1])
            spans = pieces(smallest < np.repeat(least[part], windows[part]), cuts)
            spans[:, 0] = part[spans[:, 0]]
            found.append(spans)
        # an owner loses the windows whose smallest id is below its own: all of them if their largest such id is, and
        # otherwise it is the context's smallest owner, as no window's smallest id is above that
        whole = rank(owners[:, 1]) > worst[owners[:, 0]]
        rest, own = owners[whole], owners[~whole]
        yield spans_batch(np.column_stack([rest[:, 1], rest[:, 2], rest[:, 3], rest[:, 3] + windows[rest[:, 0]] + L - 1]), n)
        found = np.concatenate(found)
        if len(found) and len(own):
            found = found[np.argsort(found[:, 0], kind="stable")]
            start, stop = np.searchsorted(own[:, 0], found[:, 0]), np.searchsorted(own[:, 0], found[:, 0], side="right")
            many = stop - start
            row = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            at = own[row]
            yield spans_batch(np.column_stack([at[:, 1], at[:, 2], at[:, 3] + np.repeat(found[:, 1], many), at[:, 3] + np.repeat(found[:, 2], many) + L - 1]), n)

    return run


def pieces(lower: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(context, from, to) of each stretch of true windows, counted within the context."""
    at = np.flatnonzero(lower)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    context = np.searchsorted(cuts, at, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (context[1:] != context[:-1])]))
    ends = at[np.append(new[1:], len(at)) - 1] + 1
    return np.column_stack([context[new], at[new] - cuts[context[new]], ends - cuts[context[new]]])


def shards(order: np.ndarray, keys: list[int], sizes: list[int], limit: int) -> Iterator[np.ndarray]:
    """Parts of order with about limit bytes together; contexts of one key stay together."""
    start = total = 0
    for i in range(len(order)):
        if total >= limit and keys[i] != keys[i - 1]:
            yield order[start:i]
            start, total = i, 0
        total += sizes[i]
    if start < len(order):
        yield order[start:]


def spans_batch(spans: np.ndarray, n: int) -> pa.RecordBatch:
    spans = joined(spans)
    rows = [(b, packed(*(spans[p, i].copy() for i in range(4)))) for b, p in split(spread(spans[:, 0], n))]
    return rows_of(rows, ["bucket", "data"], [pa.int32(), pa.binary()])


def gather_spans(batches):
    """Rows (_id, spans): hash, from and to of each span of an id, as packed 64-bit numbers."""
    parts = [np.column_stack(unpacked(data.as_buffer(), "i8", "i8", "i8", "i8")) for batch in batches for data in batch.column(1)]
    if not parts:
        return
    spans = joined(np.concatenate(parts))
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(spans[:, 0])) + 1, [len(spans)]])
    raw = np.ascontiguousarray(spans[:, 1:]).tobytes()
    for a in range(0, len(bounds) - 1, 10_000):
        part = bounds[a : a + 10_001]
        yield pa.RecordBatch.from_arrays([pa.array(spans[part[:-1], 0].copy()), pa.array([raw[24 * x : 24 * y] for x, y in zip(part[:-1].tolist(), part[1:].tolist())], pa.binary())], ["_id", "spans"])


def with_spans(docs: DataFrame, method: Method, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(_id, _h, text, spans, *keep): each row with the packed spans of all rows of its id; those of its own hash are its own.

    Rows of null id are looked up by their texts' hashes.  Ids of NULLS and above rank as null ids do.
    """
    n = partitions(docs.sparkSession)
    null = F.lit(NULLS).bitwiseOR(F.col("_h").bitwiseAND(F.lit(2**40 - 1)))
    # no column more than the first join needs and no id that might be null, or the second can't reuse its shuffle
    every = keyed_texts(docs, id_col, text_col, keep)
    kept = [c for c in every.columns if c not in ("_id", "_h", "text")]
    texts = every.select(F.when(F.col("_id") == NULL_ID, null).otherwise(F.col("_id")).alias("_id"), "_h", "text", *kept)
    asked = texts.select("_id", "text").mapInArrow(ask(method, n), "bucket int, kind int, data binary").repartitionById(n, F.col("bucket"))
    answers = asked.mapInArrow(answer(n, HOT_CONTEXTS), "bucket int, kind int, data binary").repartitionById(n, F.col("bucket")).mapInArrow(gather, "_id long, numbers binary")
    offered = texts.join(answers, "_id").select("_id", "_h", "text", "numbers", *kept).mapInArrow(offer(method, n), "bucket int, kind int, data binary, sizes binary, texts binary")
    decided = offered.repartitionById(n, F.col("bucket")).mapInArrow(decide(method, n), "bucket int, data binary")
    found = decided.repartitionById(n, F.col("bucket")).mapInArrow(gather_spans, "_id long, spans binary")
    return texts.join(found, "_id", "left").select(F.when(F.col("_id") == null, NULL_ID).otherwise(F.col("_id")).alias("_id"), "_h", "text", "spans", *kept)


def own_spans(hashes: pa.Array, spans: pa.Array) -> list[list[tuple[int, int]]]:
    """Disjoint maximal spans of each row of a batch of with_spans, from those of all rows of its id."""
    out = []
    for h, raw in zip(hashes.to_pylist(), spans.to_pylist()):
        found = np.frombuffer(raw or b"", np.int64).reshape(-1, 3)
        out.append([(a, b) for own, a, b in found.tolist() if own == h])
    return out
