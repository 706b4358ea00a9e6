"""Exact substring deduplication with a bucket-pointer-refined suffix array (operator 4).

Texts are UTF-8 bytes.  A byte goes if a string of `length` bytes over it also starts in a document of smaller id.
The dataflow of repeats.py brings every such string to the bucket of its anchor q-gram.  There the suffixes of all
contexts start in buckets of their first 8 bytes, and buckets are refined by sorting their members on the bucket
identifiers at a later offset, 8, 16, 32 ... bytes on; identifiers of one round serve the next, and members of a bucket
that has come down to one suffix are not sorted again.  At depth `length` a bucket is one string.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; equal ids never remove from each other;
a null id counts as the largest; repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import real_id
from .repeats import Method, Symbols, mixed, own_spans, with_spans

LENGTH = 50
GRAM = 20


def loads(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the first n positions as one number; data has 8 spare bytes at its end."""
    return np.ndarray(n, "<u8", data, strides=(1,))


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    n = len(data)
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    a, b, c = loads(padded, n).copy(), loads(padded[8:], n), loads(padded[GRAM - 8 :], n)
    a *= np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(31)
    a += b
    a *= np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= a >> np.uint64(29)
    a += c
    raw = data.tobytes()
    return Symbols(mixed(a), offsets, lambda p, q: raw[p:q])


def refined(start: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the string of that length at each position that has room for it; -1 elsewhere.

    start: the 8 bytes at each position as a number; ends: where the context of each position ends.
    """
    n = len(start)
    room = ends - np.arange(n)
    bucket = np.full(n, -1, np.int64)
    at = np.flatnonzero(room >= min(8, length))
    _, bucket[at] = np.unique(start[at], return_inverse=True)
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        at = at[room[at] >= depth + step]
        if not len(at):
            return np.full(n, -1, np.int64)
        size = np.bincount(bucket[at])
        open_now = at[size[bucket[at]] > 1]
        # the new identifier of a bucket's member: its bucket, then the bucket that the pointer at the later offset names
        later = bucket[open_now + step]
        pair = bucket[open_now] * np.int64(n + 1) + later + 1
        names, inverse = np.unique(pair, return_inverse=True)
        fresh = np.full(n, -1, np.int64)
        fresh[at] = bucket[at]
        fresh[open_now] = len(size) + inverse
        named = np.zeros(len(size) + len(names), np.int64)
        named[fresh[at]] = 1
        fresh[at] = (np.cumsum(named) - 1)[fresh[at]]
        bucket, depth = fresh, depth + step
    return bucket


def smallest_ids(contexts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each window of the contexts, and the number of windows of each."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    bucket = refined(loads(raw, int(ends[-1])), np.repeat(ends, sizes), length)
    at = np.flatnonzero(bucket >= 0)
    least = np.full(int(bucket[at].max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket[at], np.repeat(ids, sizes)[at])
    return least[bucket[at]], sizes - length + 1


METHOD = Method(LENGTH, GRAM, byte_symbols, smallest_ids)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, _h, n_bytes, spans, kept, *keep): the removed spans in bytes and the bytes that are left of each row's text.

    as_text: what is left as a text; a character of which a part went goes whole.  keep: columns of docs to carry along.
    """
    names = [f"_keep_{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(2).to_pylist(), own_spans(batch.column(1), batch.column(3))):
                raw = text.encode()
                cuts = [0, *(x for s in gone for x in s), len(raw)]
                left = [raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
                out.append((len(raw), [{"a": a, "b": b} for a, b in gone], "".join(x.decode(errors="ignore") for x in left) if as_text else b"".join(left)))
            n, gone, kept = zip(*out) if out else ((), (), ())
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, span), pa.array(kept, pa.string() if as_text else pa.binary()), *batch.columns[4:]], ["_id", "_h", "n_bytes", "spans", "kept", *names])

    rows = with_spans(docs, METHOD, id_col, text_col, keep)
    schema = ["_id long, _h long, n_bytes long, spans array<struct<a: long, b: long>>, kept " + ("string" if as_text else "binary"), *(f"{n} {dict(rows.dtypes)[n]}" for n in names)]
    found = rows.mapInArrow(run, ", ".join(schema))
    return found.select(real_id("_id").alias(id_col), "_h", "n_bytes", "spans", "kept", *[F.col(n).alias(c) for n, c in zip(names, keep)])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
