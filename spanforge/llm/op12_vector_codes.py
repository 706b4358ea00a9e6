"""Vector compression to short codes by partial-distance search (operator 12): product quantisation in integers.

A vector's components become integers floor(scale * x), and the vector is cut into equal consecutive parts.  Every part
position has a codebook of `entries` vectors; a part is stored as the index of its nearest entry.

`nearest` finds it for a block of parts at once.  Entries are taken in groups; within a group the dimensions are added in
descending variance of the codebook, so that the sums grow early, and a mask drops the entries of a part whose sum
strictly exceeds the best complete distance that this part has so far.  An entry that ties with the best stays in, so
the lower index wins ties, as it does in a full search.

Each of the training rounds is one pass: tasks assign their parts and add up (part, entry, dimension) sums, Spark sums
the sums, and the driver gets parts x entries x dimensions numbers, a size of the codebooks and not of the rows.  The
codebooks are broadcast with the next pass; their size is checked against BOOK_VALUES.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, as are vectors of another
length than that of the first kept one by id; null ids come last, rows of one id in the order of their vectors; fewer
rows than `entries` give smaller codebooks; an entry that no part takes stays; empty tables give empty results.  A
length that isn't a multiple of `parts`, and components of which the scaled value exceeds LARGEST, raise ValueError:
their distances would not fit 64 bits.  Columns besides id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest scaled component; squared differences of 2^54 leave room for the sum over 512 dimensions.
LARGEST = 1 << 26
#: Most numbers in all codebooks together.
BOOK_VALUES = 1 << 20
#: Parts compared at once, and entries in a group.
BLOCK, GROUP = 4096, 8


@dataclass(frozen=True)
class Codebooks:
    """values[part, entry, dimension]; scale is what components were multiplied by."""

    values: np.ndarray
    scale: int

    @property
    def length(self) -> int:
        return self.values.shape[0] * self.values.shape[2]

    def sha256(self) -> str:
        """Of all entries' components as decimal integers by part, entry, position, joined with commas."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors, one a row, that codes[row, part] stand for."""
        picked = self.values[np.arange(self.values.shape[0]), codes]
        return picked.reshape(len(codes), -1) / self.scale


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of book for each row of block; ties go to the lower index."""
    n, entries = len(block), len(book)
    order = np.argsort(-book.var(axis=0), kind="stable")
    block, book = block[:, order], book[:, order]
    best = ((block - book[0]) ** 2).sum(axis=1)
    index = np.zeros(n, np.int64)
    for a in range(1, entries, GROUP):
        some = book[a : a + GROUP]
        total = (block[:, :1] - some[:, 0]) ** 2
        row, entry = np.nonzero(total <= best[:, None])
        total = total[row, entry]
        for d in range(1, block.shape[1]):
            total += (block[row, d] - some[entry, d]) ** 2
            on = total <= best[row]
            row, entry, total = row[on], entry[on], total[on]
        if len(row) == 0:
            continue
        # what is left is complete: the smallest of each row, then the lowest index, and only if it beats the best
        by = np.lexsort((entry, total, row))
        row, entry, total = row[by], entry[by], total[by]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        row, entry, total = row[first], entry[first], total[first]
        less = total < best[row]
        best[row[less]] = total[less]
        index[row[less]] = a + entry[less]
    return index, best


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances (rows x parts) of integer vectors."""
    parts, _, width = books.shape
    codes, errors = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), np.int64)
    for p in range(parts):
        for a in range(0, len(vectors), BLOCK):
            codes[a : a + BLOCK, p], errors[a : a + BLOCK, p] = nearest(vectors[a : a + BLOCK, p * width : (p + 1) * width], books[p])
    return codes, errors


def scaled(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component times {scale} exceeds {LARGEST}: distances would not fit 64 bits")
    return whole.astype(np.int64).reshape(-1, length)


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, length: int | None = None) -> DataFrame:
    """(id, label, vector) of the rows that count, under fixed names."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    return rows if length is None else rows.where(F.size("vector") == length)


def by_id() -> list[Column]:
    return [F.col("id").asc_nulls_last(), F.col("vector")]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codebooks | None:
    """Codebooks that start as the parts of the first vectors by id and move `rounds` times; None without a usable vector."""
    rows = kept(vectors, id_col, vector_col, label_col)
    first = rows.orderBy(*by_id()).limit(1).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    if entries * length > BOOK_VALUES:
        raise ValueError(f"codebooks of {entries} x {length} numbers exceed {BOOK_VALUES}")
    rows = rows.where(F.size("vector") == length)
    start = rows.orderBy(*by_id()).limit(entries).collect()
    books = scaled(pa.array([r["vector"] for r in start], pa.list_(pa.float64())), length, scale)
    books = np.ascontiguousarray(books.reshape(len(start), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = moved(rows, Codebooks(books, scale))
    return Codebooks(books, scale)


def moved(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries after one round: each becomes the floored mean of the parts that are nearest to it."""
    parts, entries, width = books.values.shape
    shared = rows.sparkSession.sparkContext.broadcast(books.values)

    def run(batches):
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            vectors = scaled(batch.column(0), parts * width, books.scale)
            codes, _ = assigned(vectors, shared.value)
            for p in range(parts):
                np.add.at(sums, p * entries + codes[:, p], vectors[:, p * width : (p + 1) * width])
                counts += np.bincount(p * entries + codes[:, p], minlength=parts * entries)
        used = np.flatnonzero(counts)
        place = np.repeat(used, width)
        columns = [pa.array(place), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].ravel()), pa.array(counts[place])]
        yield pa.RecordBatch.from_arrays(columns, ["place", "d", "total", "n"])

    partial = rows.select("vector").mapInArrow(run, "place long, d long, total long, n long")
    out = books.values.reshape(-1, width).copy()
    sums = partial.groupBy("place", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out[sums["place"].to_numpy(), sums["d"].to_numpy()] = sums["total"].to_numpy() // sums["n"].to_numpy()
    return out.reshape(parts, entries, width)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, codes array<int>, error): the codes of each usable vector and its squared distance in scaled units."""
    rows = kept(vectors, id_col, vector_col, label_col, books.length)
    shared, scale = rows.sparkSession.sparkContext.broadcast(books.values), books.scale
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            book = shared.value
            codes, errors = assigned(scaled(batch.column(2), book.shape[0] * book.shape[2], scale), book)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * book.shape[0], pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(errors.sum(axis=1))], ["id", "label", "codes", "error"])

    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long")


def digests(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) by codebooks that are fitted to the same vectors."""
    books = fit(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    if books is None:
        empty = kept(vectors, id_col, vector_col, label_col).where(F.lit(False))
        return empty.select("id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).withColumnRenamed("id", id_col)
    found = written(encode(vectors, books, id_col, vector_col, label_col), "vector-codes")
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _assign(vectors: str, books: str) -> str:
    """SQL of the nearest entry by part: (vec_id, part, entry, d2)."""
    return f"""SELECT v.vec_id, v.part, b.entry, list_sum(list_transform(range(1, len(v.xs) + 1), lambda i: (v.xs[i] - b.ys[i]) * (v.xs[i] - b.ys[i])))::BIGINT AS d2 FROM {vectors} v JOIN {books} b USING (part)
    QUALIFY row_number() OVER (PARTITION BY v.vec_id, v.part ORDER BY d2, b.entry) = 1"""


def _move(books: str, found: str) -> str:
    """SQL of the books after a round."""
    mean = lambda: "(s - ((s % n) + n) % n) // n"
    return f"""SELECT b.part, b.entry, coalesce(m.ys, b.ys) AS ys FROM {books} b LEFT JOIN (
    SELECT part, entry, list({mean()} ORDER BY d) AS ys FROM (SELECT f.part, f.entry, u.d, sum(v.xs[u.d])::BIGINT AS s, count(*)::BIGINT AS n FROM {found} f JOIN parts v USING (vec_id, part) CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(xs)) FROM parts) + 1)) AS d) u GROUP BY ALL) GROUP BY part, entry) m USING (part, entry)"""


ORACLE_SQL = f"""
WITH rows AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)::BIGINT) AS xs FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(embedding) > 0),
parts AS (SELECT vec_id, p AS part, xs[p * len(xs) // {PARTS} + 1 : (p + 1) * len(xs) // {PARTS}] AS xs FROM rows, range({PARTS}) t(p)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, xs AS ys FROM parts QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES}),
a0 AS ({_assign("parts", "b0")}),
b1 AS ({_move("b0", "a0")}),
a1 AS ({_assign("parts", "b1")}),
b2 AS ({_move("b1", "a1")}),
a2 AS ({_assign("parts", "b2")}),
hashed AS (SELECT sha256(string_agg(array_to_string(ys, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d2)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN rows USING (vec_id), hashed
"""
