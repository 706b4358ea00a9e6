"""Operator 12: SQL, a plain full search, awkward vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from spanforge.llm import op12_vector_codes as op12
from spanforge.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, error string, code string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id -> code, error, label_error) and the books, by Python integers and a full search."""
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: r[0])
    width = len(good[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in good:
                own.setdefault(near(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    out, by_label = {}, {}
    for i, v, label in good:
        codes = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        out[i] = ("".join(f"{c:02x}" for c in codes), error, label)
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {i: (code, error, by_label[label], sha) for i, (code, error, label) in out.items()}


def found(df):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()}


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {r[0]: r[1:] for r in con.execute(op12.ORACLE_SQL).fetchall()}
    assert found(queries.op12_partial_distance_codes(spark, sf)) == want


@pytest.mark.parametrize("rows_of", [30, 200])
def test_equals_a_full_search(spark, rows_of):
    rng = np.random.default_rng(rows_of)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.05, 32).round(2)], int(i) % 3 or None) for i in rng.permutation(rows_of)]
    assert found(op12.digests(table(spark, rows))) == plain(rows)


def test_nearest_is_a_full_search_with_ties():
    rng = np.random.default_rng(1)
    for width in (1, 3, 8):
        block, book = rng.integers(-3, 4, (5000, width)), rng.integers(-3, 4, (40, width))
        index, best = op12.nearest(block, book)
        every = ((block[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_awkward_vectors(spark):
    good = [(i, [i / 7 + d for d in range(16)], 1 if i else None) for i in range(5)]
    bad = [(10, None, 1), (11, [], 1), (12, [1.0] * 15 + [None], 1), (13, [1.0] * 15 + [float("nan")], 1), (14, [float("-inf")] + [1.0] * 15, None), (15, [1.0] * 32, 1)]
    rows = [*good, *bad]
    assert found(op12.digests(table(spark, rows))) == plain(good)
    again = op12.digests(table(spark, [*good, good[0], (None, [0.5] * 16, None)])).collect()
    assert len(again) == 7 and sum(r["vec_id"] is None for r in again) == 1
    assert op12.digests(table(spark, [])).collect() == [] and op12.digests(table(spark, bad[:5])).collect() == []


def test_limits_are_errors(spark):
    with pytest.raises(ValueError, match="equal parts"):
        op12.fit(table(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="64 bits"):
        op12.fit(table(spark, [(1, [1e30] * 16, 1)]))


def test_decoded_vectors_are_near(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = op12.fit(vectors)
    rows = {r["id"]: r for r in op12.encode(vectors, books).collect()}
    for r in vectors.limit(20).collect():
        code = rows[r["vec_id"]]
        back = books.decoded(np.array([code["codes"]]))[0] * books.scale
        assert round(((np.floor(np.array(r["embedding"], np.float64) * 256) - back) ** 2).sum()) == code["error"]
