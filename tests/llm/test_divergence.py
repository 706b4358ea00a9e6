"""Operator 13: SQL, exact brute force, runs that cross batches, awkward rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from spanforge.llm import op13_divergence as op13
from spanforge.llm import queries
from test_rest import AWKWARD

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_docs=10, top=10):
    """rows: (id, text, lang, source)."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by = Counter(), {}
        for _, source, terms in (d for d in docs if d[0] == lang):
            df.update(set(terms))
            by.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in df.items() if n >= min_docs]
        every = Counter()
        for c in by.values():
            every.update(c)
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [("pair", t, sum(f(p[s][x], p[t][x]) for x in kept)) for t in by if t != s]
            terms = [("term", x, f(p[s][x], q[x])) for x in kept if by[s][x] > 0 and p[s][x] > q[x]]
            for part, most in ((pairs, None), (terms, top)):
                ranked = sorted(part, key=lambda r: (-r[2], r[1].encode()))[:most]
                out += [(lang, s, *r, i) for i, r in enumerate(ranked, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(seed, docs=150):
    rng = np.random.default_rng(seed)
    words = ["The", "é", "naïve", "x1y", "don't", "Ähre", "ß", *(f"{a}{b}" for a in "abcdef" for b in "qrstuvwxyz")]
    weight = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=weight / weight.sum())), ["en", "de", None][i % 3], ["a", "b", "c", None, "é"][int(rng.integers(0, 5))]) for i in range(docs)]


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert found(queries.op13_source_divergence(spark, sf)) == sorted(con.execute(op13.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("chunk", [7, 10**6])
def test_equals_brute_force(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(op13, "CHUNK", chunk)
    rows = corpus(chunk)
    assert found(op13.audit(docs_of(rows))) == brute_force(rows)


def test_runs_that_cross_batches(spark, docs_of):
    rows = corpus(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert found(op13.audit(docs_of(rows))) == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_awkward_rows_and_groups_without_terms(docs_of):
    rows = [(r[0], r[1], "en" if i % 2 else None, f"s{i % 3}") for i, r in enumerate(AWKWARD)] + [(i, "one two", "fr", "h") for i in range(9)] + [(50, None, "fr", "k"), (51, "9 %", "it", "z")]
    assert found(op13.audit(docs_of(rows))) == brute_force(rows)
    rows += [(99, "two", "fr", "q")]
    assert found(op13.audit(docs_of(rows))) == brute_force(rows)
    assert op13.audit(docs_of([])).collect() == []


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 5, 10**13 - 7, 9 * 10**12]), np.array([3, 7, 10**13, 9 * 10**13], np.int64)
    assert op13.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, total)]
