"""Operator 11 and the stars it shares with the pipeline: SQL, brute force, awkward rows, candidates in proportion."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import op11_minhash, queries, stars
from test_rest import AWKWARD


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {b" ".join(words)} if words else set()


def brute_force(rows, num=85, den=100):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(s), least[root(i)], r[0] == least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def families(rng, groups=12, size=25, base=120, most=6):
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
        rows += [edited(rng, words, rng.randrange(most)) for _ in range(size)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(op11_minhash.ORACLE_SQL).fetchall()
    assert found(queries.op11_minhash_groups(spark, sf)) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_families(docs_of, seed):
    rows = families(random.Random(seed))
    assert found(op11_minhash.minhash_groups(docs_of(rows))) == brute_force(rows)


def test_small_sets_chains_and_case(docs_of):
    words = [f"v{i}" for i in range(300)]
    # a chain: each text lacks two more words at its end than the one before
    rows = [(i, " ".join(words[: 300 - 8 * i])) for i in range(12)] + [(100, " ".join(words[:10])), (101, " ".join(words[:11])), (102, " ".join(words[:9])), (103, "A b"), (104, "a  B"), (105, "a b c"), (106, "É é"), (107, "é é")]
    assert found(op11_minhash.minhash_groups(docs_of(rows))) == brute_force(rows)


def test_awkward_rows(docs_of):
    rows = op11_minhash.minhash_groups(docs_of(AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by = {(r["doc_id"], r["n_shingles"]): r for r in rows}
    assert [by[i, 0]["component_id"] for i in (1, 2, 3)] == [1, 2, 3] and by[None, 0]["component_id"] is None and by[None, 0]["kept"]
    assert by[None, 1]["component_id"] is None and by[6, 1]["kept"] and by[5, 5]["component_id"] == 5
    assert op11_minhash.minhash_groups(docs_of([])).collect() == []


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    for n in (3, 40, 2000):
        agree = []
        for _ in range(60):
            base = rng.integers(0, 2**64, n + n // 3 + 1, dtype=np.uint64)
            a, b = np.unique(base[:n]), np.unique(base[n // 3 + 1 :])
            want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((op11_minhash.signature(a) == op11_minhash.signature(b)).mean() - want)
        assert abs(np.mean(agree)) < 0.08, n


def candidates(spark, texts, monkeypatch):
    seen = []
    real = stars.written

    def counted(df, name, **more):
        out = real(df, name, **more)
        if name in ("star-pairs", "star-hidden"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(stars, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = found(op11_minhash.minhash_groups(docs))
    monkeypatch.undo()
    return sum(seen), rows


def test_candidates_grow_with_the_texts(spark, monkeypatch):
    """Texts of one base, just too unlike each other: no pairs of all."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [edited(rng, words, 4) for _ in range(400)]
    few, rows = candidates(spark, texts[:100], monkeypatch)
    many, all_rows = candidates(spark, texts, monkeypatch)
    assert all_rows == brute_force(list(enumerate(texts)))
    assert many < 400 * 40 and many < 8 * max(few, 100)


def test_a_hot_hub_is_dealt_over_tasks(docs_of, monkeypatch):
    monkeypatch.setattr(stars, "SHARE", 3)
    rows = families(random.Random(7), groups=2, size=60)
    assert found(op11_minhash.minhash_groups(docs_of(rows))) == brute_force(rows)


def test_other_thresholds(docs_of):
    rows = families(random.Random(9), groups=5)
    assert found(op11_minhash.minhash_groups(docs_of(rows), num=7, den=10).withColumn("kept", F.col("kept"))) == brute_force(rows, 7, 10)
