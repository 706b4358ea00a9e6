"""Operators 4 and 7 against brute force, on the small table and on awkward rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import op4_suffix_buckets, op7_fm_index, repeats


def brute(rows, cut, width):
    """{(id, text): removed flags} by comparing every window with those of smaller ids."""
    first = {}
    key = lambda i: 2**63 - 1 if i is None else i
    units = [(key(i), t, cut(t or "")) for i, t in rows]
    for i, _, u in units:
        for p in range(len(u) - width + 1):
            w = tuple(u[p : p + width])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t, u in units:
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - width + 1):
            if first[tuple(u[p : p + width])] < i:
                gone[p : p + width] = True
        out[i, t] = (u, gone)
    return out


def bytes_of(text):
    return list(text.encode())


def words_of(text):
    return text.encode().split()


def check(rows, found4, found7):
    want = brute(rows, bytes_of, 50)
    assert len(found4) == len(rows)
    by_id = {}
    for (i, t), v in want.items():
        by_id.setdefault(i, []).append(v)
    for r in found4:
        i = 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
        options = set()
        for u, gone in by_id[i]:
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            options.add((len(u), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in options, r["doc_id"]
    want = brute(rows, words_of, 13)
    by_id = {}
    for (i, t), v in want.items():
        by_id.setdefault(i, []).append(v)
    for r in found7:
        i = 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
        options = {(len(u), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(u, gone) if not g)).hexdigest()) for u, gone in by_id[i]}
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) in options, r["doc_id"]


def both(docs):
    return op4_suffix_buckets.digests(op4_suffix_buckets.deduplicated(docs)).collect(), op7_fm_index.digests(op7_fm_index.deduplicated(docs)).collect()


def test_small_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(rows, *both(documents))


def test_awkward_rows(docs_of):
    rng = random.Random(5)
    words = ["alpha", "be", "gamma,", "é", "漢字", "ten"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9999)) for _ in range(n))
    rows = [(i, prose(20) + "\n\t" + passage + " " + prose(5)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n "), (23, "a" * 3000), (24, "a" * 70), (25, "short"), (None, passage), (None, prose(60)), (30, passage), (30, passage), (30, prose(30) + passage)]
    rows += [(40, "x y " * 400), (41, "x y " * 30), (7000000000, prose(3000) + passage)]
    check(rows, *both(docs_of(rows)))


def test_many_null_ids(docs_of):
    rng = random.Random(8)
    prose = lambda n: " ".join("w" + str(rng.randrange(99999)) for _ in range(n))
    passage, other = prose(30), prose(30)
    rows = [(None, prose(25) + " " + passage + " " + prose(3)) for _ in range(60)] + [(None, prose(9) + " " + other) for _ in range(20)]
    rows += [(3, prose(4) + " " + passage), (4, other[:40]), (None, None), (None, rows[0][1])]
    check(rows, *both(docs_of(rows)))


def hot_rows(n):
    """One phrase of eight words in every text, whole passages in some, and surroundings that nobody shares but copies."""
    rng = random.Random(11)
    prose = lambda k: " ".join("w" + str(rng.randrange(10**6)) for _ in range(k))
    phrase, passage = "each of these eight words stands in everything", prose(16)
    rows = [(i, f"{prose(9)} {phrase} {prose(9)}") for i in range(n)]
    return rows + [(n + i, f"{prose(3)} {passage} {phrase} {prose(rng.randrange(2, 9))}") for i in range(n // 4)] + [(2 * n + i, rows[i][1]) for i in range(n // 10)]


def test_hot_anchors(monkeypatch, docs_of):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 20)
    rows = hot_rows(400)
    check(rows, *both(docs_of(rows)))


@pytest.mark.parametrize("method", [op4_suffix_buckets.METHOD, op7_fm_index.METHOD])
def test_hot_anchors_spread(method):
    """The contexts of a phrase that every text has don't meet in one bucket."""
    n, rows = 16, hot_rows(3000)
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part])], ["_id", "text"]) for part in (rows[a : a + 500] for a in range(0, len(rows), 500))]
    asked = [r for b in repeats.ask(method, n)(iter(batches)) for r in b.to_pylist()]
    widest = {}
    for limit in (20, 10**9):
        answers = [r for k in range(n) for b in repeats.answer(n, limit)(iter([pa.RecordBatch.from_pylist([r for r in asked if r["bucket"] == k])])) for r in b.to_pylist()]
        found = {r["_id"]: r["numbers"] for k in range(n) for b in repeats.gather(iter([pa.RecordBatch.from_pylist([r for r in answers if r["bucket"] == k])])) for r in b.to_pylist()}
        mine = [(i, 0, t, found[i]) for i, t in rows if i in found]
        sizes = np.zeros(n, int)
        for a in range(0, len(mine), 500):
            columns = list(zip(*mine[a : a + 500]))
            batch = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.binary())], ["_id", "_h", "text", "numbers"])
            for r in (r for b in repeats.offer(method, n)(iter([batch])) for r in b.to_pylist() if r["kind"] == 0):
                sizes[r["bucket"]] += len(repeats.unpacked(r["sizes"], "u8", "u4")[0])
        widest[limit] = sizes.max() / np.median(sizes)
    assert widest[20] < 2 < widest[10**9]


def test_empty_table(docs_of):
    assert both(docs_of([])) == ([], [])


def test_long_texts_are_cut_into_pieces(monkeypatch, docs_of):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 2000).astype(np.uint8)
    whole = op4_suffix_buckets.byte_symbols(data, np.array([0, 2000]))
    row, number, first, last, key = repeats.runs(whole, 50, 20)
    assert (row == 0).all() and (number == np.arange(len(row))).all()
    assert first[0] == 0 and last[-1] == 1950 and (first[1:] == last[:-1] + 1).all()
    assert (key == whole.hashes[[int(np.argmin(whole.hashes[p : p + 31] >> np.uint64(24))) + p for p in first]]).all()


def test_refinement_matches_strings():
    rng = np.random.default_rng(2)
    contexts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (50, 51, 80, 120)] + [b"a" * 90]
    ids = np.array([9, 4, 7, 1, 3])
    least, windows = op4_suffix_buckets.smallest_ids(contexts, ids, 50)
    table = {}
    for c, i in zip(contexts, ids):
        for p in range(len(c) - 49):
            table[c[p : p + 50]] = min(table.get(c[p : p + 50], 99), i)
    assert windows.tolist() == [len(c) - 49 for c in contexts]
    assert least.tolist() == [table[c[p : p + 50]] for c in contexts for p in range(len(c) - 49)]


@pytest.mark.parametrize("seed", [0, 1])
def test_fm_index_counts(seed):
    rng = np.random.default_rng(seed)
    words = np.append(rng.integers(1, 6, 400), 0)
    index = op7_fm_index.FmIndex(words, 5)
    ends = np.arange(5, 400)
    low, high, match = index.intervals(words, ends, 5)
    text = words.tolist()
    for e, a, b, m in zip(ends, low, high, match):
        assert m == 5 and b - a == sum(text[p : p + 5] == text[e - 5 : e] for p in range(len(text) - 4))
