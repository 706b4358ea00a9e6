import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanforge.llm import op1_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(rows, texts):
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= 2048 for e in ends.values())
    return len(ends), sum(ends.values())


def test_small_table(documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    used, tokens = verify(op1_packing.packed_documents(documents, PATH).collect(), texts)
    assert used <= -(-tokens // 2048) * 1.02 + 1


def test_awkward_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "ΟΔΟΣ Σ <|endoftext|> ﬁ"), (4, "word " * 5000), (5, "same"), (5, "same"), (None, "x"), (7, "\x1c 　\x00")]
    verify(op1_packing.packed_documents(docs_of(rows), PATH).collect(), rows)
    assert op1_packing.packed_documents(docs_of([]), PATH).collect() == []


def test_plan_covers_every_rank_once_within_capacity():
    rng = random.Random(3)
    for counts in ({2048: 5}, {1: 3}, {700: 10, 650: 11, 1400: 7, 20: 50}, dict(Counter(rng.randint(1, 2048) for _ in range(3000)))):
        moves = op1_packing.plan(counts)
        fill, seen = Counter(), Counter()
        for length, first, last, sequence in moves.itertuples(index=False):
            for r in range(first, last):
                seen[length, r] += 1
                fill[sequence + r - first] += length
        assert seen == Counter({(n, r): 1 for n, c in counts.items() for r in range(c)})
        assert max(fill.values()) <= 2048
        assert len(fill) <= -(-sum(n * c for n, c in counts.items()) // 2048) * 1.6 + 1


def best_fit_decreasing(lengths, capacity=2048):
    """Plain best fit, piece by piece: the longest first, into the least room that fits."""
    from bisect import bisect_left, insort

    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        if i == len(rooms):
            used += 1
            room = capacity
        else:
            room = rooms.pop(i)
        insort(rooms, room - n)
    return used


def martello_toth(lengths, capacity=2048):
    """The bound L2: large pieces need sequences of their own, and others what their room can't hold."""
    x, best = np.array(lengths), 0
    for a in [0, *sorted(set(x[x <= capacity // 2].tolist()))[::10]]:
        alone, half, small = x[x > capacity - a], x[(x <= capacity - a) & (x > capacity // 2)], x[(x <= capacity // 2) & (x >= a)]
        more = int(small.sum()) - (len(half) * capacity - int(half.sum()))
        best = max(best, len(alone) + len(half) + max(0, -(-more // capacity)))
    return best


def test_plans_are_no_worse_than_best_fit_and_near_the_bound():
    rng = np.random.default_rng(1)
    tight = {"uniform": rng.integers(1, 2049, 3000), "halves": rng.integers(683, 1366, 1500), "documents": np.clip(rng.lognormal(5.5, 1, 3000).astype(int), 1, 2048)}
    loose = {"thirds": rng.integers(500, 901, 3000), "few": rng.choice([400, 600, 700, 900], 3000), "cut": np.concatenate([np.full(500, 2048), rng.integers(1, 400, 2000)])}
    for name, lengths in {**tight, **loose}.items():
        used = op1_packing.sequences(op1_packing.plan(dict(Counter(lengths.tolist()))))
        assert used <= best_fit_decreasing(lengths.tolist()), name
        if name in tight:
            assert used <= 1.01 * martello_toth(lengths.tolist()), name


def test_configurations_are_feasible():
    sizes, demand = np.array([1500, 900, 700, 690]), np.array([10, 12, 9, 9])
    left = demand.copy()
    for config, times in op1_packing.configurations(sizes, demand, 2048):
        assert (config * sizes).sum() <= 2048
        left -= config * times
    assert (left >= 0).all()


def test_characters_newer_than_this_python(docs_of):
    """Letters that are unassigned here go to the library, which may lower or cut them otherwise."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"Ab {chr(c)}{chr(c)}x Cd" for c in (0x1C89, 0xA7CB, 0xA7CC, 0x10D50, 0x378, 0xE9, 0x3A3)]
    got = op1_packing.tokenizer(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
