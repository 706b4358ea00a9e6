import zlib

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import op2_langid


def test_held_out_accuracy(documents):
    found = {r["doc_id"]: r for r in op2_langid.identified(documents).collect()}
    rows = documents.select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(found[r["doc_id"]]["held_out"] for r in held)
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_awkward_rows(docs_of, documents):
    few = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    rows = [*few, (9001, None, "en"), (9002, "123 !?", "en"), (9003, "", None), (None, few[0][1], None), (9004, few[0][1], None), (9004, few[0][1], None), (9005, few[1][1] * 50, None)]
    found = op2_langid.identified(docs_of(rows)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert (by[9004]["lang_pred"], by[9004]["score"]) == (by[few[0][0]]["lang_pred"], by[few[0][0]]["score"])
    unknown = op2_langid.identified(docs_of([(1, "some words", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unknown] == [("und", 0.0)]
    assert op2_langid.identified(docs_of([])).collect() == []


def test_grams_keep_to_their_text():
    texts = ["ab", "", "a", "abc d", "é"]
    features, bounds = op2_langid.gram_features(texts)
    for i, t in enumerate(texts):
        alone, _ = op2_langid.gram_features([t])
        for k in range(3):
            assert (features[k][bounds[k][i] : bounds[k][i + 1]] == alone[k]).all() and len(alone[k]) == max(0, len(t) - k)


SPARSE = "label int, rest int, shard int, at array<int>, weight array<float>"


def sparse(rng, n, rest, classes=3, width=400):
    """Rows of a few features each, some of which tell the class."""
    rows = []
    for i in range(n):
        label = int(rng.integers(0, classes))
        at = np.unique(np.append(rng.integers(0, width, 12), 20 * label + rng.integers(0, 20, 3)))
        rows.append((label, rest, i % 2, at.astype(int).tolist(), rng.random(len(at)).astype(np.float32).astype(float).tolist()))
    return rows


def dense_trainer(rows, classes, rounds):
    """The published per-coordinate update over whole dense vectors, one example at a time; shards start alike and are averaged."""
    width = op2_langid.WIDTH + 1
    z, n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(z, n):
        w = -(z - np.sign(z) * op2_langid.L1) / ((op2_langid.BETA + np.sqrt(n)) / op2_langid.ALPHA + op2_langid.L2)
        w[np.abs(z) <= op2_langid.L1] = 0
        return w

    for turn in range(rounds):
        ends = []
        for shard in (0, 1):
            own = [r for r in rows if r["shard"] == shard]
            mz, mn = z.copy(), n.copy()
            for k in np.random.default_rng(turn).permutation(len(own)):
                x = np.zeros(width)
                x[own[k]["at"]], x[-1] = own[k]["weight"], 1
                w = weights(mz, mn)
                scores = x @ w
                p = np.exp(scores - scores.max())
                p /= p.sum()
                p[own[k]["label"]] -= 1
                g = np.outer(x, p)
                step = (np.sqrt(mn + g**2) - np.sqrt(mn)) / op2_langid.ALPHA
                mz, mn = mz + g - step * w, mn + g**2
            ends.append((mz, mn))
        z, n = (sum(e[i] for e in ends) / 2 for i in (0, 1))
    return weights(z, n)


def test_trainer_equals_a_dense_one(spark):
    rows = spark.createDataFrame(sparse(np.random.default_rng(5), 60, 0), SPARSE)
    ordered = rows.orderBy("shard", "label", F.hash("at")).collect()
    got = op2_langid.train(rows, 3, shards=2, rounds=2)
    want = dense_trainer(ordered, 3, 2)
    assert np.abs(got - want).max() < 1e-9 and (np.abs(want) > 0).sum() > 50
    assert ((got == 0) == (want == 0)).all()


def test_temperature_is_the_best_of_a_grid(spark):
    rng = np.random.default_rng(6)
    weights = np.zeros((op2_langid.WIDTH + 1, 3))
    for c in range(3):
        weights[20 * c : 20 * c + 20, c] = 3.0
    weights[:400] += rng.normal(0, 1.0, (400, 3))
    rows = sparse(rng, 200, 3)
    got = op2_langid.temperature(spark.createDataFrame(rows, SPARSE), weights)
    logits = np.array([(weights[at] * np.array(x)[:, None]).sum(axis=0) + weights[-1] for _, _, _, at, x in rows])
    label = np.array([r[0] for r in rows])
    size = np.bincount(label, minlength=3)

    def loss(t):
        logp = logits / t - np.log(np.exp(logits / t).sum(axis=1, keepdims=True))
        smooth = 1 / (size[label] + 3)
        return -(logp * smooth[:, None]).sum(axis=1).mean() - (logp[np.arange(len(label)), label] * size[label] * smooth).mean()

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 4000))
    best = grid[np.argmin([loss(t) for t in grid])]
    assert abs(np.log(got / best)) < 0.005
