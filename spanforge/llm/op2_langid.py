"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams (operator 2).

Features are hashed character 1- to 3-grams of the lower-cased text, as relative frequencies times inverse document
frequencies; the latter count every learnable document.  Weights are trained by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of SAMPLE_PER_LANG documents a language (in expectation, chosen by a hash
of the id, whole texts): each shard of the sample runs its epoch in its own task and the leaders' states are averaged
between rounds.  A part of the sample that no weight has seen sets the temperature of the softmax.

A document is learnable if its language is known and crc32 of its id modulo 4 isn't 2.  Rest 3 calibrates, 0 and 1
train.  A prediction uses the text alone.

Defined cases: a null text or one without a letter is `und` with score 0; without any learnable document everything
is `und`; a null id has the rest of the empty text; equal texts get equal predictions; rows repeat as they are.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8, written

WIDTH = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 16.0
SAMPLE_PER_LANG = 1500
SHARDS = 8
ROUNDS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
UNKNOWN = "und"
SLICE_BYTES = 1_000_000
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def gram_features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the feature of every n-gram of all texts, and where each text's n-grams begin (and the end)."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in low], np.int64)
    ends = np.cumsum(sizes)
    features, bounds = [], []
    for order in ORDERS:
        many = np.maximum(sizes - order + 1, 0)
        code = np.full(max(0, len(points) - order + 1), order, np.uint32)
        for i in range(order):
            code += points[i : len(points) - order + 1 + i] * np.uint32(FACTORS[i])
            code ^= code >> np.uint32(15)
        code *= np.uint32(0x27D4EB2F)
        code >>= np.uint32(16)
        if order > 1 and len(texts) > 1:
            inside = np.ones(len(points) + 1, bool)
            for back in range(1, order):
                at = ends - back
                inside[at[sizes >= back]] = False
            code = code[inside[: len(code)]]
        features.append(code[: int(many.sum())])
        bounds.append(np.concatenate([[0], np.cumsum(many)]))
    return features, bounds


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def id_rest(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def text_batches(batch: pa.RecordBatch, column: int):
    texts = batch.column(column).fill_null("")
    _, offsets = utf8(texts)
    for a, b in text_slices(offsets, SLICE_BYTES):
        yield a, b, texts.slice(a, b - a).to_pylist()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents, over every row of the column text."""

    def run(batches):
        count, total = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for _, _, part in text_batches(batch, 0):
                total += len(part)
                features, bounds = gram_features(part)
                for a in range(0, len(part), 64):
                    z = min(a + 64, len(part))
                    seen = np.zeros((z - a, WIDTH), bool)
                    for code, bound in zip(features, bounds):
                        row = np.repeat(np.arange(z - a), np.diff(bound[a : z + 1]))
                        seen[row, code[bound[a] : bound[z]]] = True
                    count += seen.sum(axis=0)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], total))], ["feature", "n"])

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WIDTH + 1, np.int64)
    out[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:WIDTH], int(out[WIDTH])


def sparse_rows(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """(label, rest, shard, at, weight): features and TF-IDF values of each sampled row."""

    def run(batches):
        for batch in batches:
            for a, b, part in text_batches(batch, 3):
                features, bounds = gram_features(part)
                out = []
                for i in range(len(part)):
                    own = np.concatenate([c[z[i] : z[i + 1]] for c, z in zip(features, bounds)])
                    count = np.bincount(own, minlength=WIDTH)
                    at = np.flatnonzero(count)
                    out.append((at.astype(np.int32), (SCALE * count[at] / max(1, len(own)) * idf[at]).astype(np.float32)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([x for _, x in out], pa.list_(pa.float32()))],
                    ["label", "rest", "shard", "at", "weight"],
                )

    return sample.mapInArrow(run, "label int, rest int, shard int, at array<int>, weight array<float>")


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that minimise the linearised loss so far plus both penalties."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def epoch(rows: pd.DataFrame, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of follow-the-regularised-leader; the last feature is the constant 1."""
    for label, at, weight in zip(rows["label"], rows["at"], rows["weight"]):
        at = np.append(at, WIDTH)
        x = np.append(weight, 1.0)[:, None]
        zt, nt = z[at], n[at]
        w = leader(zt, nt)
        error = softmax((w * x).sum(axis=0))
        error[label] -= 1.0
        g = x * error
        more = nt + g * g
        z[at] = zt + g - (np.sqrt(more) - np.sqrt(nt)) / ALPHA * w
        n[at] = more


def train(rows: DataFrame, classes: int, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (features and constant, classes) from the rows of rest 0 and 1."""
    z, n = np.zeros((WIDTH + 1, classes)), np.zeros((WIDTH + 1, classes))
    dealt = rows.where("rest in (0, 1)")
    for turn in range(rounds):

        def run(frames, z=z, n=n, turn=turn):
            parts = [f for f in frames if len(f)]
            if not parts:
                return
            own = pd.concat(parts, ignore_index=True)
            for _, shard in own.groupby("shard"):
                mine_z, mine_n = z.copy(), n.copy()
                epoch(shard.iloc[np.random.default_rng(turn).permutation(len(shard))], mine_z, mine_n)
                at = np.flatnonzero((mine_n != n).any(axis=1))
                yield pd.DataFrame({"state": [pickle.dumps((at, mine_z[at], mine_n[at]))]})

        states = [pickle.loads(r["state"]) for r in dealt.repartition(shards, "shard").sortWithinPartitions("shard", "label", F.hash("at")).mapInPandas(run, "state binary").collect()]
        next_z, next_n = np.zeros_like(z), np.zeros_like(n)
        for at, own_z, own_n in states:
            next_z[at] += own_z - z[at]
            next_n[at] += own_n - n[at]
        z, n = z + next_z / max(1, len(states)), n + next_n / max(1, len(states))
    return leader(z, n)


def temperature(rows: DataFrame, weights: np.ndarray) -> float:
    """The temperature of least log loss on the rows of rest 3; 1 where there are none.

    Targets are smoothed by one row a class, or a part without an error would ask for no temperature at all.
    """

    def run(frames):
        for pdf in frames:
            logits = [(weights[at] * x[:, None]).sum(axis=0) + weights[WIDTH] for at, x in zip(pdf["at"], pdf["weight"])]
            yield pd.DataFrame({"label": pdf["label"], "logits": [x.tolist() for x in logits]})

    found = rows.where("rest = 3").mapInPandas(run, "label int, logits array<double>").toPandas()
    if not len(found):
        return 1.0
    logits, label = np.array(found["logits"].tolist()), found["label"].to_numpy()
    order = np.lexsort((*logits.T, label))
    logits, label = logits[order], label[order]
    size, classes = np.bincount(label, minlength=logits.shape[1])[label], logits.shape[1]
    target = np.repeat((1 / (size + classes))[:, None], classes, axis=1)
    target[np.arange(len(label)), label] = (size + 1) / (size + classes)
    loss = lambda t: -(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(axis=1).mean()
    low, high, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # with idf and scale inside; the last row is the constant
    temperature: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """The model of the learnable rows of docs, or None if there are none with a letter's chance of one."""
    rest = id_rest(id_col)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (rest != 2))
    learnable = known.select(F.col(lang_col).alias("lang"), rest.cast("int").alias("rest"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(7)).alias("draw"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in learnable.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    frequency, total = document_frequencies(learnable.select("text"))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    share = F.lit(None).cast("double")
    label = F.lit(None).cast("int")
    for i, lang in enumerate(langs):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / sizes[lang]))).otherwise(share)
        label = F.when(F.col("lang") == lang, F.lit(i)).otherwise(label)
    drawn = F.pmod("draw", F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    sample = learnable.where(drawn).select(label.alias("label"), "rest", F.pmod(F.shiftright("draw", 32), F.lit(SHARDS)).cast("int").alias("shard"), "text")
    rows = written(sparse_rows(sample, idf), "langid-sample")
    weights = train(rows, len(langs))
    heat = temperature(rows, weights)
    weights = weights * np.append(SCALE * idf, 1.0)[:, None]
    return Model(langs, weights.astype(np.float32), heat)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred and score of their whole text; docs must not have columns of these names."""
    at = docs.columns.index(text_col)
    columns = [np.ascontiguousarray(model.weights[:WIDTH, c]) for c in range(len(model.langs))] if model else []

    def score(part: list[str]) -> tuple[list[str], np.ndarray]:
        lettered = np.array([has_letter(t) for t in part], bool)
        if not model:
            return [UNKNOWN] * len(part), np.zeros(len(part))
        features, bounds = gram_features(part)
        logits = np.zeros((len(part), len(columns)))
        many = np.maximum(1, sum(np.diff(b) for b in bounds))
        for code, bound in zip(features, bounds):
            some = np.flatnonzero(np.diff(bound))
            for c, column in enumerate(columns):
                if len(some):
                    logits[some, c] += np.add.reduceat(column[code], bound[some], dtype=np.float64)
        chance = softmax((logits / many[:, None] + model.weights[WIDTH]) / model.temperature)
        best = chance.argmax(axis=1)
        return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, chance[np.arange(len(part)), best], 0.0)

    def run(batches):
        for batch in batches:
            for a, b, part in text_batches(batch, at):
                lang, chance = score(part)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lang, pa.string()), pa.array(chance, pa.float64())], [*own.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): fit on the learnable rows, predict all."""
    found = predict(docs.select(id_col, text_col), fit(docs, id_col, text_col, lang_col), text_col)
    return found.select(id_col, (id_rest(id_col) == 2).alias("held_out"), "lang_pred", "score")
