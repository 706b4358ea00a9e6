"""SimHash near-duplicate detection with pigeonhole blocks (operator 9).

A fingerprint has 64 bits; two texts link when theirs differ in at most `distance` bits.  Cut a fingerprint into
b > distance blocks: a linked pair agrees in b - distance blocks at least, so joining on every combination of
b - distance blocks finds each link.  b grows with the number of distinct fingerprints until a combination has at least
as many values as there are fingerprints, so a block bucket holds a few rows whatever the size of the corpus.

Buckets of close fingerprints (copies) can still be large.  Up to `bucket_limit` rows are compared pairwise inside the
task and leave a spanning forest, never all pairs.  Larger buckets are not compared at all: with distance 4, two
fingerprints link exactly when some point lies within two bits of both (flip half of the differing bits), so every row
emits the points of its two-bit ball and rows that share a point link to the smallest of them.  That is linear in the
bucket, needs no limit on partners, and its shuffle is by point, which no group dominates.

Defined cases: null or word-less texts have fingerprint 0 and link like any other; equal texts share one fingerprint
and cost one row; null ids keep null component ids unless a linked row has an id; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from .common import keyed_texts, partitions, real_id, utf8, written

BITS = 64
#: Upper-case ASCII to lower case, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included; a text of fewer words is one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 where there are none."""
    n = len(hashes)
    if n == 0:
        return 0
    if n == 1:
        return int(hashes[0])
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 65536):
        ones += np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of a text's shingle hashes; bit i of the result is bit i of the hashes."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(_id, _h, fp): a signed 64-bit fingerprint for each row, and a hash of its text."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            raw = data.tobytes()
            prints = np.fromiter((fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["_id", "_h", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "_id long, _h long, fp long")


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of the block combinations for n distinct fingerprints; the last resort is one block for each bit pair."""
    blocks = next(b for b in range(distance + 2, BITS // 2) if 2 ** (BITS * (b - distance) // b) >= n)
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, hub) that join the linked members of one bucket; prints is sorted and distinct."""
    n = len(prints)
    label = np.arange(n)
    child, hub = [], []
    for i in range(n - 1):
        rest = label[i + 1 :] != label[i]
        if rest.any():
            near = i + 1 + np.flatnonzero(rest & (np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= distance))
            for j in near:
                if label[j] != label[i]:
                    child.append(j)
                    hub.append(i)
                    label[label == label[j]] = label[i]
    return prints[child], prints[hub]


def links(distinct: DataFrame, distance: int = 4, bucket_limit: int = 20000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    if distance % 2:
        raise ValueError("the distance must be even: balls of half of it meet exactly at linked pairs")
    spark = distinct.sparkSession
    n = max(2, distinct.count())
    masks = [signed(m) for m in block_masks(n, distance)]
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    sizes = keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = keys.join(sizes.where(F.col("n") <= bucket_limit).select("mask", "key"), ["mask", "key"])

    def compare(batches):
        # rows come sorted by (mask, key, fp); the last bucket of a batch may go on in the next one
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = np.flatnonzero((pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1]) | (pdf["mask"].to_numpy()[1:] != pdf["mask"].to_numpy()[:-1])) + 1
            done = int(cut[-1]) if len(cut) else 0
            held = pdf.iloc[done:]
            yield edges(pdf["fp"].to_numpy()[:done].view(np.uint64), [0, *cut.tolist()])
        if held is not None and len(held):
            yield edges(held["fp"].to_numpy().copy().view(np.uint64), [0, len(held)])

    def edges(prints, cuts):
        out = []
        pairs = [a for a, z in zip(cuts, cuts[1:]) if z - a == 2]
        at = np.array(pairs, np.int64)
        if len(at):
            near = at[np.bitwise_count(prints[at] ^ prints[at + 1]) <= distance]
            out.append((prints[near + 1], prints[near]))
        out += [forest(np.sort(prints[a:z]), distance) for a, z in zip(cuts, cuts[1:]) if z - a > 2]
        return pd.DataFrame({k: np.concatenate([x[i] for x in out]).view(np.int64) if out else np.zeros(0, np.int64) for i, k in enumerate(("a", "b"))})

    width = 4 * partitions(spark)
    compared = small.repartition(width, "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(compare, "a long, b long").distinct()
    large = keys.join(sizes.where(F.col("n") > bucket_limit).select("mask", "key"), ["mask", "key"]).select("fp").distinct()
    return compared.unionByName(ball_links(large, distance // 2))


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges between fingerprints at most 2 * radius bits apart, through common points radius bits from both."""
    flips = [signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(BITS), r)]

    def points(batches):
        around = np.array(flips, np.int64)
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for a in range(0, len(fp), 64):
                part = fp[a : a + 64]
                yield pd.DataFrame({"point": (part[:, None] ^ around[None, :]).ravel(), "fp": np.repeat(part, len(around))})

    shared = prints.mapInPandas(points, "point long, fp long")
    hubs = shared.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).where("b < z").select("point", "b")
    return shared.join(hubs, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def printed(name: str) -> Column:
    return F.lpad(F.lower(F.hex(name)), 16, "0")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, bucket_limit: int = 20000) -> DataFrame:
    """(doc id, fingerprint hex, component_id, group, text_hash): one row for each input row; group names a component."""
    prints = written(with_fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = written(prints.groupBy("fp").agg(F.min("_id").alias("first_id")), "simhash-nodes")
    edges = written(links(nodes.select("fp"), distance, bucket_limit), "simhash-links")
    roots = components.roots(edges)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = named.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(members, "fp").select(
        real_id("_id").alias(id_col), printed("fp").alias("fingerprint"), real_id("component_id").alias("component_id"), printed("root").alias("group"), F.col("_h").alias("text_hash")
    )
