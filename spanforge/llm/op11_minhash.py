"""MinHash near-duplicates by one-permutation hashing with optimal densification (operator 11).

A text's set is its distinct five-word shingles, hashed once.  The top bits of a hash name one of BINS bins, and the
smallest hash in a bin is the bin's value: one permutation serves all bins.  An empty bin takes the value of the first
filled one in a fixed pseudo-random order of its own (optimal densification), so two sets of similarity s agree in a
bin with probability s, however small they are.  BANDS bands of ROWS bins are the keys of buckets.

Similar sets meet in a band with probability 1 - (1 - s^4)^32: at 0.85 all but 6 in 10^11 do.  Within buckets `stars`
takes candidate edges in the shape of stars, confirms them on the full sets and loses no link of a bucket.  Links are
exact: den * intersection >= num * union on 64-bit shingle hashes.

Texts of the same words are one node, named by 128 bits of their hash; copies cost one row and no pair.

Defined cases: a text of fewer than five words is one shingle, its whole sequence; null and word-less texts have an
empty set, link with nothing and are their own component; rows of one id keep a row each; rows of null id have a null
component unless a linked row has an id, and are kept if it is null; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, stars
from .common import keyed_texts, real_id, utf8, written
from .op9_simhash import LOWER, shingle_hashes

SHINGLE, NUM, DEN = 5, 85, 100
BANDS, ROWS = 32, 4
BINS_LOG = 7
BINS = 1 << BINS_LOG
#: Bins that an empty bin tries, in order.
TRIES = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: orders[bin] lists the bins that an empty bin looks into.
ORDERS = (mixed(np.arange(BINS * TRIES, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS_LOG)).astype(np.int64).reshape(BINS, TRIES)
SEEDS = mixed(np.arange(1, BINS + 1, dtype=np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The values of all bins of a set, given as sorted distinct hashes, one at least."""
    bins = (hashes >> np.uint64(64 - BINS_LOG)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint64)
    out[filled] = hashes[first]
    if len(filled) < BINS:
        full = np.zeros(BINS, bool)
        full[filled] = True
        empty = np.flatnonzero(~full)
        source = np.full(len(empty), filled[0])
        left, a = np.arange(len(empty)), 0
        while len(left) and a < TRIES:
            tries = ORDERS[empty[left], a : a + 64]
            hit = full[tries]
            done = hit.any(axis=1)
            source[left[done]] = tries[done, hit[done].argmax(axis=1)]
            left, a = left[~done], a + 64
        out[empty] = out[source]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key for each band; the bins' places go into it, so bands of equal values differ."""
    with np.errstate(over="ignore"):
        return mixed(mixed(values ^ SEEDS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, node, n, keys): what names a row's words, the size of its set and the keys of its buckets."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            raw, node, n, keys = data.tobytes(), [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = raw[a:b]
                hashes = np.unique(shingle_hashes(text, SHINGLE))
                node.append(xxhash.xxh3_128_digest(b" ".join(text.translate(LOWER).split())))
                n.append(len(hashes))
                keys.append(band_keys(signature(hashes)) if len(hashes) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), lists], ["_id", "_h", "node", "n", "keys"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "_id long, _h long, node binary, n long, keys array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, n, hashes) of (node, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            sets = [np.unique(shingle_hashes(raw[a:b], SHINGLE)).view(np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            sets = [np.sort(x) for x in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), lists], ["node", "n", "hashes"])

    return texts.select("node", "text").mapInArrow(run, f"node {dict(texts.dtypes)['node']}, n long, hashes array<long>")


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc id, n_shingles, component_id, kept): one row for each input row; kept is the one of its component's id."""
    rows = written(sketches(docs, id_col, text_col), "minhash-rows")
    least = F.min(F.struct("_id", "_h")).alias("k")
    nodes = written(rows.where("n > 0").groupBy("node").agg(least, F.first("keys").alias("keys")).select("node", "k._id", "k._h", "keys"), "minhash-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = nodes.select("node", "_id", "_h").join(wanted, "node", "left_semi")
        return shingle_sets(keyed_texts(docs, id_col, text_col).join(places, ["_id", "_h"]).dropDuplicates(["node"]))

    edges = stars.links(nodes.select("node", F.explode("keys").alias("key")), sets_of, num, den)
    named = nodes.join(components.roots(edges), "node", "left").select("node", "_id", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("_id").alias("component"))
    members = named.join(lowest, "root").select("node", "component")
    found = rows.join(members, "node", "left").select(real_id("_id").alias(id_col), F.col("n").alias("n_shingles"), real_id("component").alias("_component"), (F.col("n") > 0).alias("_worded"))
    component = F.when(F.col("_worded"), F.col("_component")).otherwise(F.col(id_col))
    return found.select(id_col, "n_shingles", component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (shingles SEMI JOIN shared USING (s)) a JOIN (shingles SEMI JOIN shared USING (s)) b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT met.a, met.b FROM met JOIN sizes x ON x.doc_id = met.a JOIN sizes y ON y.doc_id = met.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN sizes USING (doc_id)
"""
