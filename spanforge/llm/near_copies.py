"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At 0.8 two SimHash fingerprints differ in about 10 of 64 bits, in some pairs in 14 and more, and pigeonhole blocks for
14 bits take thousands of masks a text.  So operator 9's links find the closest copies, and operator 11's buckets (one
permutation, 32 bands of 4 bins) the rest: two texts of similarity 0.8 share a bucket but in 5 of 10^8 cases, and in
fewer the closer they are.  `stars` finds what the links within buckets connect: candidates in the shape of stars,
confirmed on the full sets, then pairs of a star's texts that share what sets them apart from its hub.

Candidates link only after their shingle sets have been compared.  Texts of one bucket are never gathered, nor paired
with each other; stored sets are compared and not texts.  (Buckets by the rarest fifth of a set's shingles would miss no
pair at all; they took 7.8 times the input on disk, beyond the check tool's limit.)

Defined cases: texts equal word by word (ASCII case aside) are one node; a text of fewer than five words is one shingle;
texts without words are one node; rows of one id and equal texts are alike; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, op9_simhash, stars
from .common import keyed_texts, utf8, written
from .op9_simhash import LOWER, majority, shingle_hashes
from .op11_minhash import band_keys, shingle_sets, signature

SHINGLE, NUM, DEN = 5, 4, 5


def sketches(docs: DataFrame) -> DataFrame:
    """(_id, _h, node, n, fp, keys): what names a row's words, its set's size, fingerprint and buckets."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            raw, node, n, fp, keys = data.tobytes(), [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                every = shingle_hashes(raw[a:b], SHINGLE)
                hashes = np.unique(every)
                node.append(xxhash.xxh3_128_digest(b" ".join(raw[a:b].translate(LOWER).split())))
                n.append(len(hashes))
                fp.append(majority(every))
                keys.append(band_keys(signature(hashes)) if len(hashes) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            prints = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), prints, lists], ["_id", "_h", "node", "n", "fp", "keys"])

    return keyed_texts(docs).mapInArrow(run, "_id long, _h long, node binary, n long, fp long, keys array<long>")


def link_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (hub, node) of texts that operator 9 links: fingerprints four bits apart at most, and equal ones."""
    worded = nodes.where("n > 0")
    first = written(worded.groupBy("fp").agg(F.min("node").alias("hub")), "near-prints")
    same = worded.join(first, "fp").where("node <> hub").select("hub", "node")
    near = written(op9_simhash.links(first.select("fp")), "near-simhash")
    one, two = first.select(F.col("fp").alias("a"), F.col("hub").alias("x")), first.select(F.col("fp").alias("b"), F.col("hub").alias("y"))
    return same.union(near.join(one, "a").join(two, "b").select(F.greatest("x", "y").alias("hub"), F.least("x", "y").alias("node")))


def near_groups(docs: DataFrame) -> DataFrame:
    """(_id, _h, group): one row for each input row; rows of one group are linked by near copies."""
    rows = written(sketches(docs), "near-rows")
    least = F.min(F.struct("_id", "_h")).alias("k")
    nodes = written(rows.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "keys")]).select("node", "k._id", "k._h", "n", "fp", "keys"), "near-nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = nodes.select("node", "_id", "_h").join(wanted, "node", "left_semi")
        return shingle_sets(keyed_texts(docs).join(places, ["_id", "_h"]).dropDuplicates(["node"]))

    buckets = nodes.select("node", F.explode("keys").alias("key"))
    roots = components.roots(stars.links(buckets, sets_of, NUM, DEN, link_pairs(nodes)))
    return rows.select("_id", "_h", "node").join(roots, "node", "left").select("_id", "_h", F.coalesce("root", "node").alias("group"))
