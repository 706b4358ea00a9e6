"""Links between similar sets that share a bucket, without all pairs of a bucket.

A bucket (key) holds nodes, and a node is a set of hashes.  Two sets link when den * intersection >= num * union.
`links` returns edges that connect exactly what the links between any two nodes of any bucket connect.

1. Star: each bucket has one hub, the node whose buckets are fullest (in a group of edited copies, the original), and a
   candidate edge from each other node to it.  A bucket of c nodes has c - 1 candidates.  They are confirmed on the full
   sets, which gives both = |x & hub| and so the size of the difference |x ^ hub|.
2. What a star can still hide is a link between two of its nodes, one of which at least isn't linked to the hub.  With
   D(x) = x ^ hub, sets x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| members, so with
   e(x) = (den + num) |D(x)| - (den - num) |x| they link exactly when

       2 (den + num) |D(x) & D(y)| >= e(x) + e(y),

   and the right side is above 0 where y isn't linked to the hub: such a pair shares members of its differences, not
   just members of the hub.  Edited copies have differences of their own, so few do.  In the order from rare to frequent
   within the star, the pair shares one among the first |D| - t + 1 members of both, with t from the least e of the
   others in the star.  Those prefixes are joined, filtered by what is left of both differences, and confirmed.

Nodes of a hot hub are dealt over several tasks with a copy of the hub in each; a frequent member of differences is
salted.  Sets are read as they stream by: a task holds one hub and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from .common import partitions, written

#: Nodes of a hub, or of a member of differences, that one task gets.
SHARE = 512


def linked(both: Column, n: Column, m: Column, num: int, den: int) -> Column:
    return den * both >= num * (n + m - both)


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Candidates (hub, node) of buckets (key, node)."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = written(buckets.join(sizes, "key"), "star-buckets")
    fullness = shared.groupBy("node").agg(F.sum("c").alias("full"))
    hubs = shared.join(fullness, "node").groupBy("key").agg(F.max(F.struct("full", "node")).alias("hub"))
    return shared.join(hubs.select("key", F.col("hub.node").alias("hub")), "key").where("node <> hub").select("hub", "node").distinct()


def beside_hub(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, salt, is_node, node, n, hashes): the sets of each hub's nodes, after a row of the hub itself for each salt."""
    dealt = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    nodes = pairs.join(dealt, "hub").select("hub", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(1).alias("is_node"), "node")
    hubs = dealt.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("is_node"), F.col("hub").alias("node"))
    rows = nodes.union(hubs).join(sets, "node").select("hub", "salt", "is_node", "node", "n", "hashes")
    return rows.repartition(partitions(pairs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "is_node")


def met_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray], list[np.ndarray]]]:
    """Of each batch of beside_hub: the rows that are nodes, with their set and their hub's."""
    hub = None
    for batch in batches:
        is_node, lists = batch.column(2).to_pylist(), batch.column(5)
        flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        at, own, hubs = [], [], []
        for i, node in enumerate(is_node):
            values = flat[bounds[i] : bounds[i + 1]]
            if node:
                at.append(i)
                own.append(values)
                hubs.append(hub)
            else:
                hub = values.copy()
        yield batch, at, own, hubs


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, n, m, both): the sizes of both sets of each pair and of what they share."""

    def run(batches):
        for batch, at, own, hubs in met_hubs(batches):
            both = [len(np.intersect1d(x, h, assume_unique=True)) for x, h in zip(own, hubs)]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(3).take(rows), batch.column(4).take(rows), pa.array(list(map(len, hubs)), pa.int64()), pa.array(both, pa.int64())], ["hub", "node", "n", "m", "both"]
            )

    kind = dict(sets.dtypes)["node"]
    return beside_hub(pairs, sets).mapInArrow(run, f"hub {kind}, node {kind}, n long, m long, both long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, delta): the members that only one of node and hub has."""

    def run(batches):
        for batch, at, own, hubs in met_hubs(batches):
            delta = [np.setxor1d(x, h, assume_unique=True) for x, h in zip(own, hubs)]
            bounds = pa.array(np.cumsum([0, *map(len, delta)]), pa.int32())
            rows = pa.array(at, pa.int64())
            lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([*delta, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(3).take(rows), lists], ["hub", "node", "delta"])

    kind = dict(sets.dtypes)["node"]
    return beside_hub(pairs, sets).mapInArrow(run, f"hub {kind}, node {kind}, delta array<long>")


def hidden_pairs(met: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (hub, node) between nodes of one star that aren't both linked to its hub and aren't connected yet."""
    both, n = F.col("both"), F.col("n")
    size = F.col("n") + F.col("m") - 2 * both
    apart = ~linked(both, n, F.col("m"), num, den)
    rooted = met.join(roots, "node", "left").select("hub", "node", "n", size.alias("size"), apart.alias("apart"), F.coalesce("root", "node").alias("root"))
    rooted = rooted.withColumn("e", (den + num) * F.col("size") - (den - num) * n)
    open_ = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("e").alias("least"), F.min(F.when(F.col("apart"), F.col("e"))).alias("least_apart"))
    open_ = open_.where((F.col("low") != F.col("high")) & F.col("least_apart").isNotNull()).select("hub", "least", "least_apart")
    # the members of the prefix that a node looks others up by, and of the one that it is found by if it is apart
    prefix = lambda other: F.greatest(F.lit(0), F.col("size") + 1 - F.greatest(F.lit(1), F.ceil((F.col("e") + other) / (2 * (den + num)))))
    nodes = rooted.join(open_, "hub").select("hub", "node", "n", "root", "size", "e", prefix(F.col("least_apart")).alias("looks"), F.when(F.col("apart"), prefix(F.col("least"))).otherwise(0).alias("shows"))
    nodes = written(nodes.where("looks > 0 OR shows > 0"), "star-open")
    members = written(differences(nodes.select("hub", "node"), sets).select("hub", "node", F.explode("delta").alias("x")), "star-members")
    often = members.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("c"))
    ordered = members.join(often, ["hub", "x"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))
    placed = nodes.join(ordered, ["hub", "node"]).select("hub", "node", "n", "root", "size", "e", "looks", "shows", F.posexplode(F.slice("xs", 1, F.greatest("looks", "shows").cast("int"))).alias("at", "x"))
    placed = placed.where("x.c > 1").select("hub", F.col("x.x").alias("x"), "node", "n", "root", "size", "e", "at", (F.col("at") < F.col("looks")).alias("looks"), (F.col("at") < F.col("shows")).alias("shows"))
    mixed = placed.groupBy("hub", "x").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("shows").alias("any"), F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    placed = written(placed.join(mixed.where("any AND low <> high").select("hub", "x", "salts"), ["hub", "x"]), "star-prefixes")
    one = placed.where("looks").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).alias("a")
    two = placed.where("shows").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    left = F.least(a("size") - a("at"), b("size") - b("at"))
    fits = (2 * (den + num) * left >= a("e") + b("e")) & (den * F.least(a("n"), b("n")) >= num * F.greatest(a("n"), b("n"))) & (a("root") != b("root"))
    same = (a("hub") == b("hub")) & (a("x") == b("x")) & (a("salt") == b("salt"))
    return one.join(two, same & fits).select(F.greatest(a("node"), b("node")).alias("hub"), F.least(a("node"), b("node")).alias("node")).distinct()


def links(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect what the links within buckets connect.

    sets_of gets a table of distinct nodes and returns (node, n, hashes), n their number and hashes sorted and distinct.
    more: candidate pairs (hub, node) besides those of the buckets.
    """
    pairs = star_pairs(buckets)
    pairs = written(pairs if more is None else pairs.union(more).distinct(), "star-pairs")
    nodes = pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct()
    sets = written(sets_of(nodes), "star-sets")
    near = linked(F.col("both"), F.col("n"), F.col("m"), num, den)
    met = written(confirmed(pairs, sets), "star-met")
    one = met.where(near).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    hidden = written(hidden_pairs(met, components.roots(one), sets, num, den), "star-hidden")
    two = confirmed(hidden, sets).where(near).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return written(one.union(two), "star-links")
