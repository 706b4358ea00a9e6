"""What readers see: gap-filled rolling means, top-and-other folds, bars, rates of drops, bucket widths, formats."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feeds import fuzzy

#: Bucket widths to choose from, in seconds.
WIDTHS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600)
MOST_POINTS = 1500


def bucket_width(span: int, most: int = MOST_POINTS) -> int:
    """The smallest width that keeps a chart of `span` seconds within `most` points."""
    return next((w for w in WIDTHS if span / w <= most), math.ceil(span / most))


def filled(series: DataFrame, keys: list[str], width: int, at: str = "at", value: str = "value") -> DataFrame:
    """The series of each key with zeros in empty buckets between its first and last."""
    span = series.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_z", F.lit(width))).alias(at))
    return grid.join(series.select(*keys, at, value), [*keys, at], "left").select(*keys, at, F.coalesce(value, F.lit(0)).alias(value))


def rolling_mean(series: DataFrame, keys: list[str], n: int, at: str = "at", value: str = "value") -> DataFrame:
    """Mean of the last n buckets, of those there are at the beginning."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-(n - 1), 0)
    return series.withColumn("mean", F.avg(value).over(w))


def stretches(series: DataFrame, keys: list[str], width: int, at: str = "at") -> DataFrame:
    """series with segment: it grows after a gap of more than 30 s and two buckets."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > max(30, 2 * width), F.lit(True))
    return series.withColumn("_new", new.cast("int")).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def top_and_other(df: DataFrame, label: str, value: str, n: int = 8) -> DataFrame:
    """(label, value) of the n largest sums, the rest as one row "Other (m)"."""
    sums = df.groupBy(label).agg(F.sum(value).alias(value))
    top = sums.orderBy(F.desc(value), label).limit(n).select(F.col(label).alias("_label"), F.lit(True).alias("_top"))
    # a null label is a label like any other
    told = sums.join(F.broadcast(top), F.col(label).eqNullSafe(F.col("_label")), "left")
    rest = told.where("_top is null").agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("m")).where("m > 0")
    return told.where("_top").select(F.col(label).cast("string").alias(label), value).unionByName(rest.select(F.format_string("Other (%d)", "m").alias(label), value))


def natural_key(label: Column) -> Column:
    """Sorts labels as people do: runs of digits by their value, letters whatever their case."""
    runs = F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)"), lambda x: x != "")
    value = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(value(x)).cast("string"), 4, "0"), value(x))).otherwise(F.concat(F.lit("1"), x)))


def sort_tree(rows: DataFrame, key: str | None, descending: bool = True) -> DataFrame:
    """rows (path, label, rank, metrics) with rank by a metric, or by name if key is null, among each node's siblings.

    Ties keep their order, and a metric that a row lacks counts as 0.
    """
    by = natural_key(F.col("label")) if key is None else F.coalesce(F.col(key), F.lit(0))
    parent = Window.partitionBy(F.size("path"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).orderBy(by.desc() if descending else by.asc(), "rank")
    return rows.withColumn("rank", F.row_number().over(parent))


def filter_tree(rows: DataFrame, query: str) -> DataFrame:
    """Rows (path, label, ...) of a tree that a search leaves, with hit, open and score.

    A hit keeps all that is below it, and whatever lies above hits stays as their context.  A row's score is what its
    best way down to a hit adds up to: 200 and the match's own score for each hit on it.  Rows above a hit open by
    themselves.  An empty query keeps all rows, without hits.  Each row looks at its own ancestors alone.
    """
    if not query.strip():
        return rows.withColumn("hit", F.lit(False)).withColumn("open", F.lit(False)).withColumn("score", F.lit(0.0))
    tree = rows.where(F.size("path") > 0)
    hits = fuzzy(tree, "label", query).select("path", (F.col("score") + 200).alias("_own"))
    upward = lambda df: df.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))))
    own = hits.select(F.col("path").alias("_up"), "_own")
    met = upward(tree.select("path")).join(own, "_up", "left")
    # of each row: what hits on its way add up to, with and without itself
    sums = met.groupBy("path").agg(F.coalesce(F.sum("_own"), F.lit(0.0)).alias("_with"), F.coalesce(F.sum(F.when(F.col("_up") != F.col("path"), F.col("_own"))), F.lit(0.0)).alias("_without"), F.max(F.when(F.col("_up") == F.col("path"), F.lit(True))).alias("_row"))
    hit_sums = sums.join(hits.select("path"), "path", "left_semi").select("path", "_with")
    best = upward(hit_sums).groupBy(F.col("_up").alias("path")).agg(F.max("_with").alias("_best"), F.max(F.size("path")).alias("_deepest"))
    marked = sums.select("path", "_with", "_without").join(best, "path", "left").join(hits, "path", "left")
    kept = marked.where(F.col("_best").isNotNull() | (F.col("_without") > 0))
    score = F.coalesce(F.col("_best") - F.col("_without"), F.lit(0.0))
    return tree.join(kept, "path").select(*rows.columns, F.col("_own").isNotNull().alias("hit"), F.coalesce(F.col("_deepest") > F.size("path"), F.lit(False)).alias("open"), score.alias("score"))


#: Bars of abilities, and attackers that have a segment of their own in each.
MOST_BARS, MOST_SEGMENTS = 14, 8


def ability_bars(rows: DataFrame, bars: int = MOST_BARS, segments: int = MOST_SEGMENTS) -> DataFrame:
    """(bar, label, segment, attacker, total): the largest abilities as bars, cut into their attackers.

    rows: (path, label, total) of a query by spell and player.  Abilities beyond the largest are one bar "Other (n)";
    attackers beyond the overall largest are one segment "Other".  Both orders are kept as bar and segment, from 1; equal
    sums go by name.
    """
    top = rows.where(F.size("path") == 1).select(F.element_at("path", 1).alias("_spell"), "label", "total")
    parts = rows.where(F.size("path") == 2).select(F.element_at("path", 1).alias("_spell"), F.element_at("path", 2).alias("_who"), F.col("total").alias("_part"))
    first = top.orderBy(F.desc("total"), "label").limit(bars).withColumn("bar", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "label")))
    loud = parts.groupBy("_who").agg(F.sum("_part").alias("_all")).orderBy(F.desc("_all"), "_who").limit(segments)
    loud = loud.withColumn("segment", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_all"), "_who"))).select("_who", "segment")
    count = top.agg(F.count(F.lit(1)).alias("_n"))
    placed = parts.join(F.broadcast(first.select("_spell", "label", "bar")), "_spell", "left").join(F.broadcast(loud), "_who", "left").crossJoin(F.broadcast(count))
    name = F.coalesce("label", F.format_string("Other (%d)", F.col("_n") - bars))
    who = F.when(F.col("segment").isNotNull(), F.col("_who")).otherwise("Other")
    return placed.groupBy(F.coalesce("bar", F.lit(bars + 1)).alias("bar"), name.alias("label"), F.coalesce("segment", F.lit(segments + 1)).alias("segment"), who.alias("attacker")).agg(F.sum("_part").alias("total"))


def drop_rates(drops: DataFrame, kills: DataFrame, source: str = "target", item: str = "item", victim: str = "victim") -> DataFrame:
    """(source, item, drops, kills, rate): drops of each source per hundred kills of it, whatever its case; 0 without kills."""
    got = drops.where(F.col(item).isNotNull()).groupBy(F.lower(source).alias("source"), item).agg(F.sum("quantity").alias("drops"))
    dead = kills.groupBy(F.lower(victim).alias("source")).agg(F.count(F.lit(1)).alias("kills"))
    n = F.coalesce("kills", F.lit(0))
    return got.join(dead, "source", "left").select("source", item, "drops", n.alias("kills"), F.when(n > 0, 100.0 * F.col("drops") / n).otherwise(0.0).alias("rate"))


def kill_totals(kills: DataFrame) -> DataFrame:
    """(mob, kills, zones, last): of samples (mob, zone, samples, last_killed) by name, whatever its case, most killed first."""
    rows = kills.groupBy(F.lower(F.trim("mob")).alias("_key")).agg(F.min("mob").alias("mob"), F.sum("samples").alias("kills"), F.sort_array(F.collect_set("zone")).alias("zones"), F.max("last_killed").alias("last"))
    return rows.orderBy(F.desc("kills"), "mob").drop("_key")


#: Fixed value: a lane of more bands than this is not drawn.
LANE_MOST = 120


def strips(spans: DataFrame, low: int, high: int, most: int = LANE_MOST) -> DataFrame:
    """Spans (lane, label, b, e) that overlap the axis, without the lanes that have too many of them."""
    met = spans.where((F.col("e") >= low) & (F.col("b") <= high))
    few = met.groupBy("lane").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select("lane")
    return met.join(few, "lane")


def health_check(listed: Column, measured: Column) -> Column:
    share = measured / listed
    return F.when(share < 0.9, "low").when(share <= 1.35, "ok").otherwise("high")


def parse_duration(text: str) -> int | None:
    """Seconds of texts like 1h30m or -6h; every number needs a unit."""
    m = re.fullmatch(r"\s*(-?)((?:\d+\s*[dhms]\s*)+)", text.lower())
    if not m:
        return None
    unit = {"d": 86400, "h": 3600, "m": 60, "s": 1}
    return (-1 if m[1] else 1) * sum(int(n) * unit[u] for n, u in re.findall(r"(\d+)\s*([dhms])", m[2]))


def short_number(c: Column) -> Column:
    """Thousands, millions and billions to one decimal."""
    size = F.abs(c)
    put = lambda by, unit: F.concat(F.format_string("%.1f", c / F.lit(float(by))), F.lit(unit))
    return F.when(size >= 1e9, put(1e9, "B")).when(size >= 1e6, put(1e6, "M")).when(size >= 1e3, put(1e3, "K")).otherwise(F.format_string("%.0f", c.cast("double")))


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))).otherwise(F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60))))
