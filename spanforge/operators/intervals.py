"""Algebra of inclusive one-second intervals: columns b and e hold first and last second of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("b", "e")
    so_far = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(F.col("b") > so_far + 1, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return opened.groupBy(*keys, "_island").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_island")


def merge(df: DataFrame, keys: list[str], width: int = HOUR) -> DataFrame:
    """Union of the intervals of each key: overlapping ones and those that touch within a second become one.

    Intervals are cut at the hours and merged hour by hour, so one key that holds most rows is spread over its hours;
    only stretches that reach an hour's edge, two an hour at most, are then joined along the whole key.
    """
    low, high = F.least("b", "e"), F.greatest("b", "e")
    hours = df.select(*keys, low.alias("_b"), high.alias("_e"), F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("_hour"))
    begin = F.col("_hour") * width
    cut = hours.select(*keys, "_hour", F.greatest("_b", begin).alias("b"), F.least("_e", begin + (width - 1)).alias("e"))
    inside = _islands(cut, [*keys, "_hour"])
    edge = (F.pmod("b", F.lit(width)) == 0) | (F.pmod("e", F.lit(width)) == width - 1)
    marked = inside.select(*keys, "b", "e", edge.alias("_edge"))
    # stretches away from the edges are groups of their own; hashing them apart keeps a key's window to its edges
    apart = F.when(F.col("_edge"), F.lit(0)).otherwise(F.xxhash64("b"))
    w = Window.partitionBy(*keys, "_apart").orderBy("b")
    new = F.when(F.col("_edge") & F.coalesce(F.lag("e").over(w) == F.col("b") - 1, F.lit(False)), 0).otherwise(1)
    joined = marked.withColumn("_apart", apart).withColumn("_new", new).withColumn("_group", F.sum("_new").over(w))
    return joined.groupBy(*keys, "_apart", "_group").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_apart", "_group")


def total(b: str = "b", e: str = "e") -> Column:
    """Seconds of a set of disjoint intervals, as an aggregate."""
    return F.coalesce(F.sum(F.col(e) - F.col(b) + 1), F.lit(0))


def trim(df: DataFrame, keys: list[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """Leave out the first `skip` seconds of each key's concatenated timeline and keep at most `most` after them."""
    length = F.col("e") - F.col("b") + 1
    # seconds of the days before, from one row a day, and of the day's own intervals before each
    dated = df.withColumn("_day", F.floor(F.col("b") / DAY))
    days = dated.groupBy(*keys, "_day").agg(F.sum(length).alias("_secs"))
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_past", F.coalesce(F.sum("_secs").over(past), F.lit(0))).drop("_secs")
    own = Window.partitionBy(*keys, "_day").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    placed = dated.withColumn("_own", F.coalesce(F.sum(length).over(own), F.lit(0))).join(days, [*keys, "_day"]).withColumn("_before", F.col("_own") + F.col("_past"))
    b = F.col("b") + F.greatest(F.lit(0), F.lit(skip) - F.col("_before"))
    e = F.col("e") if most is None else F.least(F.col("e"), F.col("b") + F.lit(skip + most) - F.col("_before") - 1)
    return placed.select(*[c for c in df.columns if c not in ("b", "e")], b.alias("b"), e.alias("e")).where("b <= e")


def intersect(left: DataFrame, right: DataFrame, keys: list[str], width: int = DAY) -> DataFrame:
    """Pairwise overlaps within each key.  Right intervals are dealt to the buckets they touch, so the join is by equality."""
    buckets = lambda b, e: F.explode(F.sequence(F.floor(b / width), F.floor(e / width)))
    l = left.withColumn("_bucket", buckets(F.col("b"), F.col("e")))
    r = right.select(*keys, F.col("b").alias("_b"), F.col("e").alias("_e")).withColumn("_bucket", buckets(F.col("_b"), F.col("_e")))
    b, e = F.greatest("b", "_b"), F.least("e", "_e")
    # an overlap is counted in the bucket where it begins
    met = l.join(r, [*keys, "_bucket"]).where((b <= e) & (F.floor(b / width) == F.col("_bucket")))
    return met.select(*[c for c in left.columns if c not in ("b", "e")], b.alias("b"), e.alias("e"))


def covered(df: DataFrame, keys: list[str], width: int = MINUTE) -> DataFrame:
    """(keys, b, e, n, lo, hi): disjoint pieces, each held by the same n intervals, which reach from lo to hi together.

    Intervals are dealt to the buckets they touch, and those that begin or end together count as one: pieces follow the
    seconds of a key, not how many intervals overlap there.
    """
    begin = F.col("_bucket") * width
    dealt = df.where("b <= e").select(*keys, "b", "e", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor(F.col("e") / width))).alias("_bucket"))
    opens = F.struct(F.greatest("b", begin).alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("lo"), F.col("e").cast("long").alias("hi"))
    closes = F.struct((F.least("e", begin + (width - 1)) + 1).alias("at"), F.lit(-1).alias("n"), F.col("b").cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    marks = dealt.select(*keys, "_bucket", F.explode(F.array(opens, closes)).alias("m")).groupBy(*keys, "_bucket", F.col("m.at").alias("_at"))
    marks = marks.agg(F.sum("m.n").alias("_n"), F.min("m.lo").alias("_lo"), F.max("m.hi").alias("_hi"))
    key = Window.partitionBy(*keys, "_bucket")
    upto = key.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    later = key.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = marks.select(*keys, F.col("_at").alias("b"), (F.lead("_at").over(key.orderBy("_at")) - 1).alias("e"), F.sum("_n").over(upto).alias("n"), F.min("_lo").over(later).alias("lo"), F.max("_hi").over(upto).alias("hi"))
    return pieces.where("n > 0")


def covered_by_both(left: DataFrame, right: DataFrame, width: int = MINUTE) -> DataFrame:
    """The pieces of all overlaps of left's intervals with right's, from the pieces (`covered`) of each; keys are left's."""
    buckets = lambda b, e: F.explode(F.sequence(F.floor(b / width), F.floor(e / width)))
    l = left.withColumn("_bucket", buckets(F.col("b"), F.col("e")))
    r = right.select(*[F.col(c).alias(f"_{c}") for c in ("b", "e", "n", "lo", "hi")]).withColumn("_bucket", buckets(F.col("_b"), F.col("_e")))
    b, e = F.greatest("b", "_b"), F.least("e", "_e")
    met = l.join(r, "_bucket").where((b <= e) & (F.floor(b / width) == F.col("_bucket")))
    keys = [c for c in left.columns if c not in ("b", "e", "n", "lo", "hi")]
    return met.select(*keys, b.alias("b"), e.alias("e"), (F.col("n") * F.col("_n")).alias("n"), F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"))


def reached(df: DataFrame, keys: list[str], width: int = HOUR) -> DataFrame:
    """(keys, b, e): stretches (b, e, hi) of each key, where one goes on to the next that begins by its hi.

    hi is the furthest that an interval around e reaches to, the same for all rows of a key's second.  So an hour's last
    stretch may go on and its first may be reached, and only those, two an hour, are joined along the whole key.
    """
    def groups(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("b")
        so_far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        # peers of a second come into one group together
        marked = rows.withColumn("_new", F.when(F.col("b") > so_far, 1).otherwise(0)).withColumn("_group", F.sum("_new").over(order))
        return marked.groupBy(*by, "_group").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.max("hi").alias("hi")).drop("_group")

    inside = groups(df.select(*keys, "b", "e", "hi", F.floor(F.col("b") / width).alias("_hour")), [*keys, "_hour"])
    hour = Window.partitionBy(*keys, "_hour").orderBy("b")
    edge = F.lag("b").over(hour).isNull() | F.lead("b").over(hour).isNull()
    apart = F.when(edge, F.lit(0)).otherwise(F.xxhash64("b"))
    return groups(inside.select(*keys, "b", "e", "hi", apart.alias("_apart")), [*keys, "_apart"]).select(*keys, "b", "e")


def add_all(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    whole = parts[0].select(*keys, "b", "e")
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*keys, "b", "e"))
    return merge(whole, keys)
