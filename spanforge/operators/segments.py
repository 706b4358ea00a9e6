"""Segments of ordered streams: sessions, chains, step functions and as-of lookups, all on whole seconds (column s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENCE_GAP = 600
CHAIN_GAP = 120


def sessions(df: DataFrame, keys: list[str], order: list[str], gap: int = PRESENCE_GAP, marker: Column | None = None) -> DataFrame:
    """df with session: it grows at a marker row and after a silence of `gap` seconds or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lag("s").over(w)
    new = last.isNull() | (F.col("s") - last >= gap)
    if marker is not None:
        new = new | marker
    return df.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def presence(df: DataFrame, keys: list[str], order: list[str], gap: int = PRESENCE_GAP, marker: Column | None = None) -> DataFrame:
    """(keys, session, b, e, n): first and last second and rows of each session."""
    return sessions(df, keys, order, gap, marker).groupBy(*keys, "session").agg(F.min("s").alias("b"), F.max("s").alias("e"), F.count(F.lit(1)).alias("n"))


def islands(df: DataFrame, keys: list[str], order: list[str], gap: int, barrier: Column | None = None) -> DataFrame:
    """df with island: it grows after a silence of more than `gap` seconds and after a barrier row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lag("s").over(w)
    new = last.isNull() | (F.col("s") - last > gap)
    if barrier is not None:
        new = new | F.coalesce(F.lag(barrier).over(w), F.lit(False))
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chains(df: DataFrame, keys: list[str], order: list[str], gap: int = CHAIN_GAP, begin: str = "b", end: str = "e") -> DataFrame:
    """df with chain: a new one where an interval begins `gap` or more after everything before it has ended."""
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = so_far.isNull() | (F.col(begin) - so_far >= gap)
    return df.withColumn("_new", new.cast("int")).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def steps(df: DataFrame, keys: list[str], order: list[str], value: str, keep_repeats: bool = False) -> DataFrame:
    """(keys, value, b, e): spans of a step function; e is the second before the next step, null for the last.

    Of several values in one second the last in order counts; unless keep_repeats, a repeated value is no step.
    """
    latest = Window.partitionBy(*keys, "s").orderBy(*[F.desc(c) for c in order])
    one = df.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").select(*keys, "s", value)
    w = Window.partitionBy(*keys).orderBy("s")
    if not keep_repeats:
        before = F.lag(value).over(w)
        one = one.withColumn("_same", F.row_number().over(w).cast("long") > 1).withColumn("_repeat", F.col("_same") & before.eqNullSafe(F.col(value))).where("not _repeat").drop("_same", "_repeat")
    return one.select(*keys, value, F.col("s").alias("b"), (F.lead("s").over(w) - 1).alias("e"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str], tolerance: int | None = None, strict: bool = False) -> DataFrame:
    """left with the values of the last right row of its keys at or (strict) before its second, within `tolerance` seconds.

    A union and a running last value: one shuffle by key, no range join.  order breaks ties within a second on both sides;
    unless strict, right rows of a second come before left rows of it.
    """
    marks = right.select(*keys, "s", *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(1 if strict else 0).alias("_side"), *[F.col(c).alias(f"_o_{c}") for c in order], F.col("s").alias("_at"), F.lit(None).cast(left_row_type(left)).alias("_row"))
    rows = left.select(*keys, "s", *[F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values], F.lit(0 if strict else 1).alias("_side"), *[F.col(c).alias(f"_o_{c}") for c in order], F.lit(None).cast("long").alias("_at"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("s", "_side", *[f"_o_{c}" for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_at").isNotNull(), F.struct("_at", *[f"_r_{v}" for v in values])), ignorenulls=True).over(w)
    met = marks.unionByName(rows).withColumn("_seen", seen).where("_row is not null")
    near = F.lit(True) if tolerance is None else F.col("s") - F.col("_seen._at") <= tolerance
    return met.select("_row.*", *[F.when(near, F.col(f"_seen._r_{v}")).alias(v) for v in values], F.when(near, F.col("_seen._at")).alias("as_of"))


def left_row_type(left: DataFrame):
    return left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType


def within(points: DataFrame, spans: DataFrame, keys: list[str], values: list[str], width: int = 86400) -> DataFrame:
    """points joined with the spans (b, e) that hold their second; spans are dealt to the buckets they touch."""
    dealt = spans.select(*keys, "b", "e", *values).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor(F.col("e") / width))))
    return points.withColumn("_bucket", F.floor(F.col("s") / width)).join(dealt, [*keys, "_bucket"]).where("s between b and e").drop("_bucket")


def ranked(df: DataFrame, order: list[tuple[Column, bool]], name: str = "rank") -> DataFrame:
    """df with the place of each row in a total order of (column, descending), from 1.

    Rows are dealt by range of the order and counted in each part; only the parts' sizes meet in one task.
    """
    named = df.select("*", *[c.alias(f"_o{i}") for i, (c, _) in enumerate(order)])
    by = [F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i, (_, down) in enumerate(order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))


#: Parts of a long stream for each shuffle partition; several meet in one task, which evens them out.
PARTS = 8


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _part: stretches of each key's order, as even as a sample makes them, in the order of their numbers.

    For streams of which one key (a log) may hold most rows; order tells the rows of a key apart.  Stored, as parts must
    not change between the passes over them; and stored before, as a deal by range reads its rows two or three times.
    """
    n = PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(cut(df).repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def carried(rows: DataFrame, keys: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """Rows of `dealt` with running values by key, as a window over a key's whole order would give them, without one.

    name=(how, column): `last` is the last one that isn't null up to the row, `before` the last one before it, `sum` the
    sum up to the row, `max_before` the largest before it.  Each part is read on its own; what parts carry over are a row
    for each of them and key.
    """
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    local, ends, over = {}, [], []
    for name, (how, c) in values.items():
        if how in ("last", "before"):
            local[name] = F.last(c, ignorenulls=True).over(upto if how == "last" else before)
            ends.append(F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_c_{name}"))
            over.append(F.last(f"_c_{name}", ignorenulls=True).over(earlier).alias(f"_b_{name}"))
        elif how == "sum":
            local[name] = F.sum(c).over(upto)
            ends.append(F.sum(c).alias(f"_c_{name}"))
            over.append(F.sum(f"_c_{name}").over(earlier).alias(f"_b_{name}"))
        else:
            local[name] = F.max(c).over(before)
            ends.append(F.max(c).alias(f"_c_{name}"))
            over.append(F.max(f"_c_{name}").over(earlier).alias(f"_b_{name}"))
    carry = rows.groupBy("_part", *keys).agg(*ends).select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"_c_{n}") for n in values], "_part", *keys).select("_p", *[f"_k_{k}" for k in keys], *over)
    seen = rows.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()])
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    met = seen.join(carry, same, "left")
    both = {n: F.coalesce(f"_l_{n}", f"_b_{n}") if how in ("last", "before") else F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0)) if how == "sum" else F.greatest(f"_l_{n}", f"_b_{n}") for n, (how, _) in values.items()}
    return met.select(*rows.columns, *[c.alias(n) for n, c in both.items()])


def long_sessions(df: DataFrame, keys: list[str], order: list[str], gap: int = PRESENCE_GAP, marker: Column | None = None) -> DataFrame:
    """`sessions` of streams of which one key may hold most rows."""
    rows = dealt(df, keys, order)
    last = carried(rows, keys, order, _last=("before", F.col("s")))
    new = F.col("_last").isNull() | (F.col("s") - F.col("_last") >= gap)
    if marker is not None:
        new = new | marker
    return carried(last.withColumn("_new", new.cast("int")), keys, order, session=("sum", F.col("_new"))).drop("_part", "_last", "_new")


def long_presence(df: DataFrame, keys: list[str], order: list[str], gap: int = PRESENCE_GAP, marker: Column | None = None) -> DataFrame:
    """`presence` of streams of which one key may hold most rows."""
    return long_sessions(df, keys, order, gap, marker).groupBy(*keys, "session").agg(F.min("s").alias("b"), F.max("s").alias("e"), F.count(F.lit(1)).alias("n"))


def long_chains(df: DataFrame, keys: list[str], order: list[str], gap: int = CHAIN_GAP, begin: str = "b", end: str = "e") -> DataFrame:
    """`chains` of intervals of which one key may hold most."""
    so_far = carried(dealt(df, keys, order), keys, order, _so_far=("max_before", F.col(end)))
    new = F.col("_so_far").isNull() | (F.col(begin) - F.col("_so_far") >= gap)
    return carried(so_far.withColumn("_new", new.cast("int")), keys, order, chain=("sum", F.col("_new"))).drop("_part", "_so_far", "_new")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "id") -> DataFrame:
    """df with the place of each row among its key's, from 1."""
    return carried(dealt(df, keys, order), keys, order, **{name: ("sum", F.lit(1))}).drop("_part")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the cluster's checkpoint folder; as it is where there is none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        return df
    return df.checkpoint()


def level_as_of(rows: DataFrame, observed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows (with s) and the level of their keys at s, from observed (keys, s, order, level, stated).

    The last observation at or before s; before the first one its level, if it was stated (a listing) and not announced.
    Observations without a positive level or with a null key don't count; levels of null are unknown.
    """
    real = observed.where("level > 0").dropna(subset=keys)
    first = real.groupBy(*keys).agg(F.min_by(F.struct("level", "stated"), F.struct("s", *order)).alias("_first"))
    known = as_of(rows, real, keys, order, ["level"]).withColumnRenamed("level", "_level").drop("as_of")
    early = F.when(F.col("_first.stated"), F.col("_first.level"))
    return known.join(first, keys, "left").select(*rows.columns, F.coalesce("_level", early).alias("level"))
