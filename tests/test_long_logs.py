"""One log as the whole table: running values over stretches of it equal one window over all, and no task has it all."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.functions import grammar
from spanforge.operators import fights, segments


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(4)
    rows, s = [], 0
    for line in range(4000):
        s += rng.choice([0, 0, 1, 2, 40, 700]) if line % 50 == 0 else rng.choice([0, 1])
        rows.append((None if line % 1999 == 0 else "one" if line % 10 else f"k{line % 30}", line, s, rng.choice([None, None, rng.randrange(100)]), line % 997 == 5))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, line_no long, s long, v long, mark boolean").repartition(5)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_carried_values_equal_windows(stream):
    w = Window.partitionBy("k").orderBy("s", "line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = stream.select("k", "line_no", F.last("v", True).over(upto), F.last("v", True).over(before), F.coalesce(F.sum("v").over(upto), F.lit(0)), F.max("v").over(before))
    found = segments.carried(segments.dealt(stream, ["k"], ["s", "line_no"]), ["k"], ["s", "line_no"], a=("last", F.col("v")), b=("before", F.col("v")), c=("sum", F.col("v")), d=("max_before", F.col("v")))
    assert tuples(found.select("k", "line_no", "a", "b", "c", "d")) == tuples(want)


def test_long_forms_equal_short_ones(stream):
    keys, order = ["k"], ["s", "line_no"]
    marker = F.col("mark")
    assert tuples(segments.long_sessions(stream, keys, order, 30, marker).select("k", "line_no", "session")) == tuples(segments.sessions(stream, keys, order, 30, marker).select("k", "line_no", "session"))
    spans = stream.select("k", "line_no", F.col("s").alias("b"), (F.col("s") + F.coalesce("v", F.lit(0))).alias("e"))
    assert tuples(segments.long_chains(spans, keys, ["b", "line_no"]).select("k", "line_no", "chain")) == tuples(segments.chains(spans, keys, ["b", "line_no"]).select("k", "line_no", "chain"))
    assert segments.long_sessions(stream.limit(0), keys, order).count() == 0
    numbered = segments.numbered(stream.where("k = 'one'"), keys, order)
    assert [r["id"] for r in numbered.orderBy("s", "line_no").collect()] == list(range(1, numbered.count() + 1))


def largest_and_median(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1], sizes[len(sizes) // 2]


@pytest.fixture
def whole_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_no_task_has_the_whole_log(spark, whole_partitions):
    """One session of 40,000 lines: zones, presence and announcements read it in parts of about one size."""
    log = spark.range(40000).select(F.lit("log").alias("session_id"), F.col("id").alias("line_no"), F.col("id").alias("s"), F.when(F.col("id") % 5000 == 7, "Zone").otherwise("Damage").alias("kind"), F.lit("Fen").alias("zone"), F.lit("a gnoll").alias("npc"))
    rows = fights.with_zone(log.where("kind = 'Damage'").drop("zone"), log)
    found = segments.long_sessions(log, ["session_id"], ["s", "line_no"])
    for df in (rows, found):
        most, median = largest_and_median(df)
        assert df.count() >= 39000 and most <= 2 * median, (most, median)
    assert rows.agg(F.max("zone_change")).first()[0] == 8


def test_announced_criticals_over_stretches(spark):
    schema = "session_id string, line_no long, kind string, actor string, damage_kind string, modifiers int"
    rows = [("log", i, "Damage", f"P{i % 3}", "Melee", 0) for i in range(300)]
    for i in (10, 11, 100, 250):
        rows[i] = ("log", i, "_Critical", "P1", None, None)
    found = grammar.announced(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 296 and sorted(r["line_no"] for r in found if r["modifiers"]) == [13, 103, 253]


def test_rows_are_stored_before_they_are_dealt(stream, monkeypatch):
    """A deal by range reads its rows for a sample and again to deal them; what makes them runs once."""
    stored, cut = [], segments.cut
    monkeypatch.setattr(segments, "cut", lambda df: stored.append(df.columns) or cut(df))
    segments.dealt(stream, ["k"], ["s", "line_no"])
    assert stored == [stream.columns, [*stream.columns, "_part"]]
