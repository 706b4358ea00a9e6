"""Queries by play session: they find no fights, and read a second's rows as one."""

import random

from pyspark.sql import functions as F
from test_query import event
from test_ties import world_of

from spanforge.operators import segments
from spanforge.plans.query import QuerySpec, Scope, compile_query, units


def fail():
    raise AssertionError("fights were looked for")


def test_loot_and_considers_find_no_fights(spark):
    rows = [event(1, 1, "Zone", zone="Fen"), event(2, 3, "Loot", actor="Raider01", item="Fang", quantity=2, copper=1500), event(3, 5, "Consider", target="A dragon", level=50)]
    world = world_of(spark, rows, [("A dragon", 0, 10)])
    listed, world.fights = world.fights, fail
    for source, metric, n in (("loot", "loots", 2), ("considers", "considers", 1)):
        found = compile_query(world, QuerySpec(source, groupBy=["player"], metrics=[metric], petRollup=False)).rows
        assert [r[metric] for r in found.where("level = 0").collect()] == [n]
    # named fights are still found
    world.fights = lambda: listed
    assert units(world, QuerySpec("loot", Scope(fightIds=[1]))).count() == 1


def test_presence_reads_a_second_as_one_row(spark, monkeypatch):
    rng = random.Random(5)
    rows, second = [], 0
    for line in range(1, 401):
        second += rng.choice([0, 0, 0, 0, 1, 599, 600])
        rows.append(event(line, second, "Zone", zone="Fen", welcome=rng.random() < 0.3) if rng.random() < 0.4 else event(line, second, "Loot", item="Fang"))
    rng.shuffle(rows)
    world = world_of(spark, rows, [("A dragon", 0, 1)])
    login = (F.col("kind") == "Zone") & F.coalesce("welcome", F.lit(False))
    want = segments.presence(world.events, ["session_id"], ["s", "line_no"], marker=login)
    read = []
    dealt = segments.dealt
    monkeypatch.setattr(segments, "dealt", lambda df, *rest: read.append(df.count()) or dealt(df, *rest))
    assert sorted(map(tuple, world.presence().collect())) == sorted(map(tuple, want.select("b", "e").collect()))
    assert read[0] < 300
