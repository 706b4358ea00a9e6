"""Orders that a limit or a number depends on leave no ties."""

import datetime

from test_query import T0, event, hit

from spanforge.functions.schema import EVENT_DDL, FIELDS
from spanforge.operators import lookup
from spanforge.plans.query import QuerySpec, World, compile_query, with_seconds


def world_of(spark, rows, fights):
    names = ["session_id", "line_no", "ts", "kind", *FIELDS]
    at = lambda r: datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=r["second"])
    events = with_seconds(spark.createDataFrame([tuple(at(r) if n == "ts" else r.get(n) for n in names) for r in rows], EVENT_DDL))
    pets = spark.createDataFrame([], "pet string, owner string")
    one = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    begun = [(i + 1, name, T0 + b, T0 + e, T0 + e, True) for i, (name, b, e) in enumerate(fights)]
    return World(events, spark.createDataFrame(begun, "id int, name string, begin long, last_damage long, last_activity long, closed boolean"), pets, one({n for n, *_ in fights}), one({r["actor"] for r in rows if r["kind"] == "Damage"}), "Raider01")


def test_a_search_orders_rows_of_one_name_by_the_other_columns(spark):
    names = [(i * 37 % 101, "red rod" if i % 2 else "red gear") for i in range(101)]
    parts = spark.createDataFrame([(key, i, 7) for i, key in names], "key string, id long, level int").repartition(7)
    want = sorted((1, key, i) for i, key in names)[:60]
    found = lookup.ranked_search(parts, "key", "red", 60, (5, 40)).select("rank", "key", "id")
    assert [tuple(r) for r in found.collect()] == want


def test_equal_values_rank_by_their_first_line_even_where_clocks_go_back(spark):
    rows = [hit(1, 9, "Raider01", "A dragon", 50), hit(2, 3, "Raider02", "A dragon", 50), hit(3, 9, "Raider03", "A dragon", 70), event(4, 9, "Zone", zone="Fen")]
    found = compile_query(world_of(spark, rows, [("A dragon", 0, 10)]), QuerySpec("damage", groupBy=["player"], metrics=["total"], petRollup=False)).rows
    ranks = {tuple(r["path"]): r["rank"] for r in found.collect()}
    assert ranks == {(): 1, ("Raider03",): 1, ("Raider01",): 2, ("Raider02",): 3}
