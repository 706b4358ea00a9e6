"""The live meter over any number of open fights, and routes of any length."""

import datetime

from spanforge.functions.schema import EVENT_DDL, FIELDS
from spanforge.operators import lookup
from spanforge.plans.query import QuerySpec, World, compile_query, live_meter, with_seconds

T0 = 1710014400
MANY = 70


def world_of(spark, open_fights):
    """One hit of 10 in each of MANY fights, one after the other, of which the given ids are open."""
    names = ["session_id", "line_no", "ts", "kind", *FIELDS]
    hits = [{"session_id": "s", "line_no": i, "ts": datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=T0 + 10 * i), "kind": "Damage", "actor": "Raider01", "target": f"A rat {i}", "amount": 10, "damage_kind": "Melee", "sub_type": "Crushes", "modifiers": 0, "is_spell": False} for i in range(MANY)]
    fights = [(i, f"A rat {i}", T0 + 10 * i, T0 + 10 * i, T0 + 10 * i, i not in open_fights) for i in range(MANY)]
    one = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    return World(
        events=with_seconds(spark.createDataFrame([tuple(r.get(n) for n in names) for r in hits], EVENT_DDL)),
        fights=spark.createDataFrame(fights, "id int, name string, begin long, last_damage long, last_activity long, closed boolean"),
        pets=spark.createDataFrame([], "pet string, owner string"),
        npcs=one([f"A rat {i}" for i in range(MANY)], "name"),
        verified=one(["Raider01"], "name"),
    )


def meter(world):
    spec = live_meter(world)
    assert QuerySpec.from_json(spec.to_json()) == spec
    return {tuple(r["path"]): r for r in compile_query(world, spec).rows.collect()}


def test_all_open_fights_count(spark):
    row = meter(world_of(spark, set(range(MANY))))["Raider01",]
    assert (row["total"], row["percentOfTotal"]) == (10 * MANY, 100) and row["sdps"] == row["dps"]


def test_closed_fights_do_not_count_unless_all_are_closed(spark):
    assert meter(world_of(spark, {3, 5}))["Raider01",]["total"] == 20
    assert meter(world_of(spark, set()))["Raider01",]["total"] == 10


def test_routes_have_no_hop_limit(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(66)], "a string, b string")
    assert {r["node"]: r["hops"] for r in lookup.routes(edges, "n000").collect()} == {f"n{i:03}": i for i in range(67)}
