import pytest
from pyspark.sql import functions as F

from spanforge.functions.schema import EVENT_DDL, FIELDS, MODIFIERS
from spanforge.operators import metrics
from spanforge.plans.query import FLAGS, Filter, QuerySpec, Scope, World, CANNED, canned, compile_query, with_seconds

T0 = 1710014400  # 2024-03-09 20:00:00


def event(line, second, kind, **fields):
    return {"session_id": "s", "line_no": line, "second": T0 + second, "kind": kind, **fields}


def hit(line, second, actor, target, amount, kind="Melee", sub="Crushes", mods=0, spell=False):
    return event(line, second, "Damage", actor=actor, target=target, amount=amount, damage_kind=kind, sub_type=sub, modifiers=mods, is_spell=spell)


ROWS = [
    hit(1, 2, "Raider01", "A dragon", 100),
    hit(2, 3, "Raider01", "A dragon", 200, mods=MODIFIERS["Critical"]),
    hit(3, 4, "Raider02", "A dragon", 60, kind="DirectDamage", sub="Frost"),
    hit(4, 5, "Raider02", "A dragon", 40, kind="DirectDamage", sub="Frost"),
    hit(5, 6, "A dragon", "Raider01", 70),
    hit(6, 6, "Raider01", "A dragon", 0, kind="Miss"),
    hit(7, 7, "Raider01", "A dragon", 125),
    hit(8, 8, "Raider01", "A dragon", 200),
    hit(9, 8, "Rex", "A dragon", 30, sub="Bites"),
    event(10, 4, "Heal", actor="Cleric", target="Raider01", amount=80, potential=100, over_time=False, spell="Mend", modifiers=0),
    event(11, 9, "Death", target="A dragon", actor="Raider01"),
    event(12, 20, "Loot", actor="Raider01", item="Fang", source="a dragon", quantity=2, copper=1500),
]


@pytest.fixture(scope="module")
def world(spark):
    import datetime

    names = ["session_id", "line_no", "ts", "kind", *FIELDS]
    rows = [tuple(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=r["second"]) if n == "ts" else r.get(n) for n in names) for r in ROWS]
    events = with_seconds(spark.createDataFrame(rows, EVENT_DDL))
    one = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    return World(
        events=events,
        fights=spark.createDataFrame([(1, "A dragon", T0 + 2, T0 + 9, T0 + 9, True)], "id int, name string, begin long, last_damage long, last_activity long, closed boolean"),
        pets=spark.createDataFrame([("Rex", "Raider02")], "pet string, owner string"),
        npcs=one(["A dragon"], "name"),
        verified=one(["Raider01", "Raider02", "Cleric"], "name"),
        owner="Raider01",
    )


def result(compiled):
    return {tuple(r["path"]): r for r in compiled.rows.collect()}


def test_damage_by_player(world):
    rows = result(compile_query(world, QuerySpec("damage", groupBy=["player"], metrics=["total", "hits", "critHits", "activeSeconds", "raidSeconds", "dps", "sdps", "percentOfTotal", "meleeAttempts", "misses"], petRollup=False)))
    first, second = rows["Raider01",], rows["Raider02",]
    assert (first["total"], first["hits"], first["critHits"], first["activeSeconds"], first["raidSeconds"]) == (625, 4, 1, 7, 7)
    assert (second["total"], second["activeSeconds"]) == (100, 2)
    assert first["dps"] == pytest.approx(625 / 7) and second["sdps"] == pytest.approx(100 / 7)
    assert first["rank"] == 1 and second["rank"] == 2 and rows["Rex",]["rank"] == 3
    assert rows[()]["total"] == 755 and first["percentOfTotal"] == pytest.approx(100 * 625 / 755)
    assert (first["meleeAttempts"], first["misses"]) == (5, 1)


def test_pets_count_for_owners(world):
    rows = compile_query(world, QuerySpec("damage", groupBy=["player"], metrics=["total"], petRollup=True)).rows.collect()
    owners = {r["label"]: r["total"] for r in rows if r["level"] == 1}
    assert owners == {"Raider01": 625, "Raider02 +Pets": 130}
    # an owner whose only actor is themselves has no level of actors
    assert {tuple(r["path"]): r["total"] for r in rows if r["level"] == 2} == {("Raider02", "Raider02"): 100, ("Raider02", "Rex"): 30}
    deep = compile_query(world, QuerySpec("damage", groupBy=["player", "spell"], metrics=["total"], petRollup=True)).rows.collect()
    paths = {tuple(r["path"]) for r in deep}
    assert ("Raider01", "Crushes") in paths and ("Raider02", "Rex", "Bites") in paths and ("Raider01", "Raider01", "Crushes") not in paths


def with_rows(spark, world, more):
    import datetime

    names = ["session_id", "line_no", "ts", "kind", *FIELDS]
    rows = [tuple(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=r["second"]) if n == "ts" else r.get(n) for n in names) for r in more]
    return World(world.events.unionByName(with_seconds(spark.createDataFrame(rows, EVENT_DDL))), world.fights, world.pets, world.npcs, world.verified, world.owner)


def test_flags_are_filters(spark, world):
    """A damage shield, bane and rare strokes of Raider01; excluded or alone, by each flag."""
    more = [hit(30, 5, "Raider01", "A dragon", 25, kind="DamageShield", sub=None), {**hit(31, 5, "Raider01", "A dragon", 7, kind="DirectDamage", sub="Ward"), "school": "bane"}]
    strokes = {"headshot": "Headshot", "assassinate": "Assassinate", "finishingBlow": "FinishingBlow", "slayUndead": "SlayUndead"}
    more += [hit(40 + i, 5, "Raider01", "A dragon", 1000 * 2**i, mods=MODIFIERS[m]) for i, m in enumerate(strokes.values())]
    flagged = with_rows(spark, world, more)
    total = lambda *filters: result(compile_query(flagged, QuerySpec("damage", metrics=["total", "hits"], filters=list(filters)))).get(("Raider01",))
    every = 625 + 25 + 7 + 15000
    assert total()["total"] == every and total()["hits"] == 10
    own = {"damageShield": 25, "bane": 7, "headshot": 1000, "assassinate": 2000, "finishingBlow": 4000, "slayUndead": 8000}
    assert set(own) == set(FLAGS)
    for name, amount in own.items():
        assert total(Filter(flag=name))["total"] == amount, name
    assert total(*[Filter(flag=name, exclude=True) for name in own])["total"] == 625
    with pytest.raises(ValueError, match="unknown flag"):
        total(Filter(flag="critical"))


def test_damage_types_by_school_and_outcome(spark, world):
    more = [hit(30, 5, "Raider01", "A dragon", 25, kind="DamageShield", sub=None), {**hit(31, 5, "Raider01", "A dragon", 50, kind="DirectDamage", sub="Ward"), "school": "fire"}]
    rows = result(compile_query(with_rows(spark, world, more), QuerySpec("damage", groupBy=["damageType"], metrics=["total"])))
    assert {k[0]: r["total"] for k, r in rows.items() if k} == {"melee": 655, "directDamage": 100, "damageShield": 25, "fire": 50, "Miss": 0}


def test_tanking_rolls_pets_up_too(spark, world):
    rows = result(compile_query(with_rows(spark, world, [hit(30, 5, "A dragon", "Rex", 9)]), QuerySpec("tanking", groupBy=["player"], metrics=["total"])))
    assert rows["Raider02",]["total"] == 9


def test_tanking_healing_loot(world):
    assert result(compile_query(world, QuerySpec("tanking", groupBy=["player"], metrics=["total"])))["Raider01",]["total"] == 70
    heal = result(compile_query(world, QuerySpec("healing", groupBy=["player"])))["Cleric",]
    assert (heal["total"], heal["extra"], heal["overhealRate"]) == (80, 20, 20.0)
    loot = result(compile_query(world, QuerySpec("loot", groupBy=["spell"])))["Fang",]
    assert (loot["loots"], loot["platinum"]) == (2, 1.5)


def test_filters_scope_and_series(world):
    only = compile_query(world, QuerySpec("damage", groupBy=["player"], metrics=["total"], filters=[Filter(dim="spell", values=["Frost"])]))
    assert set(result(only)) == {(), ("Raider02",)}
    without = compile_query(world, QuerySpec("damage", groupBy=["player"], metrics=["total"], filters=[Filter("spell", ["Crushes"]), Filter(flag="damageShield", exclude=True)], petRollup=False))
    assert result(without)["Raider01",]["total"] == 625
    trimmed = compile_query(world, QuerySpec("damage", Scope(skipFirstSeconds=2, maxSeconds=3), ["player"], ["total"], bucketSeconds=2, petRollup=False))
    assert result(trimmed)["Raider02",]["total"] == 100 and ("Rex",) not in result(trimmed)
    series = {(tuple(r["path"]), r["at"].second): r["value"] for r in trimmed.series.collect()}
    assert series == {((), 4): 100, ((), 6): 0, (("Raider02",), 4): 100, (("Raider01",), 6): 0}
    last = compile_query(world, QuerySpec("damage", Scope(lastSeconds=14), ["player"], ["total"], petRollup=False))
    assert result(last)["Raider01",]["total"] == 325
    ranged = compile_query(world, QuerySpec("damage", Scope(timeRanges=[{"begin": "2024-03-09T20:00:03", "end": "2024-03-09T20:00:04"}]), ["player"], ["total"]))
    assert result(ranged)[()]["total"] == 260


def test_stance_metrics(spark, world):
    def switch(line, second, stance, actor="Raider01"):
        return event(line, second, "Stance", actor=actor, stance=stance)

    import datetime

    names = ["session_id", "line_no", "ts", "kind", *FIELDS]
    more = [switch(20, 4, "bold"), switch(21, 4, "bright"), switch(22, 7, "calm"), switch(23, 7, "wild", "A dragon")]
    rows = [tuple(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=r["second"]) if n == "ts" else r.get(n) for n in names) for r in more]
    held = World(world.events.unionByName(with_seconds(spark.createDataFrame(rows, EVENT_DDL))), world.fights, world.pets, world.npcs, world.verified, world.owner)
    found = result(compile_query(held, QuerySpec("damage", groupBy=["stance"], metrics=["total", "stanceSeconds", "stanceDps", "stanceUptime"])))
    # the fight lasts from second 2 to 9: unknown 2-3, bright 4-6, calm 7-9
    assert {k: (r["total"], r["stanceSeconds"]) for k, r in found.items()} == {(): (755, 8), ("(no stance)",): (300, 2), ("bright",): (0, 3), ("calm",): (325, 3), ("(not you)",): (130, 0)}
    assert found["calm",]["stanceDps"] == pytest.approx(325 / 3) and found["bright",]["stanceUptime"] == pytest.approx(37.5)


def test_plan_has_no_single_task(spark, world):
    spec = QuerySpec("damage", Scope(playedTimeOnly=True, maxSeconds=60), ["player", "spell"], petRollup=True)
    plan = compile_query(world, spec).rows._jdf.queryExecution().toString()
    assert "No Partition Defined" not in plan and "CartesianProduct" not in plan


def test_spec_round_trip_and_canned():
    spec = QuerySpec("damage", Scope(fightIds=[3], maxSeconds=60), ["player"], ["dps"], [Filter("player", ["A"], exclude=True)], 5, False)
    assert QuerySpec.from_json(spec.to_json()) == spec
    assert QuerySpec.from_json('{"source": "healing", "filters": null}') == QuerySpec("healing", groupBy=["player"], petRollup=True)
    assert canned("DeathLog").source == "deaths" and canned("TankingSummary").groupBy == ["player", "spell"]
    assert canned("DpsOverTime", [3], 6) == QuerySpec("damage", Scope(fightIds=[3]), ["player"], ["total", "dps", "sdps"], bucketSeconds=6)
    assert all(canned(n).petRollup for n in CANNED)
    for ids in (None, [], [1]):
        spec = QuerySpec("loot", Scope(fightIds=ids))
        assert QuerySpec.from_json(spec.to_json()) == spec


def test_every_metric_has_its_counters(spark):
    known = metrics.COUNTERS.keys() | {"active", "raid", "root_total", "stance", "stance_scope"}
    assert len(metrics.METRICS) == 60
    for name in metrics.METRICS:
        assert metrics.needed([name]) <= known, name
    assert metrics.needed(["nonsense"]) == set()
    assert spark.range(1).select(F.lit(1)).first()
