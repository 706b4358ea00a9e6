"""Frames, panels and lookups of the client; fight rows with what a list shows."""

import pytest

from spanforge.operators import feeds, fights, lookup, present
from spanforge.plans import frames
from spanforge.plans.frames import Frame, Panel
from spanforge.plans.query import Filter, Scope
from spanforge.sources import files


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(1, "a", 100, 110), (2, "b", 120, 200), (3, "c", 150, 190), (5, "d", 300, 400)], "id int, name string, begin long, last_damage long")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_frames_are_scopes():
    assert Frame().scope(30) == Scope() and Frame(span=60).scope(15) == Scope(lastSeconds=75)
    assert Frame(begin="2024-03-09T20:00:10", end="2024-03-09T21:00:00").scope(20).timeRanges == [{"begin": "2024-03-09T19:59:50", "end": "2024-03-09T21:00:00"}]


def test_frames_and_fights(listed):
    found = frames.frame_of_fights(listed, [3, 2])
    assert (found.begin, found.end, found.fightIds) == ("1970-01-01T00:02:00", "1970-01-01T00:03:20", [3, 2])
    assert frames.frame_of_fights(listed, []) is None and frames.frame_of_fights(listed, [9]) is None
    assert ids(frames.fights_in(found, listed)) == [2, 3] and ids(frames.fights_in(Frame(), listed)) == [1, 2, 3, 5]
    assert ids(frames.fights_in(Frame(span=200), listed)) == [2, 5]
    assert frames.fights_between(listed, 5, 2) == [2, 3, 5] and frames.fights_between(listed, 4, 2) == [2]
    assert ids(frames.fight_bands(listed, 110, 150)) == [1, 2, 3] and ids(frames.fight_bands(listed, 110, 150, most=2)) == []


def test_levels_by_recency(spark):
    rows = spark.createDataFrame([(50, 1), (None, 9), (12, 3), (50, 7)], "defender_level int, last_seen long")
    assert [tuple(r) for r in frames.level_choices(rows).collect()] == [(None, "unknown", 1), (50, "50", 2), (12, "12", 1)]


def test_panels_are_specs():
    spec = Panel(metrics=["dps"], excludeFlags=["damageShield"], ownerOnly=True, spellFilter=["Blaze"], skipFirstSeconds=3).spec(Frame(span=60), False, "Ann", True)
    assert spec.scope == Scope(lastSeconds=60, skipFirstSeconds=3, playedTimeOnly=True) and spec.metrics == ["dps"] and not spec.petRollup
    assert spec.filters == [Filter(flag="damageShield", exclude=True), Filter("player", ["Ann"]), Filter("spell", ["Blaze"])]
    line = Panel(viz="line", primaryMetric="total", scopeMode="recent", lastSeconds=90, maxSeconds=5).spec(Frame(), warmup=30, bucket=6)
    assert line.scope == Scope(lastSeconds=120) and line.metrics == ["total"] and line.bucketSeconds == 6
    assert Panel(source="loot", viz="droprate").spec(Frame()).metrics == ["loots"]


def test_fight_rows_have_health_and_own_damage(spark):
    found = spark.createDataFrame([("s", 1, "a rat", 1, "Fen 3 (Hard)", 10, 20, 1), ("s", 1, "a bat", 1, "Fen", 500, 510, 2)], "session_id string, zone_change long, name string, fight long, zone string, begin long, last_damage long, id int")
    rows = spark.createDataFrame([("s", 1, "a rat", 1, True, True, a, n) for a, n in (("Ann", 5), ("ann", 2), ("Rex", 4), ("Bob", 9))] + [("s", 1, "a rat", 1, True, False, "Ann", 50)], "session_id string, zone_change long, npc string, fight long, damaging boolean, dealt boolean, actor string, amount long")
    pets = spark.createDataFrame([("Rex", "ANN"), ("Max", "Bob")], "pet string, owner string")
    health = spark.createDataFrame([("a rat", "fen", 3, 700), ("a rat", "fen", None, 100), ("a bat", "fen", 3, 1)], "mob_key string, zone_key string, difficulty int, health long")
    info = {r["name"]: r for r in fights.fight_info(found, rows, "Ann", pets, health).collect()}
    assert (info["a rat"]["group"], info["a rat"]["difficulty"], info["a rat"]["tier"], info["a rat"]["health"], info["a rat"]["own_damage"]) == (0, 3, "Hard", 700, 11)
    assert (info["a bat"]["group"], info["a bat"]["difficulty"], info["a bat"]["health"], info["a bat"]["own_damage"]) == (1, None, None, 0)


def test_items_in_loot_trade_and_chat(spark):
    rows = [(1, 5, "Loot", "Ann", "a rat", "Iron Ring +2", None, None, None, None, 2), (2, 6, "Merchant", None, "Bob", "Iron Ring", None, None, None, True, 1), (3, 7, "Chat", "Zed", None, None, "wts Iron Ring, old Staff of Doom", "auction", None, None, None), (4, 99, "Loot", "Ann", None, "Iron Ring", None, None, None, None, 1)]
    events = spark.createDataFrame([(ln, s, k, a, t if k == "Merchant" else None, t, i, x, c, cc, sold, q) for ln, s, k, a, t, i, x, c, cc, sold, q in rows], "line_no long, s long, kind string, actor string, target string, source string, item string, text string, channel string, custom_channel string, sold boolean, quantity int")
    registry = spark.createDataFrame([("Iron Ring", 7), ("Staff of Doom", 8)], "name string, id int")
    found = feeds.item_feed(events, spark.createDataFrame([(0, 50)], "b long, e long"), registry).orderBy("line_no", "nth").collect()
    assert [(r["what"], r["item"], r["item_id"], r["who"], r["with_whom"], r["quantity"]) for r in found] == [("Looted", "Iron Ring", 7, "Ann", "a rat", 2), ("Sold", "Iron Ring", 7, "You", "Bob", 1), ("Chat", "Staff of Doom", 8, "Zed", "auction", 1), ("Chat", "Iron Ring", 7, "Zed", "auction", 1)]


def test_maps_by_display_name(spark):
    zones = spark.createDataFrame([(1, "freportw", "West Freeport"), (2, "freeportwest", "West Freeport"), (3, "fen", "The Fen"), (4, "x", None)], "nth int, short string, display string")
    names = spark.createDataFrame([("west freeport",), ("The Fen 3 (Hard)",), ("nowhere",)], "zone string")
    assert {r["zone"]: r["maps"] for r in lookup.maps_of(names, zones).collect()} == {"west freeport": ["freportw", "freeportwest"], "The Fen 3 (Hard)": ["fen"], "nowhere": []}


def test_names_in_a_band(spark):
    index = lookup.build_index(spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", None, 3), ("c", 20, 4)], "name string, level int, id int"))
    assert [lookup.in_band(index, *x) for x in ((6, 10), (None, 5), (10, None), (None, None))] == [1, 1, 1, 2]


def test_colours_totals_lanes_and_pins(spark):
    levels = spark.createDataFrame([(8, 8), (8, 11), (8, 9), (8, 4), (8, 5), (20, 11), (20, 13), (20, 14), (70, 42), (70, 51), (70, 52)], "player int, mob int")
    assert [r[0] for r in levels.select(lookup.con_colour(levels.player, levels.mob)).collect()] == ["white", "red", "yellow", "green", "blue", "green", "lightblue", "blue", "green", "lightblue", "blue"]
    kills = spark.createDataFrame([("A rat", "Fen", 3, 5), ("a rat ", "Keep", 2, 9), ("a bat", "Fen", 9, 1)], "mob string, zone string, samples long, last_killed long")
    assert [(r["mob"].strip().lower(), r["kills"], r["zones"], r["last"]) for r in present.kill_totals(kills).collect()] == [("a bat", 9, ["Fen"], 1), ("a rat", 5, ["Fen", "Keep"], 9)]
    spans = spark.createDataFrame([("zone", "a", 0, 5), ("zone", "b", 6, 9), ("level", "1", 0, 3), ("level", "2", 4, 4), ("level", "3", 5, 9)], "lane string, label string, b long, e long")
    assert sorted(r["label"] for r in present.strips(spans, 4, 6, most=2).collect()) == ["2", "3", "a", "b"]
    assert sorted(r["label"] for r in present.strips(spans, 0, 9, most=2).collect()) == ["a", "b"]
    places = spark.createDataFrame([("x", "fen", ["fen"]), ("y", "keep", ["fen", "keep"]), ("z", None, [])], "name string, short string, maps array<string>")
    assert sorted(r["name"] for r in lookup.standing_in(places, "fen").collect()) == ["x", "y"]


def test_caches_to_sweep(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', true, current_timestamp(), 'me'), ('a', true, current_timestamp() - INTERVAL 1 DAY, 'old'), ('a', true, current_timestamp() - INTERVAL 2 DAYS, 'older'), ('b', false, current_timestamp(), 'me'), ('c', true, current_timestamp() - INTERVAL 90 DAYS, 'me') AS t(log, log_exists, last_used, build)")
    assert sorted((r["log"], r["build"]) for r in files.stale(rows, build="me").collect()) == [("a", "older"), ("b", "me"), ("c", "me")]
    assert sorted(r["log"] for r in files.stale(rows).collect()) == ["b", "c"]
