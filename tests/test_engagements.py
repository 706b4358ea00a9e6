"""Fights of a stream: equal to the batch's, closed by the wall clock, taken back; and the pushes of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanforge.functions.schema import EVENT_DDL, FIELDS
from spanforge.operators import fights, identity
from spanforge.plans.query import with_seconds
from spanforge.streaming import engagements
from spanforge.streaming.push import Pushed, push

COLUMNS = ["session_id", "line_no", "ts", "kind", *FIELDS]


def row(session, line, second, kind, **fields):
    import datetime

    full = {"session_id": session, "line_no": line, "ts": datetime.datetime(2024, 3, 9, 20) + datetime.timedelta(seconds=second), "kind": kind, **fields}
    return tuple(full.get(c) for c in COLUMNS)


def hit(session, line, second, actor, target, amount=10, spell=False):
    return row(session, line, second, "Damage", actor=actor, target=target, amount=amount, damage_kind="Melee", is_spell=spell)


def evidence(spark):
    players = spark.createDataFrame([(s, n, 0) for s in ("a", "b") for n in ("Ann", "Bob")], "session_id string, name string, first_line long")
    npcs = spark.createDataFrame([], "session_id string, name string, first_line long")
    return players, npcs, spark.createDataFrame([("Rex", "Ann")], "pet string, owner string")


class Feed:
    """Rows appended to a folder, followed as fights; what each batch reported, and the last state of all fights."""

    def __init__(self, spark, folder, second=1000.0, sink=None):
        self.spark, self.folder, self.reported = spark, str(folder), []
        self.rows = 0
        spark.createDataFrame([], EVENT_DDL).write.mode("append").parquet(f"{self.folder}/in")
        events = with_seconds(spark.readStream.schema(EVENT_DDL).parquet(f"{self.folder}/in"))
        players, npcs, pets = evidence(spark)
        found = engagements.updates(identity.with_sides(events, players, npcs, pets), second)
        if sink:
            self.query = push(found, f"{self.folder}/push", engagements.KEYS, sink)
        else:
            self.query = found.writeStream.outputMode("update").foreachBatch(lambda df, n: self.reported.extend(df.collect())).trigger(processingTime="1 second").option("checkpointLocation", f"{self.folder}/checkpoint").start()

    def add(self, rows):
        self.spark.createDataFrame(rows, EVENT_DDL).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        before, self.rows = len(self.reported), self.rows + len(rows)
        # timers keep a query busy for ever, so wait until the rows have been read
        deadline = time.time() + 90
        while sum(p["numInputRows"] for p in self.query.recentProgress) < self.rows:
            if self.query.exception() or time.time() > deadline:
                raise self.query.exception() or TimeoutError()
            time.sleep(0.1)
        return self.reported[before:]

    def table(self):
        return engagements.newest(self.spark.createDataFrame(self.reported, engagements.FIGHT))

    def stop(self):
        self.query.stop()


@pytest.fixture
def feed(spark, tmp_path):
    made = []

    def make(**more):
        made.append(Feed(spark, tmp_path / f"feed{len(made)}", **more))
        return made[-1]

    yield make
    for f in made:
        f.stop()


FIELDS_OF = ["session_id", "first_line", "name", "zone", "zone_change", "begin", "last_damage", "last_activity", "dead", "closed", "has_damage", "damage_total", "tanking_total", "taunts"]


def replay(seed):
    """Two sessions of hits, taunts, deaths, zone lines, spells and pauses around the limits of 30 and 60 seconds."""
    rng = random.Random(seed)
    rows, line = [], 0
    for session in ("a", "b"):
        second = 0
        for _ in range(150):
            line += 1
            second += rng.choice([0, 1, 3, 29, 30, 31, 59, 60, 61])
            player, foe = rng.choice(["Ann", "Bob", "Rex"]), rng.choice(["a gnoll", "a wolf", "an ice giant"])
            what = rng.random()
            if what < 0.4:
                rows.append(hit(session, line, second, player, foe, rng.randrange(50)))
            elif what < 0.6:
                rows.append(hit(session, line, second, foe, player, rng.randrange(50)))
            elif what < 0.75:
                rows.append(row(session, line, second, "Taunt", actor=player, target=foe, success=True))
            elif what < 0.85:
                rows.append(row(session, line, second, "Death", actor=player, target=foe))
            elif what < 0.9:
                rows.append(row(session, line, second, "Zone", zone=rng.choice(["Fen", "Keep"])))
            else:
                rows.append(row(session, line, second, "Loot", actor=player, item="Fang"))
    return rows


def batch_fights(spark, rows):
    events = with_seconds(spark.createDataFrame(rows, EVENT_DDL))
    players, npcs, pets = evidence(spark)
    sided = identity.with_sides(events, players, npcs, pets)
    return fights.fights(fights.assigned(fights.with_zone(fights.engaged(sided), events)), players, pets, events)


def key_rows(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_stream_equals_batch(spark, feed):
    rows = replay(1)
    f = feed()
    parts = [rows[:40], rows[40:90], rows[90:150], rows[150:]]
    for part in parts:
        f.add(part)
    want = batch_fights(spark, rows).withColumn("zone_change", F.col("zone_change").cast("long"))
    assert key_rows(f.table(), FIELDS_OF) == key_rows(want, FIELDS_OF)


def test_silence_closes_a_fight(feed):
    f = feed(second=0.02)
    f.add([hit("a", 1, 0, "Ann", "a gnoll")])
    deadline = time.time() + 40
    while time.time() < deadline and not any(r["closed"] for r in f.reported):
        time.sleep(0.2)
    assert [(r["name"], r["dead"]) for r in f.reported if r["closed"]] == [("a gnoll", False)]
    # the next hit opens another
    f.add([hit("a", 2, 200, "Ann", "a gnoll")])
    assert {r["first_line"] for r in f.reported} == {1, 2}


def test_spells_and_phantoms(feed):
    f = feed()
    f.add([hit("a", 1, 0, "Blaze", "a gnoll", spell=True)])
    assert f.reported == []
    f.add([row("a", 2, 1, "Cast", actor="Ann", spell="Blaze", cast_kind="Begin"), hit("a", 3, 2, "Blaze", "a gnoll", 7, spell=True), hit("a", 4, 2, "Ann", "Zed", 5)])
    assert {(r["name"], r["damage_total"]) for r in f.table().collect()} == {("a gnoll", 7), ("Zed", 5)}
    f.add([row("a", 5, 3, "Chat", actor="Zed", channel="guild", text="hi")])
    assert [r["name"] for r in f.table().collect()] == ["a gnoll"]
    f.add([hit("a", 6, 4, "Ann", "Zed", 5)])
    assert [r["name"] for r in f.table().collect()] == ["a gnoll"]


def test_pushes_are_deltas_until_a_fight_is_taken_back(spark, feed):
    seen = []
    f = feed(sink=lambda p: seen.append((p.full, sorted((r["name"], r["damage_total"]) for r in p.rows.collect()))))
    f.add([hit("a", 1, 0, "Ann", "a gnoll", 3), hit("a", 2, 0, "Ann", "Zed", 5)])
    f.add([hit("a", 3, 1, "Ann", "a gnoll", 4)])
    f.add([row("a", 4, 3, "Chat", actor="Zed", channel="guild", text="hi")])
    assert seen == [(True, [("Zed", 5), ("a gnoll", 3)]), (False, [("a gnoll", 7)]), (True, [("a gnoll", 7)])]


def test_a_replayed_batch_pushes_the_same(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, version long, removed boolean, v string")
    sent = lambda p: p and (p.full, p.base, sorted(map(tuple, p.rows.collect())))
    pushed = Pushed(spark, str(tmp_path / "t"), ["k"])
    first = sent(pushed.merge(rows((1, 1, False, "a"), (2, 1, False, "b"), (1, 2, False, "c")), 0))
    assert first == (True, -1, [(1, 2, False, "c"), (2, 1, False, "b")])
    for _ in range(2):
        assert sent(pushed.merge(rows((2, 2, False, "d"), (1, 1, False, "late")), 1)) == (False, 0, [(2, 2, False, "d")])
    assert pushed.merge(rows((1, 2, False, "c")), 2) is None
    assert sent(pushed.merge(rows((1, 3, True, "c")), 3)) == (True, 1, [(2, 2, False, "d")])
    # estimates that all rows depend on have changed
    assert sent(pushed.merge(rows((3, 1, False, "e")), 4, "health-2")) == (True, 3, [(2, 2, False, "d"), (3, 1, False, "e")])
    assert sent(pushed.merge(rows((3, 2, False, "f")), 5, "health-2")) == (False, 4, [(3, 2, False, "f")])


def test_rows_without_a_role_move_the_clock_alone(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(engagements, "STRETCH", 3)
    lines = random.Random(6).sample(range(40), 40)
    frame = pd.DataFrame([(n, n * 2, None if n % 4 == 3 else "damage", None if n % 3 else "Ann") for n in lines], columns=["line_no", "s", "role", "actor"])
    latest, rows = engagements.in_order(iter([frame[:17], frame[17:], frame[:0]]))
    assert latest == 78 and [tuple(r) for r in rows] == [(n, n * 2, "damage", None if n % 3 else "Ann") for n in range(40) if n % 4 != 3]
