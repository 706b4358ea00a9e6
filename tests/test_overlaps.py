"""Fights that overlap many times over: work follows seconds, not pairs of rows."""

from test_query import hit
from test_ties import world_of

from spanforge.operators import feeds, segments
from spanforge.plans.query import QuerySpec, compile_query


def test_an_enemys_minute_has_few_candidates(spark):
    spans = [(1000 - i, "A Gnoll" if i % 2 else "A gnoll", 60 * 10 + i % 3, 60 * 14 + i % 5) for i in range(300)] + [(1, "A gnoll", 5, 7), (2, "A gnoll", 9, None)]
    fights = spark.createDataFrame(spans, "id int, name string, begin long, last_damage long")
    assert feeds.first_by_minute(fights).count() == 1 + 3 + 3 + 5
    hits = [(i, "a gnoll", s) for i, s in enumerate([6, 8, 9, 599, 600, 601, 602, 700, 840, 842, 844, 845])]
    found = feeds.fight_at(spark.createDataFrame(hits, "line_no long, attacker string, s long"), fights)
    want = {i: min([n for n, _, b, e in spans if e is not None and b <= s <= e], default=None) for i, _, s in hits}
    assert {r["line_no"]: r["fight_id"] for r in found.collect()} == want


def test_units_meet_seconds_and_not_every_row_of_them(spark, monkeypatch):
    met = []
    within = segments.within
    monkeypatch.setattr(segments, "within", lambda points, *rest: met.append(points.count()) or within(points, *rest))
    rows = [hit(i, 1 + i % 2, "Raider01", "A dragon", i) for i in range(1, 51)]
    world = world_of(spark, rows, [("A dragon", 0, 5), ("A dragon", 2, 9), ("A dragon", 1, 1)])
    found = compile_query(world, QuerySpec("damage", groupBy=["player"], metrics=["total", "hits", "maxHit", "activeSeconds"], petRollup=False, bucketSeconds=60))
    total = sum(2 * i for i in range(1, 51))
    assert met == [2]
    assert [tuple(r)[3:7] for r in found.rows.where("level = 1").collect()] == [(total, 100, 50, 2)]
    assert {r["value"] for r in found.series.collect()} == {total}
