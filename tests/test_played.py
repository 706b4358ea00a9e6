"""Fights and play sessions that overlap many times over: scopes follow seconds, not pairs of them."""

import random

import pytest
from test_query import T0, event, hit
from test_ties import world_of

from spanforge.operators import intervals
from spanforge.plans.query import QuerySpec, Scope, compile_query, units

NAMES = ("A dragon", "A wyrm")


@pytest.fixture(scope="module")
def log():
    """Hits, logins and fights about the turn of an hour, and a fight whose hits are hours apart."""
    rng = random.Random(11)
    rows, line = [], 0
    for second in sorted(rng.randrange(3550, 3650) for _ in range(150)):
        line += 1
        login = rng.random() < 0.3
        rows.append(event(line, second, "Zone", zone="Fen", welcome=True) if login else hit(line, second, f"Raider0{rng.randrange(3)}", rng.choice(NAMES), rng.randrange(1, 100)))
    rows += [hit(line + 1, 3590, "Raider09", "A wyrm", 5), hit(line + 2, 11000, "Raider09", "A wyrm", 7)]
    fights = [(rng.choice(NAMES), b, b + rng.randrange(40)) for b in (rng.randrange(3540, 3640) for _ in range(60))]
    return rows, fights + [("A wyrm", 3580, 11500)]


def overlaps(left, right):
    return [(name, max(b, x), min(e, y)) for name, b, e in left for x, y in right if max(b, x) <= min(e, y)]


def scoped(rows, fights, scope):
    """Every unit of the scope, (name, b, e) in seconds from T0."""
    found = [(name, b, e) for name, b, e in fights]
    if scope.playedTimeOnly:
        played, last = [], None
        for r in sorted(rows, key=lambda r: (r["second"], r["line_no"])):
            s = r["second"] - T0
            if last is None or s - last >= 600 or r.get("welcome"):
                played.append([s, s])
            played[-1][1] = last = s
        found = overlaps(found, played)
    if scope.maxSeconds:
        kept = sorted({s for _, b, e in found for s in range(b, e + 1)})[scope.skipFirstSeconds : scope.skipFirstSeconds + scope.maxSeconds]
        runs = [[s, s] for s in kept[:1]]
        for s in kept[1:]:
            if s == runs[-1][1] + 1:
                runs[-1][1] = s
            else:
                runs.append([s, s])
        found = overlaps(found, runs)
    return found


def plain(rows, found):
    """(total, active seconds) of each player and of all, over every unit by itself."""
    out = {}
    for path in [(), ("Raider00",), ("Raider01",), ("Raider02",), ("Raider09",)]:
        total, seconds = 0, set()
        for name, b, e in found:
            met = [r for r in rows if r["kind"] == "Damage" and r["target"] == name and b <= r["second"] - T0 <= e and path in ((), (r["actor"],))]
            total += sum(r["amount"] for r in met)
            if met:
                seconds |= set(range(min(r["second"] for r in met), max(r["second"] for r in met) + 1))
        if seconds:
            out[path] = (total, len(seconds))
    return out


@pytest.mark.parametrize("scope", [Scope(), Scope(playedTimeOnly=True), Scope(skipFirstSeconds=20, maxSeconds=60, playedTimeOnly=True)], ids=["fights", "played", "trimmed"])
def test_totals_and_active_seconds_are_those_of_every_unit(spark, log, scope):
    rows, fights = log
    spec = QuerySpec("damage", scope, ["player"], ["total", "activeSeconds"], petRollup=False)
    world, every = world_of(spark, rows, fights), scoped(rows, fights, scope)
    found = {tuple(r["path"]): (r["total"], r["activeSeconds"]) for r in compile_query(world, spec).rows.collect()}
    assert found == plain(rows, every)


def test_fights_and_play_sessions_are_not_paired(spark, log):
    rows, fights = log
    few = [f for f in fights if f[2] < 3700]
    world = world_of(spark, rows, few * 20)
    spec = QuerySpec("damage", Scope(playedTimeOnly=True), ["player"], ["total"], petRollup=False)
    assert len(scoped(rows, few * 20, spec.scope)) > 5000
    # a second of an enemy is in one piece
    assert units(world, spec).count() <= 100 * len(NAMES)


def test_pieces_count_what_holds_them(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice("ab"), b, b + rng.choice([0, 3, 50, 130])) for b in (rng.randrange(-70, 200) for _ in range(n))]
    left, right = some(30), [(b, e) for _, b, e in some(12)]
    frames = spark.createDataFrame(left, "k string, b long, e long"), spark.createDataFrame(right, "b long, e long")

    def by_second(pieces):
        seen = [((r["k"], s), (r["n"], r["lo"], r["hi"])) for r in pieces.collect() for s in range(r["b"], r["e"] + 1)]
        assert len(seen) == len(dict(seen))
        return dict(seen)

    def want(found):
        held = {}
        for k, b, e in found:
            for s in range(b, e + 1):
                n, lo, hi = held.get((k, s), (0, b, e))
                held[k, s] = (n + 1, min(lo, b), max(hi, e))
        return held

    pieces = intervals.covered(frames[0], ["k"])
    assert by_second(pieces) == want(left)
    assert by_second(intervals.covered_by_both(pieces, intervals.covered(frames[1], []))) == want(overlaps(left, right))
