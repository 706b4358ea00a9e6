import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import feeds, fights, identity, intervals, learned, lookup, present, segments, spells


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_presence_splits_at_ten_minutes(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 599), ("a", 3, 1199), ("a", 4, 1200)], "k string, n long, s long")
    assert rows_of(segments.presence(df, ["k"], ["s", "n"])) == [("a", 1, 0, 599, 2), ("a", 2, 1199, 1200, 2)]


def test_as_of_matches_a_loop(spark):
    rng = random.Random(4)
    left = [(rng.randrange(3), rng.randrange(200), i) for i in range(150)]
    right = [(rng.randrange(3), rng.randrange(200), i, i * 10) for i in range(40)]
    for strict in (False, True):
        got = segments.as_of(spark.createDataFrame(left, "k int, s long, n long"), spark.createDataFrame(right, "k int, s long, n long, v long"), ["k"], ["n"], ["v"], 30, strict)
        want = []
        for k, s, n in left:
            before = [r for r in right if r[0] == k and (r[1] < s or (r[1] == s and not strict))]
            last = max(before, key=lambda r: (r[1], r[2]), default=None)
            near = last is not None and s - last[1] <= 30
            want.append((k, s, n, last[3] if near else None, last[1] if near else None))
        assert sorted(map(tuple, got.select("k", "s", "n", "v", "as_of").collect()), key=str) == sorted(want, key=str)


def test_steps_drop_repeats(spark):
    df = spark.createDataFrame([("a", 1, 10, "x"), ("a", 2, 20, "x"), ("a", 3, 30, "z"), ("a", 4, 30, "y")], "k string, n long, s long, v string")
    assert segments.steps(df, ["k"], ["n"], "v").orderBy("b").collect() == [("a", "x", 10, 29), ("a", "y", 30, None)]


def replay(rows):
    """The stateful rule, row by row: (line, fight) of one enemy."""
    out, open_fight, number = [], None, 0
    for line, s, damaging, ends in rows:
        if open_fight and (s - open_fight["last"] > 60 or (open_fight["hurt"] and s - open_fight["last"] > 30)):
            open_fight = None
        if ends:
            if open_fight:
                out.append((line, open_fight["n"]))
                open_fight = None
            continue
        if not open_fight:
            number += 1
            open_fight = {"n": number, "hurt": False}
        open_fight |= {"last": s, "hurt": open_fight["hurt"] or damaging}
        out.append((line, open_fight["n"]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fights_equal_a_replay(spark, seed):
    rng, s, rows = random.Random(seed), 0, []
    for line in range(1, 120):
        s += rng.choice([0, 1, 5, 29, 30, 31, 45, 59, 60, 61, 90])
        ends = rng.random() < 0.08
        rows.append((line, s, not ends and rng.random() < 0.5, ends))
    df = spark.createDataFrame([("x", "A troll", 0, *r) for r in rows], "session_id string, npc string, zone_change long, line_no long, s long, damaging boolean, ends boolean")
    got = [(r["line_no"], r["fight"]) for r in fights.assigned(df).orderBy("line_no").collect()]
    want = replay(rows)
    # numbers may skip where a death met no fight; what belongs together must agree
    assert [a for a, _ in got] == [a for a, _ in want]
    assert len({(g, w) for (_, g), (_, w) in zip(got, want)}) == len({w for _, w in want}) == len({g for _, g in got})


def test_identity_and_fights_from_events(spark):
    from spanforge.functions import grammar
    from spanforge.plans.query import with_seconds

    text = [
        (1, 0, "You have entered Grey Fen."), (2, 1, "Mara tells the group, 'ready'"), (3, 2, "Mara slashes a troll for 10 points of damage."), (4, 3, "A troll bites Mara for 4 points of damage."),
        (5, 4, "Rex says, 'My leader is Mara'"), (6, 5, "Rex bites a troll for 3 points of damage."), (7, 6, "A troll has been slain by Mara!"), (8, 100, "Mara slashes Grub for 5 points of damage."),
    ]
    lines = spark.createDataFrame([("s", n, t, a) for n, t, a in text], "session_id string, line_no long, t int, action string")
    lines = lines.withColumn("ts", F.timestamp_add("SECOND", F.col("t"), F.lit("2024-01-01").cast("timestamp_ntz"))).drop("t")
    events = with_seconds(grammar.parse(lines, F.lit("Me"))).cache()
    players = identity.verified(events)
    pets = identity.pets(events)
    assert rows_of(players.select("name")) == [("Mara",)] and rows_of(pets) == [("Rex", "Mara")]
    sided = identity.with_sides(events, players, identity.known_npcs(events, players, pets), pets)
    rows = fights.assigned(fights.with_zone(fights.engaged(sided), events))
    found = {r["name"]: r for r in fights.fights(rows, players, pets).collect()}
    troll = found["A troll"]
    assert (troll["damage_total"], troll["tanking_total"], troll["dead"], troll["closed"], troll["zone"]) == (13, 4, True, True, "Grey Fen")
    assert found["Grub"]["damage_total"] == 5 and not found["Grub"]["dead"]
    totals = fights.actor_totals(rows).where("dealt").groupBy("npc").agg(F.sum("total").alias("t")).collect()
    assert {r["npc"]: r["t"] for r in totals} == {"A troll": 13, "Grub": 5}


def test_mentions_longest_first_and_not_beside_capitals(spark):
    texts = spark.createDataFrame([(1, "Sold the Iron Ring, iron ring of fen for gold; Ring"), (2, "A Ring Bearer came"), (3, "nothing")], "id long, text string")
    names = spark.createDataFrame([("Iron Ring",), ("Iron Ring of Fen",), ("Ring",)], "name string")
    assert rows_of(feeds.mentions(texts, names, ["id"]).select("id", "name")) == [(1, "Iron Ring"), (1, "Iron Ring of Fen"), (1, "Ring")]


def test_tail_and_fuzzy(spark):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(30)], "n long, name string")
    tail = feeds.tail(df, ["n"], 3).collect()
    assert [(r["n"], r["total"]) for r in tail] == [(27, 30), (28, 30), (29, 30)]
    items = spark.createDataFrame([("Iron Ring",), ("Ring of Iron",), ("Bowl",)], "name string")
    assert [r["name"] for r in feeds.fuzzy(items, "name", "iron rng").collect()][:2] == ["Iron Ring", "Ring of Iron"]


def test_learned_indexes(spark):
    hits = spark.createDataFrame([("a", i, 100) for i in (0, 10, 100, 200, 300, 400)], "k string, s long, v long").withColumn("n", F.col("s"))
    clean = learned.uncrowded(hits, ["k"], ["n"])
    assert [r["clean"] for r in clean.orderBy("s").collect()] == [False, False, True, True, True, True]
    one = learned.estimates(clean.where("clean"), ["k"], "v").first()
    assert (one["n"], one["p50"], one["grade"]) == (4, 100, "Medium")
    reg = learned.item_registry(spark.createDataFrame([("Iron  Ring +2", 5, 1, 1, 0, 0, False), ("iron ring", 9, 2, 0, 1, 0, True)], "name string, seen long, source_bit int, looted int, sold int, bought int, from_file boolean")).collect()
    assert [(r["key"], r["name"], r["sources"], r["looted"], r["sold"]) for r in reg] == [("iron ring", "iron ring", 3, 1, 1)]
    values = [1, 3, 7, 1000, 5000]
    quant = learned.histogram_quantile(learned.histogram(spark.createDataFrame([("a", v) for v in values], "k string, v long"), ["k"], "v"), ["k"], 0.5).first()
    assert quant["value"] == round(2 ** ((int(__import__("math").log2(7) * 4) + 0.5) / 4))


def test_lookups(spark):
    npcs = spark.createDataFrame([(1, "a heron", 4), (2, "heron", 8), (3, "The Heron", None)], "id int, name string, level int")
    index = lookup.build_index(npcs).first()
    assert index["key"] == "heron" and [v["id"] for v in index["variants"]] == [1, 2, 3] and index["name"] in ("a heron", "The Heron")
    labels = spark.createDataFrame([(1, "to Grey Fen/Old Road (north)"), (2, "chest"), (3, "Harbour")], "id int, label string")
    assert rows_of(lookup.destinations(labels, ["id"])) == [(1, "Grey Fen"), (1, "Old Road"), (3, "Harbour")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y")], "a string, b string")
    assert {r["node"]: (r["hops"], r["via"]) for r in lookup.routes(edges, "a").collect()} == {"a": (0, None), "b": (1, "a"), "d": (1, "a"), "c": (2, "b")}
    assert spark.range(1).select(lookup.zone_key(F.lit("The Grey-Fen 2"))).first()[0] == "greyfen2"


def test_presentation(spark):
    assert [present.bucket_width(n) for n in (100, 1501, 10**7)] == [1, 2, 6667]
    assert [present.parse_duration(t) for t in ("1h30m", "-6h", "5", "2d 1s")] == [5400, -21600, None, 172801]
    shown = spark.createDataFrame([(950.0,), (1234.0,), (2.5e6,), (7e9,)], "v double").select(present.short_number(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["950", "1.2K", "2.5M", "7.0B"]
    series = spark.createDataFrame([("a", 0, 10.0), ("a", 30, 20.0)], "k string, at long, value double")
    full = present.rolling_mean(present.filled(series, ["k"], 10), ["k"], 2).orderBy("at").collect()
    assert [(r["at"], r["mean"]) for r in full] == [(0, 10.0), (10, 5.0), (20, 0.0), (30, 10.0)]


def test_spell_book(spark):
    names = spark.createDataFrame([(1, "Soothe"), (2, "Calm"), (3, "Rest")], "id int, name string")
    strings = spark.createDataFrame([(1, "You feel well.", " feels well.", "It fades."), (2, "You are calm.", " is calm.", "It fades."), (3, "You rest.", " is calm.", "You wake.")], "id int, landed_me string, landed_other string, gone string")
    book = spells.book(names, strings)
    lines = spark.createDataFrame([("s", 1, "You feel well."), ("s", 2, "A troll is calm."), ("s", 3, "It fades."), ("s", 4, "You wake."), ("s", 5, "Mara feels well.")], "session_id string, line_no long, action string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = {r["line_no"]: (r["kind"], r["target"], r["spell"], r["candidates"]) for r in spells.recognise(lines, book, "Me").collect()}
    assert found == {1: ("Landed", "Me", "Soothe", 1), 2: ("Landed", "A troll", None, 2), 4: ("WearOff", "Me", "Rest", 1), 5: ("Landed", "Mara", "Soothe", 1)}
    secs = spark.createDataFrame([(7, 0, 10), (50, 5, 10), (3, 20, 10), (1, 0, 0)], "f int, c int, l int").select(spells.duration(F.col("f"), F.col("c"), F.col("l"))).collect()
    assert [r[0] for r in secs] == [60, None, 120, 0]


def test_top_and_other_counts_null_once(spark):
    df = spark.createDataFrame([(None, 10), ("a", 5), ("b", 1)], "k string, v long")
    assert sorted(map(tuple, present.top_and_other(df, "k", "v", 2).collect()), key=str) == [("Other (1)", 1), ("a", 5), (None, 10)]


def test_fuzzy_scores(spark):
    def plain(name, query):
        low, total = (name or "").lower(), 0
        for token in query.split():
            at = low.find(token)
            if at >= 0:
                total += 100 - min(at, 50) + (20 if at == 0 or not low[at - 1].isalnum() else 0)
                continue
            place = -1
            for c in token:
                place = low.find(c, place + 1)
                if place < 0:
                    return None
            total += max(1, 30 - (place + 1 - len(token)))
        return float(total)

    names = ["Red Widget", "rod.wedge", "widget", None, "", "bird (w) dog", "x" * 60 + "rd wdg", "Ring rd"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r["i"]: r["score"] for r in feeds.fuzzy(df, "n", "rd wdg").collect()}
    assert got == {i: s for i, n in enumerate(names) if (s := plain(n, "rd wdg")) is not None}


def test_ranks_over_many_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    got = segments.ranked(df, [(F.col("g"), True), (F.col("v"), False)]).collect()
    want = sorted(((r["g"], r["v"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r["g"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 1001))


def test_merged_intervals_against_seconds(spark):
    rng = __import__("random").Random(3)
    rows = [(k, b, b + rng.choice([0, 5, 3000, 9000])) for k in "ab" for b in (rng.randrange(40000) for _ in range(60))] + [("a", 3599, 3600), ("b", 7300, 7199), ("c", 0, 3599), ("c", 3600, 3600), ("c", 3602, 3602)]
    found = intervals.merge(spark.createDataFrame(rows, "k string, b long, e long"), ["k"]).collect()
    want = {}
    for k, b, e in rows:
        want.setdefault(k, set()).update(range(min(b, e), max(b, e) + 1))
    got = sorted((r["k"], r["b"], r["e"]) for r in found)
    assert {k: {s for x, b, e in got if x == k for s in range(b, e + 1)} for k in want} == want
    assert all(a[0] != z[0] or z[1] > a[2] + 1 for a, z in zip(got, got[1:]))


def test_era_filter_and_shards(spark):
    from pyspark.sql import functions as F

    from spanforge.operators import lookup

    zones = spark.createDataFrame([("a", "old"), ("b", "mid"), ("c", "new"), ("d", None), ("e", "?")], "z string, era string")
    kept = lambda through: sorted(r.z for r in zones.where(lookup.within_era(F.col("era"), through, ["old", "mid", "new"])).collect())
    assert kept("mid") == ["a", "b", "d", "e"] and kept("new") == kept(None) == kept("x") == ["a", "b", "c", "d", "e"]
    assert spark.range(22999, 23001).select(lookup.shard_of(F.col("id")).alias("s")).collect() == [(22,), (23,)]


def test_attack_estimates_count_melee_alone(spark):
    ddl = "mob string, level int, damage_kind string, sub_type string, amount long"
    melee = [("a", 50, "Melee", "Bites", 16), ("a", 50, "Miss", "Bites", 0), ("a", 50, "Melee", "", 64), ("a", 50, "Absorb", None, 0)]
    spells = [("a", 50, "DirectDamage", "Blaze", 1000), (None, None, "Other", "Fire", 5), ("b", None, "Melee", None, 0), ("b", None, None, None, None)]
    parts = [learned.attack_tallies(spark.createDataFrame(p, ddl), ["mob", "level"]) for p in (melee, spells)]
    merged = learned.merge_tallies(parts[0].unionByName(parts[1]), ["mob", "level"])
    got = {r["mob"]: r for r in learned.attack_estimates(merged, ["mob", "level"], "level").collect()}
    pick = lambda m, *names: tuple(got[m][n] for n in names)
    names = ("swings", "landed", "total", "max_hit", "min_hit", "all_total", "spell_total", "hit_rate", "absorb_rate", "grade")
    assert pick("a", *names) == (4, 2, 80, 64, 16, 1080, 1000, 50.0, 25.0, "Low")
    assert pick("a", "p10", "median", "p90") == (17, 17, 70)
    assert pick(None, *names) == (0, 0, 0, 0, 0, 5, 5, 0.0, 0.0, "Low")
    assert pick("b", *names) == (1, 0, 0, 0, 0, 0, 0, 0.0, 0.0, "Low")
    assert learned.attack_estimates(merged.limit(0), ["mob", "level"], "level").count() == 0


def test_newest_evidence_order(spark):
    df = spark.createDataFrame([("b", 1, 5), ("A", 1, 5), ("c", 1, 9), ("d", 2, 0)], "mob string, last_seen int, landed int")
    assert [r["mob"] for r in learned.newest_evidence(df).collect()] == ["d", "c", "A", "b"]


def test_predicted_ends_follow_the_cast(spark):
    cast = lambda n, spell, who="Me": ("x", n, n * 10, "Cast", who, "Begin", spell, None)
    other = lambda n, kind, spell=None, level=None: ("x", n, n * 10, kind, None, None, spell, level)
    rows = [
        cast(1, "Early"), other(2, "Level", level=10), cast(3, "Kept"), other(3, "Level", "Early", 10), cast(4, "kept"), cast(5, "Again"), other(6, "WearOff", "Again"), other(7, "Level", level=20), other(8, "Landed", "Again"),
        cast(9, "Gone"), other(10, "WearOff", "gone"), cast(11, "Strange", "You"), other(12, "Landed", "Strange"), cast(13, "Always"), cast(14, None), other(15, "WearOff"),
    ]
    ddl = "session_id string, line_no long, s long, kind string, actor string, cast_kind string, spell string, level int"
    known = spark.createDataFrame([(n, 50 if n == "ALWAYS" else 7, 0) for n in ("early", "kept", "again", "gone", "strange", "ALWAYS")], "name string, formula int, cap int")
    assert rows_of(spells.predicted_ends(spark.createDataFrame(rows, ddl), known, "me")) == [("x", "Again", 80, 140), ("x", "Kept", 30, 90)]
    assert spells.predicted_ends(spark.createDataFrame([], ddl), known, "me").count() == 0
