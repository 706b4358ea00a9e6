"""Attack records: one sample a fight start, the newest starts remembered, older ones taken for counted."""

import random

from spanforge.operators import learned, segments

SCHEMA = "mob_key string, zone_key string, difficulty int, tier string, defender_level int, mob string, stamp long, fight int, defender string, first_line long, skill string, bucket int, spell boolean, swings long, landed long, misses long, dodges long, parries long, blocks long, absorbs long, invulnerable long, total long, max_hit long, min_hit long"


def sample(stamp, fight, first_line, swings, level=None, mob="a gnoll"):
    return (mob, "fen", None, None, level, mob, stamp, fight, "Ann", first_line, "Bites", None, False, swings, 0, 0, 0, 0, 0, 0, 0, 0, None, None)


def replay(batches, remembered):
    """Plain rule: samples by start, then fight and line; a remembered or too old start is skipped."""
    stamps, swings = {}, {}
    for rows in batches:
        for r in sorted(rows, key=lambda r: (r[6], r[7], r[9])):
            key = (r[0], r[4])
            held = stamps.setdefault(key, [])
            if r[6] in held or (len(held) >= remembered and r[6] < held[0]):
                continue
            held.append(r[6])
            held.sort()
            del held[:-remembered]
            swings[key] = swings.get(key, 0) + r[13]
    return stamps, swings


def test_merges_follow_the_plain_rule(spark):
    rng = random.Random(2)
    batches = [[sample(rng.randrange(60), rng.randrange(5), line, rng.randrange(1, 9), rng.choice([None, 50]), rng.choice(["a gnoll", "a wolf"])) for line in range(40)] for _ in range(3)]
    kept = tallies = None
    for i, rows in enumerate([*batches, batches[-1]]):  # the last one twice
        kept, tallies = learned.merge_attacks(spark.createDataFrame(rows, SCHEMA), kept, tallies, remembered=7)
        kept, tallies = segments.cut(kept), segments.cut(tallies)
        stamps, swings = replay(batches[: i + 1], 7)
        assert {(r["mob_key"], r["defender_level"]): r["stamps"] for r in kept.collect()} == stamps
        assert {(r["mob_key"], r["defender_level"]): r["swings"] for r in tallies.groupBy("mob_key", "defender_level").sum("swings").withColumnRenamed("sum(swings)", "swings").collect()} == swings


def test_samples_that_count_are_made_alone(spark):
    """Fights of one enemy that overlap and begin at once: the same records from what counts as from every sample."""
    rng = random.Random(3)
    begun = [(i, rng.choice(["A gnoll", "a gnoll", "a wolf"]), b := rng.randrange(300), b + rng.randrange(90), True, rng.choice(["Fen", "Keep"])) for i in range(1, 120)]
    fights = spark.createDataFrame(begun, "id int, name string, begin long, last_damage long, closed boolean, zone string")
    hits = [(line, rng.randrange(420), "Damage", rng.choice(["A gnoll", "A wolf"]), rng.choice(["Ann", "ANN", "Bob", None]), "Melee", "Bites", rng.randrange(50), False, False) for line in rng.sample(range(1000), 400)]
    sided = spark.createDataFrame(hits, "line_no long, s long, kind string, actor string, target string, damage_kind string, sub_type string, amount long, is_spell boolean, target_npc boolean")
    every, few = (segments.cut(learned.harvest_attacks(sided, fights, every=x)) for x in (True, False))
    keys = few.select(*learned.ATTACK_KEY, "stamp")
    assert few.select("fight").distinct().count() == keys.distinct().count() < every.select("fight").distinct().count()
    for a, b in zip(learned.merge_attacks(every), learned.merge_attacks(few)):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
