import pytest
from pyspark.sql import functions as F

from spanforge.functions import grammar
from spanforge.functions.schema import MODIFIERS
from spanforge.sources import lines as source

#: Our own lines: text, kind, fields.
CASES = [
    ("Mara slashes an old troll for 120 points of damage. (Lucky Critical)", "Damage", {"actor": "Mara", "target": "An old troll", "amount": 120, "damage_kind": "Melee", "sub_type": "Slashes", "modifiers": MODIFIERS["Lucky"] | MODIFIERS["Critical"]}),
    ("You kick an old troll for 1 point of damage.", "Damage", {"actor": "Me", "sub_type": "Kicks", "amount": 1}),
    ("You frenzy on an old troll for 12 points of damage.", "Damage", {"actor": "Me", "sub_type": "Frenzies", "target": "An old troll"}),
    ("An old troll bashes YOU for 31 points of damage. (Riposte Strikethrough)", "Damage", {"target": "Me", "modifiers": MODIFIERS["Strikethrough"]}),
    ("Mara hit an old troll for 44 points of cold damage by Icy Grip. (Twincast)", "Damage", {"damage_kind": "DirectDamage", "school": "cold", "sub_type": "Icy Grip", "modifiers": MODIFIERS["Twincast"]}),
    ("An old troll has taken 9 damage from Slow Burn by Mara.", "Damage", {"damage_kind": "DamageOverTime", "actor": "Mara", "sub_type": "Slow Burn", "is_spell": False}),
    ("An old troll has taken 9 damage from your Slow Burn.", "Damage", {"damage_kind": "DamageOverTime", "actor": "Me"}),
    ("Mara has taken 15 damage by Rain of Ash.", "Damage", {"damage_kind": "Other", "actor": "Rain of Ash", "is_spell": True}),
    ("Mara has taken 15 damage from Rain of Ash.", "Damage", {"damage_kind": "Other", "actor": "Rain of Ash", "is_spell": False}),
    ("You were hit by non-melee for 8 damage.", "Damage", {"damage_kind": "DirectDamage", "actor": None, "target": "Me"}),
    ("An old troll is burned by Mara's embers for 7 points of non-melee damage.", "Damage", {"damage_kind": "DamageShield", "actor": "Mara"}),
    ("An old troll was pierced by YOUR thorns for 7 points of non-melee damage.", "Damage", {"damage_kind": "DamageShield", "actor": "Me"}),
    ("Mara tries to slash an old troll, but misses!", "Damage", {"damage_kind": "Miss", "sub_type": "Slashes", "amount": 0}),
    ("An old troll tries to bite YOU, but YOU parry!", "Damage", {"damage_kind": "Parry", "target": "Me", "actor": "An old troll"}),
    ("An old troll tries to bite YOU, but YOUR magical skin absorbs the blow!", "Damage", {"damage_kind": "Absorb"}),
    ("Mara tries to slash an old troll, but an old troll ripostes!", None, {}),
    ("Mara healed Odo over time for 90 (120) hit points by Soothe. (Critical)", "Heal", {"actor": "Mara", "target": "Odo", "amount": 90, "potential": 120, "over_time": True, "spell": "Soothe", "modifiers": MODIFIERS["Critical"]}),
    ("Mara healed herself for 5 hit points.", "Heal", {"target": "Mara", "potential": 5, "over_time": False, "spell": None}),
    ("You have been healed for 50 hit points by Soothe.", "Heal", {"actor": None, "target": "Me"}),
    ("You have slain an old troll!", "Death", {"actor": "Me", "target": "An old troll"}),
    ("An old troll has been slain by Mara!", "Death", {"actor": "Mara"}),
    ("An old troll died.", "Death", {"actor": None, "target": "An old troll"}),
    ("Mara begins casting Soothe.", "Cast", {"spell": "Soothe", "cast_kind": "Begin", "song": False}),
    ("Your Soothe spell is interrupted.", "Cast", {"actor": "Me", "cast_kind": "Interrupted"}),
    ("Mara's spell fizzles!", "Cast", {"actor": "Mara", "cast_kind": "Fizzle", "spell": None}),
    ("Your Soothe spell has worn off of an old troll.", "WearOff", {"spell": "Soothe", "target": "An old troll"}),
    ("Mara activates Second Wind.", "Ability", {"ability": "Second Wind"}),
    ("You capture an old troll's attention!", "Taunt", {"actor": "Me", "success": True}),
    ("Mara failed to taunt an old troll.", "Taunt", {"success": False}),
    ("You have entered Grey Fen.", "Zone", {"zone": "Grey Fen"}),
    ("You have entered an area where flight does not work.", None, {}),
    ("LOADING, PLEASE WAIT...", "Zone", {"zone": None}),
    ("An old troll resisted your Soothe!", "Resist", {"target": "An old troll", "spell": "Soothe"}),
    ("You have gained a level! Welcome to level 9!", "Level", {"level": 9}),
    ("You gain party experience! (1.5%)", "Experience", {"percent": 1.5, "party": True, "aa_point": False}),
    ("Your faction standing with Fen Folk has been adjusted by -3.", "Faction", {"delta": -3, "better": False, "capped": False}),
    ("Your faction standing with Fen Folk could not possibly get any better.", "Faction", {"delta": None, "better": True, "capped": True}),
    ("--Mara has looted 3 Fen Reeds from a heron's corpse.--", "Loot", {"item": "Fen Reeds", "quantity": 3, "source": "a heron"}),
    ("You receive 1 platinum, 2 silver and 3 copper from the corpse.", "Loot", {"copper": 1023, "item": None}),
    ("You receive 2 gold 5 copper from Tolo for the Reed Mat(s).", "Merchant", {"copper": 205, "sold": True, "item": "Reed Mat"}),
    ("You receive a nod from the ferryman.", None, {}),
    ("A heron regards you indifferently -- it looks easy. (Lvl: 4)", "Consider", {"attitude": "indifferent", "level": 4, "target": "A heron"}),
    ("Mara has joined the raid.", "Membership", {"raid": True, "joined": True}),
    ("[40 Ranger] Mara (Elf) <Fenwalkers>", "Who", {"actor": "Mara", "level": 40, "class_text": "Ranger"}),
    ("Odo says, 'You have slain an old troll!'", "Chat", {"channel": "say", "actor": "Odo", "text": "You have slain an old troll!"}),
    ("You told Far.Mara, 'hi'", "Chat", {"channel": "tell", "actor": "Me", "target": "Mara"}),
    ("Odo tells Fen.road:3, 'on my way'", "Chat", {"channel": "custom", "custom_channel": "fen.road"}),
    ("ok", None, {}),
    ("Mara has shielded herself from 58 points of damage.", "Damage", {"damage_kind": "Absorb", "target": "Mara", "actor": None, "amount": 0}),
    ("You are scorched by a drake.  You have taken 79 points of damage.", "Damage", {"damage_kind": "DamageOverTime", "target": "Me", "amount": 79, "actor": None}),
    ("Mara has taken 12 damage from Ash by Night by Odo.", "Damage", {"sub_type": "Ash by Night", "actor": "Odo"}),
    ("An old troll is focused on attacking Mara due to an improved taunt.", "Taunt", {"actor": "Mara", "improved": True}),
    ("Odo hits an old troll for 99999999999999999999 points of damage.", None, {}),
    ("Tarn (Owner: Mara) hit an old troll for 7 points of non-melee damage. (Quake)", "Damage", {"actor": "Tarn", "actor_owner": "Mara", "sub_type": "Quake", "target_owner": None}),
    ("An old troll hit Tarn (Owner: Mara) for 7 points of fire damage by Flare.", "Damage", {"actor_owner": None, "target_owner": "Mara", "target": "Tarn"}),
    ("Mara slashes an old troll for 1 point of damage. (Double Bow Shot)", "Damage", {"modifiers": MODIFIERS["DoubleBowShot"]}),
    ("", None, {}),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.createDataFrame([("s", i, text) for i, (text, _, _) in enumerate(CASES)], "session_id string, line_no long, action string")
    dated = rows.withColumn("ts", F.lit("2024-03-09 20:00:00").cast("timestamp_ntz"))
    return {r["line_no"]: r for r in grammar.parse(dated, F.lit("Me")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: CASES[i][0][:40])
def test_lines(events, i):
    text, kind, fields = CASES[i]
    row = events.get(i)
    assert (row and row["kind"]) == kind
    for name, value in fields.items():
        assert row[name] == value, name


def test_readers(spark, tmp_path):
    stamp = lambda s: f"[Sat Mar 09 20:00:{s:02d} 2024] "
    text = f"{stamp(1)}one\r\n{stamp(2)}two{stamp(3)}three\nnot a line\n[Sat Feb 31 20:00:02 2024] bad date\n{stamp(4)}caf\xe9 au lait\n"
    (tmp_path / "eqlog_Mara_north_fen.txt").write_bytes(text.encode("latin-1"))
    found = source.dense(source.read(spark, str(tmp_path / "eqlog_Mara_north_fen.txt"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["ts"].second, r["action"]) for r in found] == [(1, 1, "one"), (2, 2, "two"), (3, 3, "three"), (4, 4, "café au lait")]
    assert {(r["owner_name"], r["server"]) for r in found} == {("Mara", "north_fen")}
    assert source.since(source.read(spark, str(tmp_path)), "2024-03-09 20:00:03").count() == 2


def test_zone_instances(spark):
    row = spark.createDataFrame([("Grey Fen 3 (Hard)",), ("Grey Fen",)], "z string").select(grammar.instance_zone(F.col("z")).alias("i")).collect()
    assert [tuple(r["i"]) for r in row] == [("Grey Fen", 3, "Hard"), ("Grey Fen", None, None)]


def test_announced_criticals_of_emulator_logs(spark):
    texts = ["Odo scores a critical hit!", "Mara hits a troll for 5 points of damage.", "Odo hits a troll for 7 points of damage.", "Odo hits a troll for 8 points of damage.", "Mara lands a Crippling Blow!(9)", "Mara bashes a troll for 9 points of damage."]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(texts)], "session_id string, line_no long, action string").withColumn("ts", F.lit("2024-03-09 20:00:00").cast("timestamp_ntz"))
    found = {r["line_no"]: r["modifiers"] for r in grammar.parse(rows, F.lit("Me"), emu=True).collect()}
    assert found == {1: 0, 2: MODIFIERS["Critical"], 3: 0, 5: MODIFIERS["Critical"]}
    assert {r["line_no"] for r in grammar.parse(rows, F.lit("Me")).collect()} == {1, 2, 3, 5}


def test_many_entries_on_a_line_keep_their_order(spark, tmp_path):
    stamp = lambda s: f"[Sat Mar 09 20:{s // 60:02d}:{s % 60:02d} 2024] "
    first = "".join(f"{stamp(i)}e{i:03d}" for i in range(300))
    (tmp_path / "eqlog_Mara_fen.txt").write_text(first + "\n" + f"{stamp(300)}e300\n{stamp(301)}e301\n")
    found = source.read(spark, str(tmp_path / "eqlog_Mara_fen.txt")).orderBy("line_no").collect()
    assert [r["action"] for r in found] == [f"e{i:03d}" for i in range(302)] and len({r["line_no"] for r in found}) == 302


def test_one_pass_is_scan_and_parse(spark):
    stamp = lambda s, day="09": f"[Sat Mar {day} 20:00:{s:02d} 2024] "
    texts = [stamp(i % 60) + case[0] for i, case in enumerate(CASES)] + [
        stamp(1) + "Mara died." + stamp(2) + "Odo died.\r", "noise " + stamp(3) + "Odo died.", stamp(4, "32") + "Odo died.", stamp(61) + "Odo died.", "[Sat Feb 29 20:00:04 2023] Odo died.", "[Thu Feb 29 20:00:04 2024] Odo died.",
        stamp(5) + "Jos\xe9 died.", stamp(6) + "x" * 70000, "", None, stamp(7),
    ]
    raw = spark.createDataFrame([("s", i, None if x is None else x.encode("latin-1")) for i, x in enumerate(texts)], "session_id string, line_no long, value binary")
    one = grammar.parse_text(raw, F.lit("Me"))
    # the text column of a log file holds the file's bytes
    two = grammar.parse(source.entries(raw).withColumn("line_no", F.col("line_no") * 4096 + F.col("part")), F.lit("Me"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert rows(one) == rows(two) and one.count() > 50
    assert {"Mara", "Odo", "José"} <= {r["target"] for r in one.where("kind = 'Death'").collect()}
