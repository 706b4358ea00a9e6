"""Lines that no rule takes are looked up in the spell book as part of parsing."""

import datetime

from spanforge.functions import grammar
from spanforge.operators import spells

LINES = [
    "Raider01 slashes a gnoll for 5 points of damage.",
    "A burst of strength surges through your body.",
    "Raider02 looks stronger.",
    "Raider03's skin shimmers.",
    "The looks stronger.",
    "You feel weaker.",
    "Two spells end alike.",
    "nothing that anybody knows",
    "Raider01 begins casting Might.",
]


def test_emotes_become_landings_and_fades(spark):
    names = spark.createDataFrame([(1, "Might"), (2, "Shimmer"), (3, "Echo"), (4, "Reply")], "id int, name string")
    strings = spark.createDataFrame(
        [(1, "A burst of strength surges through your body.", " looks stronger.", "You feel weaker."), (2, "Your skin shimmers.", "'s skin shimmers.", "Your skin fades."), (3, "x1", " x2", "Two spells end alike."), (4, "x3", " x4", "Two spells end alike.")],
        "id int, landed_me string, landed_other string, gone string",
    )
    lines = spark.createDataFrame([("s", i, datetime.datetime(2024, 3, 9, 20, 0, i), x) for i, x in enumerate(LINES)], "session_id string, line_no long, ts timestamp_ntz, action string")
    book = spells.book(names, strings)
    found = {r["line_no"]: r for r in grammar.parse(lines, emotes=book, owner_name="Ann").collect()}
    assert {i: (r["kind"], r["target"], r["spell"]) for i, r in found.items()} == {
        0: ("Damage", "A gnoll", None), 1: ("Landed", "Ann", "Might"), 2: ("Landed", "Raider02", "Might"), 3: ("Landed", "Raider03", "Shimmer"), 5: ("WearOff", "Ann", "Might"), 8: ("Cast", None, "Might"),
    }
    # without a book they are left out
    assert {r["line_no"] for r in grammar.parse(lines).collect()} == {0, 8}
