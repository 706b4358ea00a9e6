"""Owners of pets, of one session and of several."""

import datetime

from spanforge.functions.schema import EVENT_DDL, FIELDS
from spanforge.operators import identity


def says(session, line, pet, owner):
    given = {"session_id": session, "line_no": line, "ts": datetime.datetime(2024, 1, 1, 0, 0, line), "kind": "Chat", "actor": pet, "text": f"My leader is {owner}"}
    return tuple(given.get(n) for n in ["session_id", "line_no", "ts", "kind", *FIELDS])


def test_a_pet_has_one_owner_a_session_and_one_in_a_map_without_sessions(spark):
    events = spark.createDataFrame([says("a", 1, "Rex", "Mara"), says("a", 2, "Rex", "Nilo"), says("b", 1, "Rex", "Mara"), says("b", 3, "Fido", "Mara")], EVENT_DDL)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(identity.session_pets(events)) == [("a", "Rex", "Nilo"), ("b", "Fido", "Mara"), ("b", "Rex", "Mara")]
    assert rows(identity.pets(events)) == [("Fido", "Mara"), ("Rex", "Nilo")]
