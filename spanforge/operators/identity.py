"""Who is who: verified players, known enemies and pets, as evidence that counts from its line on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chat channels whose senders are players.
PLAYER_CHANNELS = ("guild", "raid", "group", "fellowship", "tell")
POSSESSIVE_PET = r"^(.+?)[`']s (?:pet|warder|familiar)$"


def single_word(c: Column) -> Column:
    return c.isNotNull() & (c != "") & ~c.contains(" ")


def verified(events: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(name, session_id, first_line): the first line of each session that shows a name to be a player's.

    owners: (session_id, name) of the log owners, who are players from the start.
    """
    kind = F.col("kind")
    chat = (kind == "Chat") & F.col("channel").isin(*PLAYER_CHANNELS)
    leader = F.regexp_extract(F.coalesce("text", F.lit("")), r"^My leader is (\w+)", 1)
    name = F.when(chat | kind.isin("Membership", "Who"), F.col("actor")).when((kind == "Chat") & (leader != ""), leader)
    seen = events.select("session_id", "line_no", name.alias("name")).where(single_word(F.col("name")))
    if owners is not None:
        seen = seen.unionByName(owners.select("session_id", F.lit(0).cast("long").alias("line_no"), "name"))
    return seen.groupBy("session_id", "name").agg(F.min("line_no").alias("first_line"))


def _owned(events: DataFrame) -> DataFrame:
    """(session_id, ts, line_no, pet, owner): each line that maps a pet to an owner, a leader line, an annotation or a possessive name."""
    kind = F.col("kind")
    leader = F.regexp_extract(F.coalesce("text", F.lit("")), r"^My leader is (\w+)", 1)
    pairs = [
        events.where((kind == "Chat") & (leader != "")).select("session_id", "ts", "line_no", F.col("actor").alias("pet"), leader.alias("owner")),
        *[events.where(F.col(f"{side}_owner").isNotNull()).select("session_id", "ts", "line_no", F.col(side).alias("pet"), F.col(f"{side}_owner").alias("owner")) for side in ("actor", "target")],
        *[events.where(F.col(side).rlike(POSSESSIVE_PET)).select("session_id", "ts", "line_no", F.col(side).alias("pet"), F.regexp_extract(side, POSSESSIVE_PET, 1).alias("owner")) for side in ("actor", "target")],
    ]
    whole = pairs[0]
    for p in pairs[1:]:
        whole = whole.unionByName(p)
    return whole


def session_pets(events: DataFrame) -> DataFrame:
    """(session_id, pet, owner): the last owner of each session that a pet was mapped to."""
    return _owned(events).groupBy("session_id", "pet").agg(F.max_by("owner", F.struct("ts", "line_no")).alias("owner"))


def pets(events: DataFrame) -> DataFrame:
    """(pet, owner): the last owner that a pet was mapped to, for events of one session; `session_pets` keeps several apart."""
    return _owned(events).groupBy("pet").agg(F.max_by("owner", F.struct("ts", "line_no", "session_id")).alias("owner"))


def by_pet(pet_map: DataFrame, side: str) -> list[str]:
    """What pets are joined on: a map without sessions holds for all of them."""
    return ["session_id", side] if "session_id" in pet_map.columns else [side]


def pets_as(pet_map: DataFrame, side: str, mark: str) -> DataFrame:
    return pet_map.withColumnRenamed("pet", side).select(*by_pet(pet_map, side), F.lit(True).alias(mark)).distinct()


def known_npcs(events: DataFrame, players: DataFrame, pet_map: DataFrame) -> DataFrame:
    """(session_id, name, first_line): victims of nobody or of the players' side; a verified player is never one."""
    dead = events.where((F.col("kind") == "Death") & ~F.col("target").endswith(" pet"))
    side = players.select("session_id", F.col("name").alias("actor"), "first_line")
    judged = dead.join(side, ["session_id", "actor"], "left").join(pets_as(pet_map, "actor", "_pet"), by_pet(pet_map, "actor"), "left")
    killed = judged.where(F.col("actor").isNull() | (F.col("first_line") <= F.col("line_no")) | F.col("_pet"))
    found = killed.groupBy("session_id", F.col("target").alias("name")).agg(F.min("line_no").alias("first_line"))
    return found.join(players.select("session_id", "name"), ["session_id", "name"], "left_anti")


def definitely_npc(name: Column, known: Column, player: Column) -> Column:
    """Known as an enemy, or named like one: with an article or a blank, unless a possessive pet or a verified player."""
    shaped = name.rlike(r"(?i)^(a|an|the) ") | name.contains(" ")
    return ~player & ~name.rlike(POSSESSIVE_PET) & (known | shaped)


def with_sides(events: DataFrame, players: DataFrame, npcs: DataFrame, pet_map: DataFrame) -> DataFrame:
    """events with {actor,target}_player and {actor,target}_npc as known at each line; evidence of deaths counts from the next line."""
    out = events
    for side in ("actor", "target"):
        p = players.select("session_id", F.col("name").alias(side), F.col("first_line").alias("_p"))
        n = npcs.select("session_id", F.col("name").alias(side), F.col("first_line").alias("_n"))
        q = pets_as(pet_map, side, "_q")
        out = out.join(p, ["session_id", side], "left").join(n, ["session_id", side], "left").join(q, by_pet(pet_map, side), "left")
        player = F.coalesce(F.col("_p") <= F.col("line_no"), F.lit(False))
        pet = F.coalesce(F.col("_q"), F.lit(False)) | F.coalesce(F.col(side).rlike(POSSESSIVE_PET), F.lit(False))
        npc = definitely_npc(F.col(side), F.coalesce(F.col("_n") < F.col("line_no"), F.lit(False)), player) & ~pet
        out = out.withColumn(f"{side}_player", player | pet).withColumn(f"{side}_npc", F.coalesce(npc, F.lit(False))).drop("_p", "_n", "_q")
    return out
