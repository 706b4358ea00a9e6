"""Engagements with one enemy: which rows belong together, how they end, and what they add up to.

A fight expires after more than 30 idle seconds once it has damage, after more than 60 before.  Cut a stream at every
gap above 30 s: the fight before such a gap has damage exactly if the last piece has, because any piece with damage ends
its fight at the gap after it.  So the stateful rule is two window passes, by session, zone stretch and enemy.  What looks
over a whole session (zones, numbers of fights, chains) goes by stretches of it (`segments.carried`), as one log may be
the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import identity, segments

IDLE, IDLE_UNDAMAGED = 30, 60
CAST_MEMORY = 300


def engaged(sided: DataFrame) -> DataFrame:
    """Rows that open or extend a fight, with npc (its enemy), damaging and dealt (by the players' side).

    Exactly one side is the enemy's; an unknown name against a player's is taken for an enemy, an unknown attacker of
    an enemy for the players' side.  A spell that hits by itself counts if one who is no enemy cast it within 300 s.
    """
    hits = sided.where((F.col("kind") == "Damage") & F.col("actor").isNotNull())
    casts = sided.where((F.col("kind") == "Cast") & (F.col("cast_kind") == "Begin") & ~F.col("actor_npc")).select("session_id", "s", "line_no", F.lower("spell").alias("_spell"), F.lit(True).alias("recent"))
    own = hits.where(~F.coalesce("is_spell", F.lit(False)))
    spells = segments.as_of(hits.where("is_spell").withColumn("_spell", F.lower("actor")), casts, ["session_id", "_spell"], ["line_no"], ["recent"], CAST_MEMORY)
    spells = spells.where("recent").drop("_spell", "recent", "as_of").withColumn("actor_npc", F.lit(False)).withColumn("actor_player", F.lit(True))
    hits = own.unionByName(spells)
    a_npc, t_npc, a_player, t_player = (F.col(c) for c in ("actor_npc", "target_npc", "actor_player", "target_player"))
    npc = F.when(t_npc & ~a_npc, F.col("target")).when(a_npc & ~t_npc, F.col("actor")).when(a_player & ~t_player & ~t_npc, F.col("target")).when(t_player & ~a_player & ~a_npc, F.col("actor"))
    damage = hits.select("session_id", "line_no", "s", npc.alias("npc"), F.lit(True).alias("damaging"), (npc == F.col("target")).alias("dealt"), F.when(npc == F.col("target"), F.col("actor")).otherwise(F.col("target")).alias("actor"), "amount", F.lit(False).alias("ends"))
    taunts = sided.where((F.col("kind") == "Taunt") & (t_npc | a_player) & ~t_player)
    taunt = taunts.select("session_id", "line_no", "s", F.col("target").alias("npc"), F.lit(False).alias("damaging"), F.lit(None).cast("boolean").alias("dealt"), "actor", F.lit(0).cast("long").alias("amount"), F.lit(False).alias("ends"))
    deaths = sided.where(F.col("kind") == "Death").select("session_id", "line_no", "s", F.col("target").alias("npc"), F.lit(False).alias("damaging"), F.lit(None).cast("boolean").alias("dealt"), F.lit(None).cast("string").alias("actor"), F.lit(0).cast("long").alias("amount"), F.lit(True).alias("ends"))
    return damage.unionByName(taunt).unionByName(deaths).where("npc is not null")


def with_zone(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with zone and zone_change (how many zone lines came before), from the last zone line at or before each."""
    zones = events.where(F.col("kind") == "Zone").select("session_id", "line_no", "zone")
    both = rows.withColumn("_zone_line", F.lit(1)).unionByName(zones.withColumn("_zone_line", F.lit(0)), allowMissingColumns=True).withColumnRenamed("zone", "_zone")
    keys, order, line = ["session_id"], ["line_no", "_zone_line"], F.col("_zone_line") == 0
    held = segments.carried(segments.dealt(both, keys, order), keys, order, _held=("last", F.when(line, F.struct("_zone"))), zone_change=("sum", line.cast("long")))
    return held.withColumn("zone", F.col("_held._zone")).where(~line).drop("_zone_line", "_zone", "_held", "_part")


def assigned(rows: DataFrame) -> DataFrame:
    """rows with fight: its number within session, zone stretch and enemy.  A death that meets no open fight has none."""
    keys = ["session_id", "npc", "zone_change"]
    w = Window.partitionBy(*keys).orderBy("line_no")
    gap = F.col("s") - F.lag("s").over(w)
    barrier = F.coalesce(F.lag("ends").over(w), F.lit(False))
    cut = rows.withColumn("_gap", gap).withColumn("_barrier", barrier)
    cut = cut.withColumn("_piece", F.sum(F.when(F.col("_gap").isNull() | F.col("_barrier") | (F.col("_gap") > IDLE), 1).otherwise(0)).over(w))
    piece = Window.partitionBy(*keys, "_piece")
    cut = cut.withColumn("_hurt", F.max(F.col("damaging").cast("int")).over(piece))
    head = F.col("_piece") != F.lag("_piece").over(w)
    new = F.col("_gap").isNull() | (head & (F.col("_barrier") | (F.col("_gap") > IDLE_UNDAMAGED) | (F.lag("_hurt").over(w) == 1)))
    numbered = cut.withColumn("fight", F.sum(F.when(new, 1).otherwise(0)).over(w))
    begins = Window.partitionBy(*keys, "fight").orderBy("line_no")
    return numbered.withColumn("_opened", ~F.first("ends").over(begins)).where("_opened").drop("_gap", "_barrier", "_piece", "_hurt", "_opened")


def fights(rows: DataFrame, players: DataFrame, pet_map: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row for each fight, without those whose enemy turned out to be a player or a pet.

    A fight is closed by its enemy's death, a later zone line or idle time up to the session's last event (events; without
    them, up to the last fight's).
    """
    keys = ["session_id", "zone_change", "npc", "fight"]
    damage = F.col("damaging")
    found = rows.groupBy(*keys).agg(
        F.first("zone").alias("zone"), F.min("line_no").alias("first_line"), F.min("s").alias("begin"),
        F.max(F.when(damage | F.col("ends"), F.col("s"))).alias("last_damage"), F.max("s").alias("last_activity"),
        F.max("ends").alias("dead"), F.max(damage).alias("has_damage"),
        F.sum(F.when(damage & F.col("dealt"), F.col("amount")).otherwise(0)).alias("damage_total"),
        F.sum(F.when(damage & ~F.col("dealt"), F.col("amount")).otherwise(0)).alias("tanking_total"),
        F.count(F.when(~damage & ~F.col("ends"), 1)).alias("taunts"),
    )
    real = found.join(players.select("session_id", F.col("name").alias("npc")), ["session_id", "npc"], "left_anti").join(identity.pets_as(pet_map, "npc", "_pet"), identity.by_pet(pet_map, "npc"), "left_anti")
    if events is None:
        ends = found.groupBy("session_id").agg(F.max("last_activity").alias("_end"), F.max("zone_change").alias("_zones"))
    else:
        ends = events.groupBy("session_id").agg(F.max("s").alias("_end"), F.count(F.when(F.col("kind") == "Zone", 1)).alias("_zones"))
    idle = F.col("_end") - F.col("last_activity")
    closed = F.col("dead") | (F.col("_zones") > F.col("zone_change")) | (idle > IDLE_UNDAMAGED) | (F.col("has_damage") & (idle > IDLE))
    real = real.join(ends, "session_id")
    listed = segments.numbered(real.withColumn("closed", closed), ["session_id"], ["first_line", "npc"])
    return listed.withColumn("id", F.col("id").cast("int")).withColumnRenamed("npc", "name").drop("_end", "_zones")


def actor_totals(rows: DataFrame) -> DataFrame:
    """Total and hits of each actor in each fight; a row of amount 0 is a hit too."""
    return rows.where("damaging").groupBy("session_id", "zone_change", "npc", "fight", "dealt", "actor").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("hits"))


def pull_groups(found: DataFrame) -> DataFrame:
    """fights with chain: pulls less than 120 s apart belong together."""
    return segments.long_chains(found, ["session_id"], ["begin", "id"], begin="begin", end="last_damage")


def fight_info(found: DataFrame, rows: DataFrame, owner: str, pet_map: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """fights as lists show them: with group (the pull chain, from 0), difficulty and tier of an instanced zone, the mob's
    estimated health there, and own_damage, what the log's owner and their pets dealt.

    health: (mob_key, zone_key, difficulty, health).
    """
    from ..functions.grammar import instance_zone

    grouped = pull_groups(found).withColumn("group", (F.col("chain") - 1).cast("int")).drop("chain")
    zone = instance_zone(F.col("zone"))
    placed = grouped.withColumn("_z", zone).withColumn("zone_base", F.col("_z.base")).withColumn("difficulty", F.col("_z.difficulty")).withColumn("tier", F.col("_z.tier")).drop("_z")
    keys = ["session_id", "zone_change", "npc", "fight"]
    own = F.lower("actor") == owner.lower()
    pets = identity.pets_as(pet_map.where(F.lower("owner") == owner.lower()), "actor", "_mine")
    mine = rows.where("damaging and dealt").join(pets, identity.by_pet(pet_map, "actor"), "left").where(own | F.col("_mine"))
    dealt = mine.groupBy(*keys).agg(F.sum("amount").alias("own_damage")).withColumnRenamed("npc", "name")
    out = placed.join(dealt, ["session_id", "zone_change", "name", "fight"], "left").withColumn("own_damage", F.coalesce("own_damage", F.lit(0)))
    if health is None:
        return out.withColumn("health", F.lit(None).cast("long"))
    known = health.select(F.col("mob_key").alias("_m"), F.col("zone_key").alias("_k"), F.col("difficulty").alias("_d"), F.col("health").cast("long").alias("health"))
    return out.join(known, (F.lower("name") == F.col("_m")) & (F.lower("zone_base") == F.col("_k")) & F.col("difficulty").eqNullSafe(F.col("_d")), "left").drop("_m", "_k", "_d")
