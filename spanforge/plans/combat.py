"""Registered queries over a combat log that is made of the events table: grammars, identity, fights and the compiler.

Roles: line = event_id, minute of the month = second of the log (so that fights have many hits), user_id % 40 = raider
(Raider0 owns the log), k % 10 = enemy.  `typed_log` has the events as the parser would give them, LOG is the same in SQL.
The text of `log_text` is parsed back by `log_line_parse`.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar
from ..functions.schema import FIELDS, MODIFIERS
from ..functions.timeutil import moment, seconds
from ..operators import feeds, fights, identity, intervals, learned, metrics, present, segments, timeline
from ..sources import tail
from ..streaming import engagements, live
from .cache import Store, cached
from .catalog import E, ORACLES, events, query, r6
from .query import Filter, QuerySpec, Scope, World, canned, compile_query, live_meter, sided, stance_spans

START = 1704067200
OWNER = "Raider0"
RAIDERS, PETS = 40, 5
#: Modifiers of the hits whose k has this rest by this divisor.
RARE = ((11, 0, "Assassinate"), (7, 3, "Headshot"), (13, 0, "FinishingBlow"), (17, 0, "SlayUndead"), (5, 2, "Strikethrough"), (8, 5, "DoubleBowShot"))

#: The typed log in SQL; every query below begins with it.
LOG = f"""WITH {E}, log AS (SELECT event_id AS line, {START} + (s - {START}) // 60 AS s, event_type AS t, k, cents, 'Raider' || (user_id % {RAIDERS}) AS raider,
    CASE WHEN event_type = 'click' AND k % 7 = 0 THEN 'Rex' || (user_id % {PETS}) ELSE 'Raider' || (user_id % {RAIDERS}) END AS hitter, 'A gnoll' || (k % 10) AS gnoll, 'Rex' || (user_id % {PETS}) AS pet, user_id % {PETS} AS pet_no FROM e),
  ev AS (SELECT line, s, k,
    CASE t WHEN 'click' THEN 'Damage' WHEN 'purchase' THEN CASE WHEN k < 90 THEN 'Damage' ELSE 'Death' END WHEN 'view' THEN CASE WHEN k < 60 THEN 'Heal' WHEN k < 80 THEN 'Cast' WHEN k < 90 THEN 'Loot' WHEN k < 95 THEN 'WearOff' ELSE 'Landed' END
      WHEN 'error' THEN CASE WHEN k < 80 THEN 'Damage' WHEN k < 90 THEN 'Stance' WHEN k < 94 THEN 'Taunt' WHEN k < 96 THEN 'Ability' WHEN k < 97 THEN 'Resist' ELSE 'Chat' END
      ELSE CASE WHEN k < 40 THEN 'Experience' WHEN k < 70 THEN 'Faction' WHEN k < 86 THEN 'Consider' WHEN k < 90 THEN 'Level' ELSE 'Zone' END END AS kind,
    CASE t WHEN 'click' THEN hitter WHEN 'purchase' THEN raider WHEN 'view' THEN CASE WHEN k < 90 THEN raider END WHEN 'error' THEN CASE WHEN k < 80 THEN gnoll WHEN k BETWEEN 90 AND 95 OR k >= 98 THEN raider WHEN k = 97 THEN pet ELSE '{OWNER}' END ELSE '{OWNER}' END AS actor,
    CASE t WHEN 'click' THEN gnoll WHEN 'purchase' THEN gnoll WHEN 'view' THEN CASE WHEN k < 60 OR k >= 90 THEN raider WHEN k >= 80 THEN gnoll END WHEN 'error' THEN CASE WHEN k < 80 THEN raider WHEN k BETWEEN 90 AND 93 OR k = 96 THEN gnoll END ELSE CASE WHEN k BETWEEN 70 AND 85 THEN gnoll END END AS target,
    CASE WHEN t = 'error' AND k = 97 THEN 'My leader is Raider' || pet_no END AS said, CASE WHEN t = 'view' AND k >= 60 OR t = 'error' AND k = 96 THEN 'Mend' END AS spell,
    CASE t WHEN 'click' THEN CASE WHEN k < 95 THEN 'Melee' ELSE 'Miss' END WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'DirectDamage' WHEN k < 75 THEN 'DamageOverTime' WHEN k < 90 THEN 'DamageShield' END
      WHEN 'error' THEN CASE WHEN k < 40 THEN 'Melee' WHEN k < 60 THEN 'Miss' WHEN k < 64 THEN 'Parry' WHEN k < 68 THEN 'Block' WHEN k < 72 THEN 'Absorb' WHEN k < 76 THEN 'Invulnerable' WHEN k < 80 THEN 'Dodge' END END AS dk,
    CASE t WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'Slashes' WHEN 1 THEN 'Kicks' ELSE 'Shoots' END WHEN 'purchase' THEN CASE WHEN k < 75 THEN CASE k % 2 WHEN 0 THEN 'Blaze' ELSE 'Frost' END END WHEN 'error' THEN CASE WHEN k < 80 THEN 'Bites' END END AS sub,
    CASE WHEN t = 'click' AND k >= 95 OR t = 'error' AND k BETWEEN 40 AND 79 THEN 0 ELSE cents END AS amount, cents + k AS potential,
    (k & 127) + CASE WHEN k % 11 = 0 THEN 512 ELSE 0 END + CASE WHEN k % 7 = 3 THEN 1024 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 2048 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 4096 ELSE 0 END
      + CASE WHEN k % 5 = 2 THEN 128 ELSE 0 END + CASE WHEN k % 8 = 5 THEN 256 ELSE 0 END AS mods,
    CASE WHEN t = 'purchase' AND k < 75 THEN CASE k % 3 WHEN 0 THEN 'fire' WHEN 1 THEN 'bane' END END AS school, k % 2 = 0 AS even,
    CASE k % 3 WHEN 0 THEN 'Begin' WHEN 1 THEN 'Interrupted' ELSE 'Fizzle' END AS ck, CASE k % 3 WHEN 0 THEN 'bold' WHEN 1 THEN 'calm' ELSE 'wild' END AS stance,
    k / 10.0 AS pct, k % 5 = 0 AS aa, k - 55 AS delta, k % 10 = 0 AS capped, 'Fen' || (k % 2) AS faction, 'Fang' || (k % 3) AS item, k % 4 + 1 AS qty, k * 10 AS copper FROM log)"""


def typed_log(spark: SparkSession, d: str) -> DataFrame:
    """The event rows of one session, with s."""
    return typed(events(spark, d))


def typed(e: DataFrame) -> DataFrame:
    """Events by roles, in a table or a stream, as event rows."""
    k, t = F.col("k"), F.col("event_type")
    raider, gnoll = F.concat(F.lit("Raider"), (F.col("user_id") % RAIDERS).cast("string")), F.concat(F.lit("A gnoll"), (k % 10).cast("string"))
    hitter = F.when((t == "click") & (k % 7 == 0), F.concat(F.lit("Rex"), (F.col("user_id") % PETS).cast("string"))).otherwise(raider)
    kind = (
        F.when(t == "click", "Damage").when(t == "purchase", F.when(k < 90, "Damage").otherwise("Death")).when(t == "view", F.when(k < 60, "Heal").when(k < 80, "Cast").when(k < 90, "Loot").when(k < 95, "WearOff").otherwise("Landed"))
        .when(t == "error", F.when(k < 80, "Damage").when(k < 90, "Stance").when(k < 94, "Taunt").when(k < 96, "Ability").when(k < 97, "Resist").otherwise("Chat"))
        .otherwise(F.when(k < 40, "Experience").when(k < 70, "Faction").when(k < 86, "Consider").when(k < 90, "Level").otherwise("Zone"))
    )
    one = e.select(F.lit("log").alias("session_id"), F.col("event_id").alias("line_no"), (START + F.floor((F.col("s") - START) / 60)).alias("s"), kind.alias("kind"), t.alias("t"), "k", "cents", raider.alias("raider"), hitter.alias("hitter"), gnoll.alias("gnoll"), (F.col("user_id") % PETS).cast("string").alias("pet_no"))
    kind, t, amount, harm = F.col("kind"), F.col("t"), F.col("cents"), F.col("kind") == "Damage"
    missed = ((t == "click") & (k >= 95)) | ((t == "error") & k.between(40, 79))
    third = lambda *names: F.when(k % 3 == 0, names[0]).when(k % 3 == 1, names[1]).otherwise(F.lit(names[2]))
    at = lambda name, value: F.when(kind == name, value)
    values = {
        "actor": F.when(t == "click", F.col("hitter")).when((t == "purchase") | kind.isin("Heal", "Cast", "Loot", "Taunt", "Ability"), F.col("raider")).when((t == "error") & (k < 80), F.col("gnoll"))
        .when(kind == "Chat", F.when(k == 97, F.concat(F.lit("Rex"), F.col("pet_no"))).otherwise(F.col("raider"))).when(~kind.isin("Faction", "Zone", "WearOff", "Landed", "Level"), OWNER),
        "target": F.when(t.isin("click", "purchase") | kind.isin("Consider", "Taunt", "Resist"), F.col("gnoll")).when((t == "error") & (k < 80) | kind.isin("Heal", "WearOff", "Landed"), F.col("raider")),
        "text": at("Chat", F.when(k == 97, F.concat(F.lit("My leader is Raider"), F.col("pet_no"))).otherwise("selling Fang1 and fang0")), "channel": at("Chat", F.when(k == 97, "say").otherwise("group")), "ability": at("Ability", F.lit("Rest")), "success": at("Taunt", k % 2 == 0),
        "amount": F.when(missed, 0).when(kind.isin("Damage", "Heal"), amount), "potential": at("Heal", amount + k),
        "damage_kind": F.when(harm, F.when(t == "purchase", F.when(k < 50, "DirectDamage").when(k < 75, "DamageOverTime").otherwise("DamageShield")).when(~missed, "Melee").when((t == "click") | (k < 60), "Miss").when(k < 64, "Parry").when(k < 68, "Block").when(k < 72, "Absorb").when(k < 76, "Invulnerable").otherwise("Dodge")),
        "sub_type": F.when(t == "click", third("Slashes", "Kicks", "Shoots")).when(harm & (t == "purchase"), F.when(k < 75, F.when(k % 2 == 0, "Blaze").otherwise("Frost"))).when(harm, "Bites"),
        "school": F.when(harm & (t == "purchase") & (k < 75), third("fire", "bane", None)),
        "modifiers": F.when(kind.isin("Damage", "Heal"), k.bitwiseAND(F.lit(127)) + sum(F.when(k % n == rest, MODIFIERS[m]).otherwise(0) for n, rest, m in RARE)), "is_spell": F.when(harm, F.lit(False)), "spell": F.when(kind.isin("Heal", "Cast", "WearOff", "Landed", "Resist"), "Mend"), "over_time": at("Heal", k % 2 == 0),
        "cast_kind": at("Cast", third("Begin", "Interrupted", "Fizzle")), "stance": at("Stance", third("bold", "calm", "wild")), "zone": at("Zone", F.concat(F.lit("Fen"), (k % 3).cast("string"))), "welcome": at("Zone", k >= 98),
        "level": F.when(kind == "Consider", k).when(kind == "Level", k - 60), "attitude": at("Consider", F.lit("dubious")), "percent": at("Experience", k / 10.0), "party": at("Experience", k % 2 == 0), "aa_point": at("Experience", k % 5 == 0),
        "faction": at("Faction", F.concat(F.lit("Fen"), (k % 2).cast("string"))), "delta": at("Faction", k - 55), "better": at("Faction", k >= 55), "capped": at("Faction", k % 10 == 0),
        "item": at("Loot", F.concat(F.lit("Fang"), (k % 3).cast("string"))), "source": at("Loot", F.col("gnoll")), "quantity": at("Loot", k % 4 + 1), "copper": at("Loot", k * 10),
    }
    typed = one.select("session_id", "line_no", "s", "kind", *[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS.items()])
    return typed.withColumn("ts", moment(F.col("s")))


def names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def evidence(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Players and pets: the log has no chat that names them."""
    players = spark.createDataFrame([("log", x, 0) for x in names("Raider", RAIDERS)], "session_id string, name string, first_line long")
    return players, spark.createDataFrame([(f"Rex{i}", f"Raider{i}") for i in range(PETS)], "pet string, owner string")


def fought(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, rows of fights, fights, sided events)."""
    log = records(spark, d)
    players, pets = evidence(spark)
    both = identity.with_sides(log, players, identity.known_npcs(log, players, pets), pets)
    rows = fights.assigned(fights.with_zone(fights.engaged(both), log))
    return log, rows, fights.fights(rows, players, pets, log), both


def records(spark: SparkSession, d: str) -> DataFrame:
    """The session's records, kept until the events change."""
    store = Store(spark)
    return store.table(f"records {d}", store.version_of(f"{d}/events.parquet"), lambda: typed_log(spark, d))


def world(spark: SparkSession, d: str) -> World:
    """The session that the queries ask; its fights are kept like its records, from the first query on that needs them."""
    store = Store(spark)
    version = store.version_of(f"{d}/events.parquet")
    log = records(spark, d)
    players, pets = evidence(spark)

    def found() -> DataFrame:
        both = identity.with_sides(log, players, identity.known_npcs(log, players, pets), pets)
        rows = fights.assigned(fights.with_zone(fights.engaged(both), log))
        return fights.fights(rows, players, pets, log).select("id", "name", "begin", "last_damage", "last_activity", "closed")

    npcs = spark.createDataFrame([(x,) for x in names("A gnoll", 10)], "name string")
    return World(log, lambda: store.table(f"fights {d}", version, found), pets, npcs, players.select("name"), OWNER)


FIGHTS = """, zones AS (SELECT line FROM ev WHERE kind = 'Zone'),
  m AS (SELECT line, s, CASE WHEN kind IN ('Death', 'Taunt') OR actor NOT LIKE 'A gnoll%' THEN target ELSE actor END AS npc, kind = 'Damage' AS damaging, kind = 'Death' AS ends, kind = 'Damage' AND actor NOT LIKE 'A gnoll%' AS dealt, actor, target, amount,
    (SELECT count(*) FROM zones z WHERE z.line <= ev.line) AS z FROM ev WHERE kind IN ('Damage', 'Death', 'Taunt')),
  g AS (SELECT *, s - lag(s) OVER w AS gap, lag(ends) OVER w AS stop FROM m WINDOW w AS (PARTITION BY npc, z ORDER BY line)),
  pieces AS (SELECT *, sum(CASE WHEN gap IS NULL OR stop OR gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY npc, z ORDER BY line ROWS UNBOUNDED PRECEDING) AS piece FROM g),
  hurt AS (SELECT *, bool_or(damaging) OVER (PARTITION BY npc, z, piece) AS hurt FROM pieces),
  was AS (SELECT *, lag(hurt) OVER (PARTITION BY npc, z ORDER BY line) AS was_hurt FROM hurt),
  i AS (SELECT *, sum(CASE WHEN gap IS NULL OR stop OR gap > 60 OR gap > 30 AND was_hurt THEN 1 ELSE 0 END) OVER (PARTITION BY npc, z ORDER BY line ROWS UNBOUNDED PRECEDING) AS f FROM was),
  fo AS (SELECT npc, z, f, min(line) AS first_line, min(s) AS b, max(s) AS last_activity, max(s) FILTER (damaging OR ends) AS last_damage, bool_or(damaging) AS has_damage, bool_or(ends) AS dead, arg_min(ends, line) AS opened_by_death,
    count(*) FILTER (NOT damaging AND NOT ends) AS taunts, sum(CASE WHEN damaging AND dealt THEN amount ELSE 0 END) AS damage_total, sum(CASE WHEN damaging AND NOT dealt THEN amount ELSE 0 END) AS tanking_total FROM i GROUP BY npc, z, f),
  fights AS (SELECT *, greatest(b, coalesce(last_damage, b)) AS e, row_number() OVER (ORDER BY first_line) AS id,
    dead OR (SELECT count(*) FROM zones) > z OR (SELECT max(s) FROM ev) - last_activity > 60 OR has_damage AND (SELECT max(s) FROM ev) - last_activity > 30 AS closed FROM fo WHERE NOT opened_by_death)"""


@query(f"""{LOG}{FIGHTS} SELECT CAST(id AS INTEGER) AS id, npc AS name, CAST(z AS BIGINT) AS zone_change, (SELECT 'Fen' || (arg_max(k, line) % 3) FROM ev WHERE kind = 'Zone' AND ev.line < fights.first_line) AS zone,
  CAST(b AS BIGINT) AS "begin", CAST(last_damage AS BIGINT) AS last_damage, CAST(last_activity AS BIGINT) AS last_activity, dead, closed, has_damage, taunts, CAST(damage_total AS BIGINT) AS damage_total, CAST(tanking_total AS BIGINT) AS tanking_total FROM fights""")
def fight_list(spark, d):
    return fought(spark, d)[2].select("id", "name", F.col("zone_change").cast("long").alias("zone_change"), "zone", "begin", "last_damage", "last_activity", "dead", "closed", "has_damage", "taunts", "damage_total", "tanking_total")


#: The events come to the stream in so many pieces, of so many files each.
PIECES, FILES = 4, 2


@query(f"""{LOG}{FIGHTS} SELECT first_line, npc AS name, CAST(z AS BIGINT) AS zone_change, (SELECT 'Fen' || (arg_max(k, line) % 3) FROM ev WHERE kind = 'Zone' AND ev.line < fights.first_line) AS zone,
  CAST(b AS BIGINT) AS "begin", CAST(last_damage AS BIGINT) AS last_damage, CAST(last_activity AS BIGINT) AS last_activity, dead, closed, has_damage, taunts, CAST(damage_total AS BIGINT) AS damage_total, CAST(tanking_total AS BIGINT) AS tanking_total FROM fights""")
def stream_fights(spark, d):
    """The fight list by the stateful stream, which gets the log piece by piece and carries open fights over."""
    e = events(spark, d)
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    folder = live.folder_of(spark, "pieces")
    piece = F.floor((F.col("event_id") - F.lit(low or 0)) * PIECES / F.lit((high or 0) - (low or 0) + 1))
    for i in range(PIECES):
        e.where(piece == i).repartition(FILES).write.mode("append").parquet(folder)
    players, pets = evidence(spark)
    both = identity.with_sides(typed(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES).parquet(folder)), players, identity.known_npcs(typed(e), players, pets), pets)
    found = engagements.newest(live.stored(engagements.updates(both, None), "fights"))
    return found.select("first_line", "name", "zone_change", "zone", "begin", "last_damage", "last_activity", "dead", "closed", "has_damage", "taunts", "damage_total", "tanking_total")


@query(f"""{LOG}{FIGHTS}, o AS (SELECT id, b AS begin, CASE WHEN b - max(last_damage) OVER (ORDER BY b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 120 THEN 0 ELSE 1 END AS new FROM fights)
  SELECT CAST(id AS INTEGER) AS id, CAST(sum(new) OVER (ORDER BY begin, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM o""")
def fight_chains(spark, d):
    return fights.pull_groups(fought(spark, d)[2]).select("id", F.col("chain").cast("long").alias("chain"))


@query(f"""{LOG}{FIGHTS}, kept AS (SELECT i.* FROM i JOIN fights USING (npc, z, f) WHERE damaging)
  SELECT npc, dealt, CASE WHEN dealt THEN actor ELSE target END AS actor, CAST(sum(amount) AS BIGINT) AS total, count(*) AS hits FROM kept GROUP BY ALL""")
def fight_actor_totals(spark, d):
    return fights.actor_totals(fought(spark, d)[1]).groupBy("npc", "dealt", "actor").agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))


@query(f"""{LOG}{FIGHTS} SELECT lower(npc) AS mob_key, CAST(count(*) AS BIGINT) AS kills, CAST(sum(damage_total) AS BIGINT) AS damage, CAST(max(last_damage) AS BIGINT) AS newest FROM fights
  WHERE dead AND damage_total > 0 AND z > 0 GROUP BY 1""")
def kill_harvest(spark, d):
    found = fought(spark, d)[2].withColumn("difficulty", F.lit(None).cast("int"))
    return learned.harvest_kills(found).groupBy("mob_key").agg(F.count(F.lit(1)).alias("kills"), F.sum("damage").alias("damage"), F.max("killed_at").alias("newest"))


_HITS = """, h AS (SELECT actor AS mob, CASE WHEN k % 2 = 0 THEN 50 END AS level, sub AS skill, dk, dk IN ('DirectDamage', 'DamageOverTime', 'DamageShield') AS spell, CASE WHEN dk IN ('Melee', 'DirectDamage', 'DamageOverTime', 'DamageShield') AND amount > 0 THEN amount END AS hit FROM ev WHERE kind = 'Damage'),
  b AS (SELECT *, least(greatest(floor(log2(hit) * 4), 0), 79) AS bucket FROM h),
  t AS (SELECT mob, level, count(*) FILTER (NOT spell) AS swings, count(hit) FILTER (NOT spell) AS landed, coalesce(sum(hit) FILTER (NOT spell), 0) AS total, coalesce(max(hit) FILTER (NOT spell), 0) AS max_hit,
    coalesce(min(hit) FILTER (NOT spell), 0) AS min_hit, count(*) FILTER (dk = 'Miss') AS misses, count(*) FILTER (dk = 'Dodge') AS dodges, coalesce(sum(hit), 0) AS all_total, coalesce(sum(hit) FILTER (spell), 0) AS spell_total FROM b GROUP BY ALL),
  ranks AS (SELECT mob, level, bucket, row_number() OVER (PARTITION BY mob, level ORDER BY bucket) AS nth, count(*) OVER (PARTITION BY mob, level) AS n FROM b WHERE NOT spell AND hit IS NOT NULL),
  qs AS (SELECT mob, level, min(bucket) FILTER (nth >= ceil(CAST(0.1 AS DOUBLE) * n)) AS q1, min(bucket) FILTER (nth >= ceil(CAST(0.5 AS DOUBLE) * n)) AS q5, min(bucket) FILTER (nth >= ceil(CAST(0.9 AS DOUBLE) * n)) AS q9 FROM ranks GROUP BY ALL)"""


def _value(q: str) -> str:
    return f"coalesce(CAST(round(pow(2.0, ({q} + 0.5) / 4)) AS BIGINT), 0)"


@query(f"""{LOG}{_HITS} SELECT t.mob, CAST(t.level AS INTEGER) AS level, swings, landed, CAST(total AS BIGINT) AS total, CAST(max_hit AS BIGINT) AS max_hit, CAST(min_hit AS BIGINT) AS min_hit, CAST(all_total AS BIGINT) AS all_total,
  CAST(spell_total AS BIGINT) AS spell_total, {_value("q1")} AS p10, {_value("q5")} AS median, {_value("q9")} AS p90, round(CASE WHEN swings > 0 THEN 100.0::DOUBLE * landed / swings ELSE 0 END, 6) AS hit_rate,
  round(CASE WHEN swings > 0 THEN 100.0::DOUBLE * misses / swings ELSE 0 END, 6) AS miss_rate, round(CASE WHEN swings > 0 THEN 100.0::DOUBLE * dodges / swings ELSE 0 END, 6) AS dodge_rate,
  CASE WHEN landed >= 200 AND t.level IS NOT NULL THEN 'High' WHEN landed >= 40 THEN 'Medium' ELSE 'Low' END AS grade FROM t LEFT JOIN qs ON t.mob = qs.mob AND t.level IS NOT DISTINCT FROM qs.level""")
def attack_estimates(spark, d):
    hits = typed_log(spark, d).where("kind = 'Damage'").select(F.col("actor").alias("mob"), F.when(F.col("modifiers") % 2 == 0, 50).alias("level"), "line_no", "damage_kind", "sub_type", "amount")
    keys = ["mob", "level"]
    # two harvests, merged
    halves = [learned.attack_tallies(hits.where(F.col("line_no") % 2 == i), keys) for i in (0, 1)]
    found = learned.attack_estimates(learned.merge_tallies(halves[0].unionByName(halves[1]), keys), keys, "level")
    rates = [F.round(c, 6).alias(c) for c in ("hit_rate", "miss_rate", "dodge_rate")]
    return found.select(*keys, "swings", "landed", "total", "max_hit", "min_hit", "all_total", "spell_total", "p10", "median", "p90", *rates, "grade")


_RAIDS = """, own AS (SELECT *, (SELECT 'fen' || (arg_max(k, line) % 3) FROM ev WHERE kind = 'Zone' AND ev.line < fights.first_line) AS zone FROM fights WHERE closed AND z > 0 AND last_damage IS NOT NULL),
  raw AS (SELECT lower(actor) AS mob, own.zone, own.b AS stamp, own.id, target, line, sub AS skill, dk, CASE WHEN dk = 'Melee' AND amount > 0 THEN amount END AS hit FROM ev JOIN own ON actor = npc AND ev.s BETWEEN own.b AND own.last_damage WHERE kind = 'Damage' AND actor LIKE 'A gnoll%'),
  smp AS (SELECT mob, zone, stamp, id, target, min(line) AS first_line FROM raw GROUP BY ALL), one AS (SELECT * FROM smp QUALIFY row_number() OVER (PARTITION BY mob, zone, stamp ORDER BY id, first_line) = 1),
  b AS (SELECT raw.*, least(greatest(floor(log2(hit) * 4), 0), 79) AS bucket FROM raw JOIN one USING (mob, zone, stamp, id, target)),
  t AS (SELECT mob, zone, count(DISTINCT stamp) AS starts, count(*) AS swings, count(hit) AS landed, coalesce(sum(hit), 0) AS total, coalesce(max(hit), 0) AS max_hit, coalesce(min(hit), 0) AS min_hit, count(*) FILTER (dk = 'Miss') AS misses, count(*) FILTER (dk = 'Parry') AS parries FROM b GROUP BY ALL),
  ranks AS (SELECT mob, zone, bucket, row_number() OVER (PARTITION BY mob, zone ORDER BY bucket) AS nth, count(*) OVER (PARTITION BY mob, zone) AS n FROM b WHERE hit IS NOT NULL),
  qs AS (SELECT mob, zone, min(bucket) FILTER (nth >= ceil(CAST(0.5 AS DOUBLE) * n)) AS q5, min(bucket) FILTER (nth >= ceil(CAST(0.9 AS DOUBLE) * n)) AS q9 FROM ranks GROUP BY ALL)"""


@query(f"""{LOG}{FIGHTS}{_RAIDS} SELECT mob AS mob_key, zone AS zone_key, CAST(least(starts, 500) AS INTEGER) AS starts, swings, landed, CAST(total AS BIGINT) AS total, CAST(max_hit AS BIGINT) AS max_hit, CAST(min_hit AS BIGINT) AS min_hit, {_value("q5")} AS median, {_value("q9")} AS p90,
  round(CASE WHEN swings > 0 THEN 100.0::DOUBLE * misses / swings ELSE 0 END, 6) AS miss_rate, round(CASE WHEN swings > 0 THEN 100.0::DOUBLE * parries / swings ELSE 0 END, 6) AS parry_rate, CASE WHEN landed >= 40 THEN 'Medium' ELSE 'Low' END AS grade FROM t LEFT JOIN qs USING (mob, zone)""")
def attack_harvest(spark, d):
    """From closed fights to estimates: harvested, merged, and merged again, which changes nothing."""
    _, _, found, both = fought(spark, d)
    samples = segments.cut(learned.harvest_attacks(both, found, every=False))
    kept, tallies = (segments.cut(x) for x in learned.merge_attacks(samples))
    kept, tallies = learned.merge_attacks(samples, kept, tallies)
    key = list(learned.ATTACK_KEY)
    sizes = learned.attack_estimates(tallies, key, "defender_level").join(kept.select("mob_key", "zone_key", F.size("stamps").alias("starts")), ["mob_key", "zone_key"])
    rates = [F.round(c, 6).alias(c) for c in ("miss_rate", "parry_rate")]
    return sizes.select("mob_key", "zone_key", "starts", "swings", "landed", "total", "max_hit", "min_hit", "median", "p90", *rates, "grade")


@query(f"""{LOG}, leaders AS (SELECT line, actor AS pet, regexp_extract(said, '^My leader is (.*)$', 1) AS owner FROM ev WHERE said LIKE 'My leader is %'),
  known AS (SELECT name, min(line) AS first_line FROM (SELECT actor AS name, line FROM ev WHERE kind = 'Chat' AND said IS NULL UNION ALL SELECT owner, line FROM leaders) GROUP BY name),
  pets AS (SELECT pet, arg_max(owner, line) AS owner FROM leaders GROUP BY pet)
  SELECT line, actor LIKE 'A gnoll%' AS actor_npc, target LIKE 'A gnoll%' AS target_npc, coalesce(a.first_line <= line, false) OR actor IN (SELECT pet FROM pets) AS actor_player, coalesce(t.first_line <= line, false) OR target IN (SELECT pet FROM pets) AS target_player,
    (SELECT owner FROM pets WHERE pet = actor) AS owner FROM ev LEFT JOIN known a ON a.name = actor LEFT JOIN known t ON t.name = target WHERE kind = 'Damage'""")
def identity_sides(spark, d):
    """Sides as the log itself proves them: players by chat, pets and owners by what pets say, each from its line on."""
    log = records(spark, d)
    players, pets = identity.verified(log), identity.session_pets(log)
    both = identity.with_sides(log, players, identity.known_npcs(log, players, pets), pets).where("kind = 'Damage'")
    owners = both.join(pets.select("session_id", F.col("pet").alias("actor"), F.col("owner")), ["session_id", "actor"], "left")
    return owners.select(F.col("line_no").alias("line"), "actor_npc", "target_npc", "actor_player", "target_player", "owner")


# --- the query description, compiled --------------------------------------------------------------------------------

MERGE = """SELECT min(b) AS b, max(e) AS e FROM (SELECT *, sum(new) OVER (ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, CASE WHEN b > max(e) OVER (ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM {0})) GROUP BY i"""
PRESENCE = """, pg AS (SELECT *, s - lag(s) OVER (ORDER BY s, line) AS gap FROM ev), ps AS (SELECT s, sum(CASE WHEN gap IS NULL OR gap >= 600 OR kind = 'Zone' AND k >= 98 THEN 1 ELSE 0 END) OVER (ORDER BY s, line) AS n FROM pg),
  presence AS (SELECT min(s) AS b, max(s) AS e FROM ps GROUP BY n)"""
DEALT = """, r AS (SELECT ev.*, id AS unit, actor AS who, coalesce('Raider' || regexp_extract(actor, '^Rex(.*)$', 1), actor) AS owner FROM ev JOIN units ON target = name AND s BETWEEN b AND e WHERE kind = 'Damage')"""
FIGHT_UNITS = ", units AS (SELECT id, npc AS name, b, e FROM fights)"
MERGED_UNITS = f", fu AS (SELECT b, e FROM fights), units AS (SELECT row_number() OVER (ORDER BY b) AS id, b, e FROM ({MERGE.format('fu')}))"
PRESENCE_UNITS = f"{PRESENCE}, units AS (SELECT row_number() OVER (ORDER BY b) AS id, b, e FROM ({MERGE.format('presence')}))"

_LANDED = "(kind = 'Heal' OR kind = 'Damage' AND dk IN ('Melee', 'DirectDamage', 'DamageOverTime', 'DamageShield'))"
_TRY = "kind = 'Damage' AND dk IN ('Melee', 'Miss', 'Dodge', 'Parry', 'Block', 'Absorb', 'Invulnerable')"
_COUNTS = f"""coalesce(sum(amount) FILTER ({_LANDED}), 0) AS total, count(*) FILTER ({_LANDED}) AS hits, coalesce(max(amount) FILTER ({_LANDED}), 0) AS mx, coalesce(min(amount) FILTER ({_LANDED} AND amount > 0), 0) AS mn,
    count(*) FILTER ({_LANDED} AND mods & 1 <> 0) AS crits, count(*) FILTER ({_LANDED} AND mods & 2 <> 0) AS luckies, count(*) FILTER ({_LANDED} AND mods & 4 <> 0) AS twins,
    coalesce(sum(amount) FILTER ({_LANDED} AND mods & 1 <> 0), 0) AS crit_total, coalesce(sum(amount) FILTER ({_LANDED} AND mods & 2 <> 0), 0) AS lucky_total,
    count(*) FILTER (dk = 'DirectDamage' AND mods & 4 <> 0) AS twin_dd, count(*) FILTER (dk = 'DamageOverTime' AND mods & 4 <> 0) AS twin_dot, count(*) FILTER (dk IN ('DirectDamage', 'DamageOverTime')) AS spells, count(*) FILTER (dk = 'Melee') AS melee, count(*) FILTER ({_TRY}) AS tries,
    count(*) FILTER (dk = 'Miss') AS misses, count(*) FILTER (dk = 'Dodge') AS dodges, count(*) FILTER (dk = 'Parry') AS parries, count(*) FILTER (dk = 'Block') AS blocks, count(*) FILTER (dk = 'Absorb') AS absorbs, count(*) FILTER (dk = 'Invulnerable') AS unhurt,
    count(*) FILTER (dk = 'Melee' AND mods & 128 <> 0) AS strikes, count(*) FILTER (dk = 'Melee' AND mods & 256 <> 0) AS double_bows, count(*) FILTER (dk = 'Melee' AND sub = 'Shoots') AS bows, count(*) FILTER (dk = 'Melee' AND sub IN ('Slashes', 'Bites')) AS regular,
    count(*) FILTER (dk = 'Melee' AND mods & 8 <> 0) AS flurries, count(*) FILTER (dk = 'Melee' AND mods & 48 <> 0) AS rampages, count(*) FILTER (dk = 'Melee' AND mods & 64 <> 0) AS ripostes,
    coalesce(sum(potential - amount) FILTER (kind = 'Heal'), 0) AS extra, coalesce(max(potential) FILTER (kind = 'Heal'), 0) AS mxp, count(*) FILTER (kind = 'Heal' AND even) AS hots,
    count(*) FILTER (kind = 'Death') AS deaths, count(*) FILTER (kind = 'Cast' AND ck = 'Begin') AS casts, count(*) FILTER (kind = 'Cast' AND ck = 'Interrupted') AS breaks, count(*) FILTER (kind = 'Cast' AND ck = 'Fizzle') AS fizz,
    coalesce(sum(pct) FILTER (kind = 'Experience' AND NOT aa), 0) AS xp, count(*) FILTER (kind = 'Experience' AND NOT aa) AS gains, count(*) FILTER (kind = 'Experience' AND aa) AS aas,
    coalesce(sum(delta) FILTER (kind = 'Faction' AND NOT capped), 0) AS net, count(*) FILTER (kind = 'Faction' AND NOT capped AND delta >= 0) AS ups, count(*) FILTER (kind = 'Faction' AND NOT capped AND delta < 0) AS downs,
    count(*) FILTER (kind = 'Faction' AND capped) AS caps, coalesce(sum(qty) FILTER (kind = 'Loot'), 0) AS loots, coalesce(sum(copper) FILTER (kind = 'Loot'), 0) AS coin, count(*) FILTER (kind = 'Consider') AS cons, coalesce(max(k) FILTER (kind = 'Consider'), 0) AS con"""


def _per(over: str, under: str, scale: str = "1.0") -> str:
    return f"CASE WHEN {under} <> 0 THEN round({scale} * {over} / {under}, 6) ELSE 0.0 END"


def _whole(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


#: Metrics in SQL over the counters above, active (own seconds), raid (root's) and root_total.
SQL_METRICS = {
    "total": _whole("total"), "hits": _whole("hits"), "maxHit": _whole("mx"), "minHit": _whole("mn"), "critHits": _whole("crits"), "luckyHits": _whole("luckies"), "twincastHits": _whole("twins"), "activeSeconds": _whole("active"), "raidSeconds": _whole("raid"),
    "dps": _per("total", "active"), "sdps": _per("total", "raid"), "pdps": _per("(total + extra)", "active"), "avgHit": _per("total", "hits"), "avgCrit": _per("(crit_total - lucky_total)", "(crits - luckies)"), "avgLucky": _per("lucky_total", "luckies"),
    "critRate": _per("crits", "hits", "100.0"), "luckyRate": _per("luckies", "crits", "100.0"), "twincastRate": f"least(100.0, {_per('(2 * twin_dd + twin_dot)', 'spells', '100.0')})", "flurryRate": _per("flurries", "regular", "100.0"), "rampageRate": _per("rampages", "melee", "100.0"),
    "riposteRate": _per("ripostes", "melee", "100.0"), "meleeHitRate": _per("melee", "tries", "100.0"), "meleeAccuracy": _per("melee", "(tries - dodges - parries - blocks - absorbs - unhurt)", "100.0"), "undefendedRate": _per("(tries - misses - dodges - parries - blocks - absorbs - unhurt)", "tries", "100.0"), "percentOfTotal": _per("total", "root_total", "100.0"),
    "meleeAttempts": _whole("tries"), "misses": _whole("misses"), "dodges": _whole("dodges"), "parries": _whole("parries"), "blocks": _whole("blocks"), "absorbs": _whole("absorbs"), "invulnerable": _whole("unhurt"),
    "strikethroughRate": _per("strikes", "melee", "100.0"), "doubleBowRate": _per("double_bows", "bows", "100.0"), "extra": _whole("extra"), "potential": _whole("total + extra"), "maxPotentialHit": _whole("mxp"), "overhealRate": _per("extra", "(total + extra)", "100.0"), "hotHits": _whole("hots"),
    "deaths": _whole("deaths"), "casts": _whole("casts"), "interrupts": _whole("breaks"), "fizzles": _whole("fizz"), "xpPercent": "round(xp, 6)", "xpPerHour": _per("xp", "raid", "3600.0"), "xpGains": _whole("gains"), "aaPoints": _whole("aas"),
    "factionNet": _whole("net"), "factionUps": _whole("ups"), "factionDowns": _whole("downs"), "factionCapped": _whole("caps"), "loots": _whole("loots"), "platinum": "round(coin / 1000.0, 6)", "platPerHour": _per("coin", "raid", "3.6"), "considers": _whole("cons"), "conLevel": _whole("con"),
}


def tree_sql(rows: str, dims: list[str], names: list[str], levels: str | None = None) -> str:
    """The compiled tree: rows ends in a table r with unit, s and line; dims are expressions over it."""
    named = ", ".join(f"{x} AS d{i}" for i, x in enumerate(dims))
    parts = ["SELECT 0 AS level, '' AS parent, '' AS path, 'Total' AS label, rd.* FROM rd"]
    path = ""
    for i in range(len(dims)):
        parent, path = path or "''", f"{path} || '/' || d{i}" if path else f"d{i}"
        parts.append(f"SELECT {i + 1}, {parent}, {path}, d{i}, rd.* FROM rd")
    return f"""{rows}, rd AS (SELECT r.*{', ' if named else ''}{named} FROM r), lv AS ({levels or ' UNION ALL '.join(parts)}), un AS (SELECT path, unit, min(s) AS b, max(s) AS e FROM lv GROUP BY ALL),
  mk AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY path ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM un),
  isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM mk), act AS (SELECT path, sum(e - b + 1) AS active FROM (SELECT path, i, min(b) AS b, max(e) AS e FROM isl GROUP BY ALL) GROUP BY path),
  agg AS (SELECT level, parent, path, label, min(line) AS first_line, {_COUNTS} FROM lv GROUP BY ALL), root AS (SELECT active AS raid, total AS root_total FROM agg JOIN act USING (path) WHERE level = 0)
  SELECT CAST(level AS INTEGER) AS level, path, label, {', '.join(f'{SQL_METRICS[n]} AS "{n}"' for n in names)},
    CAST(row_number() OVER (PARTITION BY level, parent ORDER BY "{names[0]}" DESC, first_line) AS INTEGER) AS rank FROM agg JOIN act USING (path), root"""


def compiled(spark: SparkSession, d: str, spec: QuerySpec) -> DataFrame:
    return shown(compile_query(world(spark, d), spec).rows)


def shown(rows: DataFrame) -> DataFrame:
    value = lambda f: r6(F.col(f.name)) if f.dataType.simpleString() == "double" else F.col(f.name)
    return rows.select("level", F.array_join("path", "/").alias("path"), "label", *[value(f).alias(f.name) for f in rows.schema.fields if f.name not in ("level", "path", "label", "rank")], "rank")


#: The spell dimension of damage: the sub type or, without one, the outcome.
SUB = "coalesce(sub, 'damageShield')"
HITS = ["total", "hits", "maxHit", "minHit", "critHits", "luckyHits", "twincastHits", "activeSeconds", "raidSeconds", "dps", "sdps", "avgHit", "avgCrit", "avgLucky", "critRate", "luckyRate", "twincastRate", "flurryRate", "rampageRate", "riposteRate", "meleeHitRate", "meleeAccuracy", "undefendedRate", "percentOfTotal", "meleeAttempts", "misses", "dodges", "parries", "blocks", "absorbs", "invulnerable", "strikethroughRate", "doubleBowRate"]
HEALS = ["total", "extra", "potential", "maxPotentialHit", "overhealRate", "hotHits", "hits", "pdps", "dps"]


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + DEALT, ["who", SUB], HITS))
def query_damage(spark, d):
    return compiled(spark, d, QuerySpec("damage", groupBy=["player", "spell"], metrics=HITS, petRollup=False))


TAKEN = ", r AS (SELECT ev.*, id AS unit, target AS who FROM ev JOIN units ON actor = name AND s BETWEEN b AND e WHERE kind = 'Damage')"


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + TAKEN, ["who", "actor"], HITS))
def query_tanking(spark, d):
    return compiled(spark, d, QuerySpec("tanking", groupBy=["player", "target"], metrics=HITS, petRollup=False))


def _rows(kind: str, who: str) -> str:
    return f", r AS (SELECT ev.*, id AS unit, {who} AS who FROM ev JOIN units ON s BETWEEN b AND e WHERE kind = '{kind}')"


@query(tree_sql(LOG + FIGHTS + MERGED_UNITS + _rows("Heal", "actor"), ["who", "target"], HEALS))
def query_healing(spark, d):
    return compiled(spark, d, QuerySpec("healing", groupBy=["player", "target"], metrics=HEALS, petRollup=False))


CASTS = ["casts", "interrupts", "fizzles"]


@query(tree_sql(LOG + FIGHTS + MERGED_UNITS + _rows("Cast", "actor"), ["who", "'Mend'"], CASTS))
def query_casts(spark, d):
    return compiled(spark, d, QuerySpec("casts", groupBy=["player", "spell"], metrics=CASTS, petRollup=False))


@query(tree_sql(LOG + FIGHTS + MERGED_UNITS + _rows("Death", "target"), ["who", "actor"], ["deaths"]))
def query_deaths(spark, d):
    return compiled(spark, d, QuerySpec("deaths", groupBy=["player", "target"], metrics=["deaths"], petRollup=False))


GAINS = ["xpPercent", "xpPerHour", "xpGains", "aaPoints"]


@query(tree_sql(LOG + PRESENCE_UNITS + _rows("Experience", "actor"), ["CASE WHEN aa THEN 'AA point' WHEN even THEN 'party' ELSE 'solo' END"], GAINS))
def query_experience(spark, d):
    return compiled(spark, d, QuerySpec("experience", groupBy=["spell"], metrics=GAINS, petRollup=False))


STANDING = ["factionNet", "factionUps", "factionDowns", "factionCapped"]


@query(tree_sql(LOG + PRESENCE_UNITS + _rows("Faction", "faction"), ["who", "CASE WHEN capped THEN 'capped' WHEN delta >= 0 THEN 'up' ELSE 'down' END"], STANDING))
def query_faction(spark, d):
    return compiled(spark, d, QuerySpec("faction", groupBy=["player", "spell"], metrics=STANDING, petRollup=False))


LOOTS = ["loots", "platinum", "platPerHour"]


@query(tree_sql(LOG + PRESENCE_UNITS + _rows("Loot", "actor"), ["who", "item"], LOOTS))
def query_loot(spark, d):
    return compiled(spark, d, QuerySpec("loot", groupBy=["player", "spell"], metrics=LOOTS, petRollup=False))


@query(tree_sql(LOG + PRESENCE_UNITS + _rows("Consider", "target"), ["who", "'dubious'"], ["considers", "conLevel"]))
def query_considers(spark, d):
    return compiled(spark, d, QuerySpec("considers", groupBy=["player", "spell"], metrics=["considers", "conLevel"], petRollup=False))


OWNED = DEALT.replace("coalesce('Raider' || regexp_extract(actor, '^Rex(.*)$', 1), actor)", "CASE WHEN actor LIKE 'Rex%' THEN 'Raider' || substr(actor, 4) ELSE actor END")
PET_LEVELS = f"""SELECT 0 AS level, '' AS parent, '' AS path, 'Total' AS label, rd.* FROM rd UNION ALL SELECT 1, '', owner, CASE WHEN owner IN (SELECT owner FROM lone) THEN owner ELSE owner || ' +Pets' END, rd.* FROM rd
  UNION ALL SELECT 2, owner, owner || '/' || CASE WHEN owner IN (SELECT owner FROM lone) THEN {SUB} ELSE actor END, CASE WHEN owner IN (SELECT owner FROM lone) THEN {SUB} ELSE actor END, rd.* FROM rd
  UNION ALL SELECT 3, owner || '/' || actor, owner || '/' || actor || '/' || {SUB}, {SUB}, rd.* FROM rd WHERE owner NOT IN (SELECT owner FROM lone)"""


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + OWNED + ", lone AS (SELECT owner FROM r GROUP BY owner HAVING min(actor) = owner AND max(actor) = owner)", [], ["total", "hits", "activeSeconds", "dps", "percentOfTotal"], PET_LEVELS))
def query_pet_rollup(spark, d):
    return compiled(spark, d, QuerySpec("damage", groupBy=["player", "spell"], metrics=["total", "hits", "activeSeconds", "dps", "percentOfTotal"], petRollup=True))


@query(f"""{LOG}{FIGHTS}{FIGHT_UNITS}{DEALT} SELECT unnest(['', who]) AS path, CAST(s - (s + 62135596800) % 60 AS BIGINT) AS "at", CAST(sum(amount) AS BIGINT) AS value FROM r GROUP BY 1, 2""")
def query_series(spark, d):
    series = compile_query(world(spark, d), QuerySpec("damage", groupBy=["player"], metrics=["total"], bucketSeconds=60, petRollup=False)).series
    return series.select(F.array_join("path", "/").alias("path"), seconds("at").alias("at"), "value")


SHORT = ["total", "hits", "activeSeconds", "raidSeconds", "dps", "sdps"]
LOOSE = ", r AS (SELECT ev.*, id AS unit, actor AS who FROM ev JOIN units ON s BETWEEN b AND e WHERE kind = 'Damage' AND target LIKE 'A gnoll%')"


@query(tree_sql(LOG + ", units AS (SELECT 0 AS id, max(s) - 3599 AS b, max(s) AS e FROM ev)" + LOOSE, ["who"], SHORT))
def query_scope_last(spark, d):
    return compiled(spark, d, QuerySpec("damage", Scope(lastSeconds=3600), ["player"], SHORT, petRollup=False))


#: Two stretches of the log: one with fights, one before anything happened.
RANGES = [{"begin": "2024-01-01T01:00:00", "end": "2024-01-01T03:00:00"}, {"begin": "2023-01-01T00:00:00", "end": "2023-01-01T01:00:00"}]
_RANGE_UNITS = f", ur AS (SELECT id, npc AS name, greatest(b, {START + 3600}) AS b, least(e, {START + 10800}) AS e FROM fights WHERE b <= {START + 10800} AND e >= {START + 3600}), units AS (SELECT * FROM ur)"


@query(tree_sql(LOG + FIGHTS + _RANGE_UNITS + DEALT, ["who"], SHORT))
def query_scope_ranges(spark, d):
    return compiled(spark, d, QuerySpec("damage", Scope(timeRanges=RANGES), ["player"], SHORT, petRollup=False))


_TRIM = f""", fu AS (SELECT b, e FROM fights), mg AS (SELECT * FROM ({MERGE.format('fu')})), run AS (SELECT *, coalesce(sum(e - b + 1) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mg),
  cut AS (SELECT b + greatest(0, 300 - before) AS tb, least(e, b + 3900 - before - 1) AS te FROM run), ux AS (SELECT npc AS name, greatest(b, tb) AS b, least(e, te) AS e FROM fights JOIN cut ON tb <= te AND b <= te AND e >= tb),
  units AS (SELECT name || ' ' || b || ' ' || e AS id, * FROM ux)"""


@query(tree_sql(LOG + FIGHTS + _TRIM + DEALT, ["who"], SHORT))
def query_scope_trim(spark, d):
    return compiled(spark, d, QuerySpec("damage", Scope(skipFirstSeconds=300, maxSeconds=3600), ["player"], SHORT, petRollup=False))


_PLAYED = PRESENCE + ", ux AS (SELECT npc AS name, greatest(f.b, p.b) AS b, least(f.e, p.e) AS e FROM fights f JOIN presence p ON f.b <= p.e AND f.e >= p.b), units AS (SELECT name || ' ' || b || ' ' || e AS id, * FROM ux)"


@query(tree_sql(LOG + FIGHTS + _PLAYED + DEALT, ["who"], SHORT))
def query_scope_played(spark, d):
    return compiled(spark, d, QuerySpec("damage", Scope(playedTimeOnly=True), ["player"], SHORT, petRollup=False))


@query(tree_sql(LOG + FIGHTS + ", units AS (SELECT id, npc AS name, b, e FROM fights WHERE id IN (1, 3, 5))" + DEALT, ["who"], SHORT))
def query_scope_fights(spark, d):
    return compiled(spark, d, QuerySpec("damage", Scope(fightIds=[1, 3, 5]), ["player"], SHORT, petRollup=False))


_FILTERED = DEALT.replace("WHERE kind = 'Damage'", "WHERE kind = 'Damage' AND sub IN ('Blaze', 'Kicks') AND dk <> 'DamageShield' AND mods & 1024 <> 0 AND target <> 'A gnoll4'")


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + _FILTERED, ["target", "who"], SHORT))
def query_filters(spark, d):
    chosen = [Filter("spell", ["Blaze", "Kicks"]), Filter(flag="damageShield", exclude=True), Filter(flag="headshot"), Filter("target", ["A gnoll4"], exclude=True), Filter("player", [])]
    return compiled(spark, d, QuerySpec("damage", groupBy=["target", "player"], metrics=SHORT, filters=chosen, petRollup=False))


_UNFLAGGED = DEALT.replace("WHERE kind = 'Damage'", "WHERE kind = 'Damage' AND dk <> 'DamageShield' AND coalesce(school, '') <> 'bane' AND mods & (512 | 2048 | 4096) = 0")


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + _UNFLAGGED, ["who"], SHORT))
def query_flags(spark, d):
    """The summary that leaves out what a player can't compare: damage shields, bane and the rare strokes."""
    left_out = [Filter(flag=f, exclude=True) for f in ("damageShield", "bane", "assassinate", "finishingBlow", "slayUndead")]
    return compiled(spark, d, QuerySpec("damage", groupBy=["player"], metrics=SHORT, filters=left_out, petRollup=False))


_KIND = "coalesce(school, lower(dk[1]) || dk[2:])"


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + DEALT.replace("WHERE kind = 'Damage'", "WHERE kind = 'Damage' AND dk IN ('Melee', 'DirectDamage', 'DamageOverTime', 'DamageShield')"), ["'Raider0'", _KIND], SHORT))
def query_damage_types(spark, d):
    landed = Filter("damageType", ["Miss", "Dodge", "Parry", "Block", "Absorb", "Invulnerable"], exclude=True)
    return compiled(spark, d, QuerySpec("damage", groupBy=["character", "damageType"], metrics=SHORT, filters=[landed], petRollup=False))


_LONE = ", lone AS (SELECT owner FROM r GROUP BY owner HAVING min(actor) = owner AND max(actor) = owner)"


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + OWNED + _LONE, [], list(metrics.DEFAULTS["damage"]), PET_LEVELS))
def canned_damage_summary(spark, d):
    return compiled(spark, d, canned("DamageSummary"))


@query(tree_sql(LOG + FIGHTS + MERGED_UNITS + _rows("Heal", "actor"), ["who", "'Mend'"], list(metrics.DEFAULTS["healing"])))
def canned_healing_summary(spark, d):
    return compiled(spark, d, canned("HealingSummary"))


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + TAKEN, ["who", SUB], list(metrics.DEFAULTS["tanking"])))
def canned_tanking_summary(spark, d):
    return compiled(spark, d, canned("TankingSummary"))


@query(f"""{LOG}{FIGHTS}{FIGHT_UNITS}{OWNED}{_LONE}, v AS (SELECT '' AS path, s, amount FROM r UNION ALL SELECT CASE WHEN owner IN (SELECT owner FROM lone) THEN owner ELSE owner || ' +Pets' END, s, amount FROM r
    UNION ALL SELECT owner || '/' || actor, s, amount FROM r WHERE owner NOT IN (SELECT owner FROM lone))
  SELECT replace(path, ' +Pets', '') AS path, CAST(s AS BIGINT) AS "at", CAST(sum(amount) AS BIGINT) AS value FROM v GROUP BY 1, 2""")
def canned_dps_over_time(spark, d):
    series = compile_query(world(spark, d), canned("DpsOverTime")).series
    return series.select(F.array_join("path", "/").alias("path"), seconds("at").alias("at"), "value")


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + DEALT, ["target"], SHORT))
def query_from_cache(spark, d):
    """A result as the cache gives it the second time: read from its table, while the events are the same files."""
    store, spec = Store(spark), QuerySpec("damage", groupBy=["target"], metrics=SHORT)
    version = store.version_of(f"{d}/events.parquet")
    for _ in range(2):
        found = cached(store, spec, version, lambda s: compile_query(world(spark, d), s))
    return shown(found.rows)


@query(tree_sql(LOG + FIGHTS + MERGED_UNITS + _rows("Death", "target"), ["who", "actor"], ["deaths"]))
def canned_death_log(spark, d):
    return compiled(spark, d, canned("DeathLog"))


_SEARCHES = ("e", "la")


@query(f"""{LOG}{FIGHTS}{FIGHT_UNITS}{DEALT}, leaf AS (SELECT who, {SUB} AS sub FROM r GROUP BY ALL), q AS (SELECT unnest({list(_SEARCHES)}) AS q),
  lab AS (SELECT q, who, NULL AS sub, who AS label FROM q, (SELECT DISTINCT who FROM leaf) UNION ALL SELECT q, who, sub, sub FROM q, leaf),
  pos AS (SELECT *, strpos(lower(label), q) - 1 AS p FROM lab), own AS (SELECT *, CASE WHEN p >= 0 THEN 300 - least(p, 50) + CASE WHEN p = 0 OR NOT regexp_matches(lower(label)[p], '[a-z0-9]') THEN 20 ELSE 0 END END AS s FROM pos),
  top AS (SELECT q, who, max(s) FILTER (sub IS NULL) AS s, max(s) FILTER (sub IS NOT NULL) AS c FROM own GROUP BY ALL)
  SELECT q, own.who || coalesce('/' || sub, '') AS path, own.s IS NOT NULL AS hit, sub IS NULL AND top.c IS NOT NULL AS open, CAST(CASE WHEN sub IS NULL THEN coalesce(top.s, 0) + coalesce(top.c, 0) ELSE coalesce(own.s, 0) END AS DOUBLE) AS score
    FROM own JOIN top USING (q, who) WHERE own.s IS NOT NULL OR top.s IS NOT NULL OR sub IS NULL AND top.c IS NOT NULL""")
def fuzzy_tree(spark, d):
    """Two searches over damage by player and spell: one that players and spells hold, one that narrows players to spells."""
    rows = segments.cut(compile_query(world(spark, d), QuerySpec("damage", groupBy=["player", "spell"], metrics=["total"], petRollup=False)).rows)
    found = [present.filter_tree(rows, q).select(F.lit(q).alias("q"), F.array_join("path", "/").alias("path"), "hit", "open", "score") for q in _SEARCHES]
    return found[0].unionByName(found[1])


@query(f"""{LOG}{FIGHTS}{FIGHT_UNITS}{DEALT}, leaf AS (SELECT {SUB} || ' ' || (line % 5) AS spell, who, sum(amount) AS total FROM r WHERE dk IN ('Melee', 'DirectDamage', 'DamageOverTime', 'DamageShield') GROUP BY ALL),
  bars AS (SELECT spell, row_number() OVER (ORDER BY sum(total) DESC, spell) AS bar FROM leaf GROUP BY spell), loud AS (SELECT who, row_number() OVER (ORDER BY sum(total) DESC, who) AS segment FROM leaf GROUP BY who)
  SELECT CAST(least(bar, 15) AS INTEGER) AS bar, CASE WHEN bar <= 14 THEN spell ELSE 'Other (' || ((SELECT count(*) FROM bars) - 14) || ')' END AS label, CAST(least(segment, 9) AS INTEGER) AS segment, CASE WHEN segment <= 8 THEN who ELSE 'Other' END AS attacker,
    CAST(sum(total) AS BIGINT) AS total FROM leaf JOIN bars USING (spell) JOIN loud USING (who) GROUP BY ALL""")
def ability_bars(spark, d):
    """The fourteen largest abilities of the raid, cut into the eight largest attackers; spells come in five ranks here."""
    w = world(spark, d)
    ranked = w.events.withColumn("sub_type", F.when(F.col("kind") == "Damage", F.concat(F.coalesce("sub_type", F.lit("damageShield")), F.lit(" "), (F.col("line_no") % 5).cast("string"))).otherwise(F.col("sub_type")))
    landed = Filter("damageType", ["Miss", "Dodge", "Parry", "Block", "Absorb", "Invulnerable"], exclude=True)
    rows = compile_query(replace(w, events=ranked), QuerySpec("damage", groupBy=["spell", "player"], metrics=["total"], filters=[landed], petRollup=False)).rows
    return present.ability_bars(rows)


@query(tree_sql(LOG + FIGHTS + FIGHT_UNITS + DEALT, ["who", SUB], ["total"]).replace('PARTITION BY level, parent ORDER BY "total" DESC, first_line', "PARTITION BY level, parent ORDER BY regexp_replace(lower(label), '[0-9]+', ''), CAST(coalesce(nullif(regexp_extract(label, '[0-9]+'), ''), '0') AS INTEGER)"))
def sorted_tree(spark, d):
    """The damage tree by name at every level, numbers by value: Raider2 before Raider10."""
    rows = compile_query(world(spark, d), QuerySpec("damage", groupBy=["player", "spell"], metrics=["total"], petRollup=False)).rows
    return shown(present.sort_tree(rows, None, descending=False))


_OPEN = ", chosen AS (SELECT id FROM fights WHERE NOT closed UNION ALL (SELECT id FROM fights WHERE NOT EXISTS (SELECT 1 FROM fights WHERE NOT closed) ORDER BY last_activity DESC, id DESC LIMIT 1)), units AS (SELECT fights.id, npc AS name, b, e FROM fights JOIN chosen USING (id))"
_METER = ["total", "dps", "sdps", "percentOfTotal"]
_METER_LEVELS = PET_LEVELS.partition("\n  UNION ALL SELECT 2")[0] + " UNION ALL SELECT 2, owner, owner || '/' || actor, actor, rd.* FROM rd WHERE owner NOT IN (SELECT owner FROM lone)"


@query(tree_sql(LOG + FIGHTS + _OPEN + OWNED + ", lone AS (SELECT owner FROM r GROUP BY owner HAVING min(actor) = owner AND max(actor) = owner)", [], _METER, _METER_LEVELS))
def query_live_meter(spark, d):
    w = world(spark, d)
    return shown(compile_query(w, live_meter(w)).rows)


_STANCE = """, st AS (SELECT s, arg_max(stance, line) AS held FROM ev WHERE kind = 'Stance' GROUP BY s), sp AS (SELECT held, s AS b, coalesce(lead(s) OVER (ORDER BY s) - 1, (SELECT max(s) FROM ev)) AS e FROM st
    UNION ALL SELECT '(no stance)', (SELECT min(s) FROM ev), (SELECT min(s) FROM st) - 1 WHERE (SELECT min(s) FROM ev) < (SELECT min(s) FROM st)),
  pc AS (SELECT held, greatest(sp.b, p.b) AS b, least(sp.e, p.e) AS e FROM sp JOIN presence p ON sp.b <= p.e AND sp.e >= p.b),
  p1 AS (SELECT s, arg_min(held, pc.b) AS held, min(pc.b) AS b, arg_min(pc.e, pc.b) AS e FROM (SELECT DISTINCT s FROM r) x JOIN pc ON x.s BETWEEN pc.b AND pc.e GROUP BY s),
  mine AS (SELECT r.*, CASE WHEN who = 'Raider0' OR who = 'Rex0' THEN coalesce(held, '(no stance)') ELSE '(not you)' END AS stance_key, CASE WHEN who IN ('Raider0', 'Rex0') THEN greatest(pc.b, ub) END AS hb, CASE WHEN who IN ('Raider0', 'Rex0') THEN least(pc.e, ue) END AS he FROM r LEFT JOIN p1 pc USING (s)),
  nodes AS (SELECT '' AS path, hb AS b, he AS e FROM mine WHERE hb IS NOT NULL UNION SELECT stance_key, hb, he FROM mine WHERE hb IS NOT NULL),
  mk AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY path ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM nodes), isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM mk),
  held AS (SELECT path, sum(e - b + 1) AS secs FROM (SELECT path, i, min(b) AS b, max(e) AS e FROM isl GROUP BY ALL) GROUP BY path),
  tot AS (SELECT '' AS path, coalesce(sum(amount), 0) AS total FROM mine UNION ALL SELECT stance_key, sum(amount) FROM mine GROUP BY 1)
  SELECT path, CAST(total AS BIGINT) AS total, CAST(coalesce(secs, 0) AS BIGINT) AS "stanceSeconds", CASE WHEN coalesce(secs, 0) <> 0 THEN round(1.0 * total / secs, 6) ELSE 0.0 END AS "stanceDps",
    CASE WHEN (SELECT sum(secs) FROM held WHERE path = '') <> 0 THEN round(100.0 * coalesce(secs, 0) / (SELECT sum(secs) FROM held WHERE path = ''), 6) ELSE 0.0 END AS "stanceUptime" FROM tot LEFT JOIN held USING (path)"""
_WITH_ENDS = DEALT.replace("id AS unit,", "id AS unit, b AS ub, e AS ue,")


@query(LOG + FIGHTS + PRESENCE + FIGHT_UNITS + _WITH_ENDS + _STANCE)
def query_stances(spark, d):
    spec = QuerySpec("damage", groupBy=["stance"], metrics=["total", "stanceSeconds", "stanceDps", "stanceUptime"], petRollup=False)
    return compiled(spark, d, spec).select("path", "total", "stanceSeconds", "stanceDps", "stanceUptime")


# --- feeds of a session ---------------------------------------------------------------------------------------------

#: The merged fights as segments of a scope, from the second to the last day but one of the log.
_SEGMENTS = f""", cut AS (SELECT min(b) + 3600 AS low, max(e) - 3600 AS high FROM fights), fu AS (SELECT greatest(b, low) AS b, least(e, high) AS e FROM fights, cut WHERE b <= high AND e >= low), seg AS ({MERGE.format("fu")}), lim AS (SELECT min(b) AS low, max(e) AS high FROM seg)"""


def segments_of(w: World) -> DataFrame:
    """The merged fights, without the first and the last hour of them."""
    whole = w.listed().select(F.lit(0).alias("_k"), F.col("begin").alias("b"), F.greatest("last_damage", "begin").alias("e"))
    cut = whole.agg((F.min("b") + 3600).alias("low"), (F.max("e") - 3600).alias("high"))
    inside = whole.crossJoin(F.broadcast(cut)).where("b <= high and e >= low").select("_k", F.greatest("b", "low").alias("b"), F.least("e", "high").alias("e"))
    return intervals.merge(inside, ["_k"]).select("b", "e")


#: Spells of the timeline: Mend lasts level * 3 + 10 ticks, 60 at most.
MEND = ("Mend", 10, 60)


@query(f"""{LOG}{FIGHTS}{PRESENCE}{_SEGMENTS},
  mark AS (SELECT line, s, target, kind = 'WearOff' AS c, kind = 'Cast' AS own, CASE WHEN kind = 'Cast' THEN (SELECT arg_max(l.k - 60, l.line) FROM ev l WHERE l.kind = 'Level' AND l.line < ev.line) END AS lv FROM ev
    WHERE kind IN ('WearOff', 'Landed') OR kind = 'Cast' AND ck = 'Begin' AND actor = '{OWNER}'),
  num AS (SELECT *, coalesce(sum(c::INT) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM mark),
  span AS (SELECT n, min(s) FILTER (NOT c) AS b, max(s) FILTER (c) AS e, max(target) FILTER (c) AS target, arg_min(own, line) FILTER (NOT c) AS own, arg_min(lv, line) FILTER (NOT c) AS lv FROM num GROUP BY n),
  lvl AS (SELECT arg_max(lv, n) AS lv FROM span WHERE own AND lv > 0),
  buff AS (SELECT target AS actor, 'Buff' AS item, b, e FROM span WHERE b IS NOT NULL AND e IS NOT NULL UNION ALL SELECT '{OWNER}', 'Buff', b, b + 6 * least(60, lvl.lv * 3 + 10) FROM span, lvl WHERE b IS NOT NULL AND e IS NULL AND lvl.lv IS NOT NULL),
  st AS (SELECT s, arg_max(stance, line) AS held FROM ev WHERE kind = 'Stance' GROUP BY s), sp AS (SELECT held, s AS b, coalesce(lead(s) OVER (ORDER BY s) - 1, (SELECT max(s) FROM ev)) AS e FROM st
    UNION ALL SELECT '(no stance)', (SELECT min(s) FROM ev), (SELECT min(s) FROM st) - 1 WHERE (SELECT min(s) FROM ev) < (SELECT min(s) FROM st)),
  ins AS (SELECT line, ev.s, CASE kind WHEN 'Cast' THEN CASE ck WHEN 'Begin' THEN 'Cast' WHEN 'Interrupted' THEN 'Interrupt' ELSE 'Fizzle' END ELSE kind END AS item, CASE WHEN kind IN ('Death', 'Resist') THEN target ELSE actor END AS actor,
    CASE kind WHEN 'Ability' THEN 'Rest' WHEN 'Death' THEN 'slain by ' || ev.actor ELSE 'Mend' END AS label FROM ev JOIN seg ON ev.s BETWEEN seg.b AND seg.e WHERE kind IN ('Cast', 'Ability', 'Death', 'Resist')),
  cs AS (SELECT actor, s, least(s + 12, coalesce(lead(s) OVER (PARTITION BY actor ORDER BY s), s + 12)) AS until FROM (SELECT DISTINCT actor, s FROM ins WHERE item = 'Cast')),
  did AS (SELECT cs.actor, cs.s, sum(amount) AS total FROM cs JOIN ev ON ev.kind = 'Heal' AND ev.actor = cs.actor AND ev.s >= cs.s AND ev.s < cs.until AND amount > 0 GROUP BY ALL)
  SELECT actor, item, label, CAST(b AS BIGINT) AS b, CAST(e AS BIGINT) AS e, starts_before, ends_after, CAST(amount AS BIGINT) AS amount, effect FROM (
    SELECT actor, item, 'Mend' AS label, greatest(b, low) AS b, least(e, high) AS e, b < low AS starts_before, e > high AS ends_after, NULL AS amount, NULL AS effect FROM buff, lim WHERE b <= high AND e >= low
    UNION ALL SELECT '{OWNER}', 'Stance', held, greatest(sp.b, low, p.b), least(sp.e, high, p.e), sp.b < greatest(sp.b, low, p.b), sp.e > least(sp.e, high, p.e), NULL, NULL FROM sp, lim, presence p WHERE greatest(sp.b, low, p.b) <= least(sp.e, high, p.e)
    UNION ALL SELECT target, 'Fade', 'Mend', e, NULL, false, false, NULL, NULL FROM span, lim WHERE b IS NULL AND e BETWEEN low AND high
    UNION ALL SELECT ins.actor, item, label, ins.s, NULL, false, false, total, CASE WHEN total IS NOT NULL THEN 'Heal' END FROM ins LEFT JOIN did ON item = 'Cast' AND did.actor = ins.actor AND did.s = ins.s)""")
def timeline_of_fights(spark, d):
    w = world(spark, d)
    known = spark.createDataFrame([MEND], "name string, formula int, cap int")
    return timeline.timeline(w.events, segments_of(w), w.owner, stance_spans(w), w.presence(), known)


_INCOMING = """, inc AS (SELECT ev.line, ev.s, actor AS attacker, target AS defender, CASE WHEN target LIKE 'Rex%' THEN 'Raider' || substr(target, 4) END AS owner, coalesce(sub, dk) AS attack, dk AS damage_kind, amount, mods AS modifiers,
    (SELECT min(id) FROM fights f WHERE lower(f.npc) = lower(ev.actor) AND ev.s BETWEEN f.b AND f.last_damage) AS fight_id FROM ev JOIN seg ON ev.s BETWEEN seg.b AND seg.e WHERE kind = 'Damage' AND actor LIKE 'A gnoll%' AND target IN ('Raider1', 'Raider2', 'Raider3', 'Raider5'))"""


@query(f"""{LOG}{FIGHTS}{_SEGMENTS}{_INCOMING} SELECT line AS line_no, CAST(s AS BIGINT) AS s, attacker, defender, owner, attack, damage_kind, CAST(amount AS BIGINT) AS amount, CAST(modifiers AS INTEGER) AS modifiers, false AS spell, CAST(fight_id AS INTEGER) AS fight_id,
  (SELECT count(*) FROM inc) AS total FROM inc ORDER BY s DESC, line DESC LIMIT 200""")
def incoming_hits(spark, d):
    """The newest 200 hits on four raiders inside the scope, with how many there were."""
    w = world(spark, d)
    found = timeline.incoming(sided(w), segments_of(w), w.listed(), w.pets, ["raider1", "Raider2", "RAIDER3", "Raider5"])
    return feeds.tail(found, ["s", "line_no"]).select("line_no", "s", "attacker", "defender", "owner", "attack", "damage_kind", "amount", "modifiers", "spell", "fight_id", "total")


@query(f"""{LOG}{FIGHTS}{_SEGMENTS}, f AS (SELECT ev.line, CASE WHEN kind = 'Loot' THEN 'Looted' ELSE 'Chat' END AS what, CASE WHEN kind = 'Loot' THEN item ELSE 'Fang1' END AS item, ev.actor AS who, CASE WHEN kind = 'Loot' THEN target ELSE 'group' END AS with_whom,
    CASE WHEN kind = 'Loot' THEN qty ELSE 1 END AS quantity, ev.s FROM ev JOIN seg ON ev.s BETWEEN seg.b AND seg.e WHERE kind = 'Loot' OR kind = 'Chat' AND said IS NULL)
  SELECT line AS line_no, CAST(s AS BIGINT) AS s, what, item, CASE item WHEN 'Fang0' THEN 10 WHEN 'Fang1' THEN 11 END AS item_id, who, with_whom, CAST(quantity AS INTEGER) AS quantity FROM f ORDER BY line DESC LIMIT 200""")
def item_feed(spark, d):
    """Loot and chat about items inside the scope, the newest 200."""
    w = world(spark, d)
    registry = spark.createDataFrame([("Fang0", 10), ("Fang1", 11)], "name string, id int")
    found = feeds.item_feed(w.events, segments_of(w), registry)
    return feeds.newest_first([found], [F.desc("line_no"), F.desc("nth")]).select("line_no", "s", "what", "item", "item_id", "who", "with_whom", "quantity")


_INFO = f"""{LOG}{FIGHTS}, o AS (SELECT id, b AS begin, CASE WHEN b - max(last_damage) OVER (ORDER BY b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 120 THEN 0 ELSE 1 END AS new FROM fights),
  ch AS (SELECT id, CAST(sum(new) OVER (ORDER BY begin, id ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS grp FROM o),
  zf AS (SELECT *, (SELECT 'Fen' || (arg_max(k, line) % 3) FROM ev WHERE kind = 'Zone' AND ev.line < fights.first_line) AS zone FROM fights),
  hp AS (SELECT lower(npc) AS m, lower(zone) AS zk, quantile_disc(damage_total, 0.5) AS health FROM zf WHERE dead AND has_damage AND damage_total > 0 AND zone IS NOT NULL GROUP BY ALL),
  mine AS (SELECT npc, z, f, sum(amount) AS own FROM i WHERE damaging AND dealt AND actor IN ('Raider0', 'Rex0') GROUP BY ALL)"""


@query(f"""{_INFO} SELECT CAST(zf.id AS INTEGER) AS id, npc AS name, grp AS "group", zone AS zone_base, CAST(health AS BIGINT) AS health, CAST(coalesce(own, 0) AS BIGINT) AS own_damage, closed FROM zf JOIN ch USING (id) LEFT JOIN mine USING (npc, z, f) LEFT JOIN hp ON lower(npc) = m AND lower(zone) = zk""")
def fight_info(spark, d):
    """The fight list as it is shown: pull chain, estimated health where the mob has been killed, and the owner's side's damage."""
    _, rows, found, _ = fought(spark, d)
    _, pets = evidence(spark)
    kills = learned.harvest_kills(found.withColumn("difficulty", F.lit(None).cast("int")))
    health = kills.groupBy("mob_key", "zone_key", "difficulty").agg(learned.nearest_rank("damage", 0.5).alias("health"))
    info = fights.fight_info(found, rows, OWNER, pets, health)
    return info.select("id", "name", "group", "zone_base", "health", "own_damage", "closed")


# --- text and back --------------------------------------------------------------------------------------------------


def log_text(e: DataFrame) -> DataFrame:
    """(line_no, value): each event as a line of a log."""
    k, t, at = F.col("k"), F.col("event_type"), F.timestamp_add("SECOND", F.col("s"), F.lit("1970-01-01").cast("timestamp_ntz"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    who, foe, n = name("Raider", F.col("user_id")), name("a gnoll", k % 10), F.col("cents").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    trail = F.when(k % 4 == 3, " (Lucky Critical)").when(k % 2 == 1, " (Critical)").otherwise("")
    text = (
        F.when((t == "click") & (k < 60), say(who, " slashes ", foe, " for ", n, " points of damage.", trail))
        .when(t == "click", say(who, " tries to kick ", foe, F.when(k < 80, ", but misses!").otherwise(F.concat(F.lit(", but "), foe, F.lit(" dodges!")))))
        .when((t == "purchase") & (k < 50), say(who, " hit ", foe, " for ", n, " points of fire damage by Blaze.", trail))
        .when((t == "purchase") & (k < 90), say(foe, " has taken ", n, " damage from Slow Burn by ", who, ".", trail))
        .when(t == "purchase", say(foe, " has been slain by ", who, "!"))
        .when((t == "view") & (k < 50), say(who, " healed ", name("Raider", F.col("user_id") + 1), " for ", n, " (", (F.col("cents") + k).cast("string"), ") hit points by Mend.", trail))
        .when((t == "view") & (k < 75), say(who, " begins casting Mend."))
        .when(t == "view", say("--", who, " has looted ", (k % 4 + 2).cast("string"), " Fangs from ", foe, "'s corpse.--"))
        .when((t == "error") & (k < 60), say(who, " tells the group, 'I slashes ", foe, " for ", n, " points of damage.'"))
        .when(t == "error", say("Your faction standing with Fen has been adjusted by ", (k - 80).cast("string"), "."))
        .when(k < 50, say("You have entered ", name("Fen ", k), "."))
        .otherwise(say("a passer-by looks around at ", n, " things"))
    )
    return e.select(F.col("event_id").alias("line_no"), F.concat(F.date_format(at.cast("timestamp"), "'['EEE MMM dd HH:mm:ss yyyy'] '"), text).alias("value"))


@query(f"""WITH {E}, x AS (SELECT *, 'Raider' || user_id AS who, 'A gnoll' || (k % 10) AS foe, CASE WHEN k % 4 = 3 THEN 3 WHEN k % 2 = 1 THEN 1 ELSE 0 END AS mods FROM e)
  SELECT event_id, s, CASE event_type WHEN 'click' THEN 'Damage' WHEN 'purchase' THEN CASE WHEN k < 90 THEN 'Damage' ELSE 'Death' END WHEN 'view' THEN CASE WHEN k < 50 THEN 'Heal' WHEN k < 75 THEN 'Cast' ELSE 'Loot' END WHEN 'error' THEN CASE WHEN k < 60 THEN 'Chat' ELSE 'Faction' END ELSE 'Zone' END AS kind,
    CASE WHEN event_type IN ('click', 'purchase', 'view') OR event_type = 'error' AND k < 60 THEN who END AS actor,
    CASE WHEN event_type IN ('click', 'purchase') THEN foe WHEN event_type = 'view' AND k < 50 THEN 'Raider' || (user_id + 1) END AS target,
    CASE WHEN event_type = 'click' AND k >= 60 THEN 0 WHEN event_type = 'click' OR event_type = 'purchase' AND k < 90 OR event_type = 'view' AND k < 50 THEN cents END AS amount,
    CASE WHEN event_type = 'view' AND k < 50 THEN cents + k END AS potential,
    CASE WHEN event_type = 'click' THEN CASE WHEN k < 60 THEN 'Melee' WHEN k < 80 THEN 'Miss' ELSE 'Dodge' END WHEN event_type = 'purchase' AND k < 50 THEN 'DirectDamage' WHEN event_type = 'purchase' AND k < 90 THEN 'DamageOverTime' END AS damage_kind,
    CASE WHEN event_type = 'click' THEN CASE WHEN k < 60 THEN 'Slashes' ELSE 'Kicks' END WHEN event_type = 'purchase' AND k < 50 THEN 'Blaze' WHEN event_type = 'purchase' AND k < 90 THEN 'Slow Burn' END AS sub_type,
    CASE WHEN event_type = 'click' AND k >= 60 THEN 0 WHEN event_type = 'click' OR event_type = 'purchase' AND k < 90 OR event_type = 'view' AND k < 50 THEN mods END AS modifiers,
    CASE WHEN event_type = 'view' AND k >= 75 THEN CAST(k % 4 + 2 AS INTEGER) END AS quantity, CASE WHEN event_type = 'error' AND k >= 60 THEN k - 80 END AS delta,
    CASE WHEN event_type = 'error' AND k < 60 THEN 'I slashes a gnoll' || (k % 10) || ' for ' || cents || ' points of damage.' END AS said, CASE WHEN event_type = 'signup' THEN 'Fen ' || k END AS zone
  FROM x WHERE event_type <> 'signup' OR k < 50""")
def log_line_parse(spark, d):
    text = log_text(events(spark, d)).withColumn("session_id", F.lit("log"))
    found = grammar.parse_text(text, F.lit(OWNER))
    return found.select(
        F.shiftright("line_no", 12).alias("event_id"), seconds("ts").alias("s"), "kind", F.when(~F.col("kind").isin("Faction", "Zone"), F.col("actor")).alias("actor"), "target", "amount", "potential", "damage_kind", "sub_type", "modifiers", "quantity", "delta",
        F.when(F.col("kind") == "Chat", F.col("text")).alias("said"), "zone",
    )


#: Bytes that a trigger takes of each log.
TRIGGER_BYTES = 1 << 20


@query(f"""SELECT kind, CAST(s // 3600 * 3600 AS BIGINT) AS "at", count(*) AS n, CAST(coalesce(sum(amount), 0) AS BIGINT) AS total FROM ({ORACLES["log_line_parse"]}) GROUP BY ALL""")
def tail_totals(spark, d):
    """The events as logs, followed byte range by byte range, parsed as they come, and totalled by hour."""
    folder = live.folder_of(spark, "tail")
    log_text(events(spark, d)).repartitionByRange(FILES * PIECES, "line_no").sortWithinPartitions("line_no").select("value").write.text(f"{folder}/logs")
    tail.register(spark)
    lines = spark.readStream.format("log_tail").option("glob", "part-*").option("maxBytes", TRIGGER_BYTES).option("journal", f"{folder}/journal").load(f"{folder}/logs")
    found = live.stored(grammar.parse_text(lines.withColumn("session_id", F.col("file")), F.lit(OWNER)).select("kind", "ts", "amount"), "tailed", drain=True)
    at = F.floor(seconds("ts") / 3600) * 3600
    return found.groupBy("kind", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
