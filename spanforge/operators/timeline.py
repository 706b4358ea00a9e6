"""The timeline of a range: spans of buffs and stances, clipped to it, and instants inside its segments with what they did.

Segments are the merged stretches (b, e) of a scope; the range goes from the first to the last of them.  Buffs are
paired over the whole stream, since one cast before the range may fade in it, and then clipped; clipped spans say so
(starts_before, ends_after).  Instants count in the segments alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import feeds, intervals, segments, spells

HOUR = 3600
HEARD = ("Cast", "Landed", "WearOff", "Level", "Ability", "Death", "Resist", "Damage", "Heal")
COLUMNS = ("actor", "item", "label", "b", "e", "starts_before", "ends_after", "amount", "effect")


def limits(stretches: DataFrame) -> DataFrame:
    """(low, high): one row, without nulls; none for an empty scope."""
    return stretches.agg(F.min("b").alias("low"), F.max("e").alias("high")).where("low is not null")


def clipped(spans: DataFrame, limit: DataFrame) -> DataFrame:
    """Spans (actor, item, label, b, e) that touch the range, cut to it, with what was cut."""
    met = spans.crossJoin(F.broadcast(limit)).where("b <= high and e >= low")
    return met.select("actor", "item", "label", F.greatest("b", "low").alias("b"), F.least("e", "high").alias("e"), (F.col("b") < F.col("low")).alias("starts_before"), (F.col("e") > F.col("high")).alias("ends_after"))


def buffs(events: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(spans, fades): the owner's casts and landings up to the spell's next fading, and fadings without an open span.

    A recast or landing of an open span changes nothing: the earliest one anchors it.
    """
    kind = F.col("kind")
    opens = F.coalesce((kind == "Landed") | ((kind == "Cast") & (F.col("cast_kind") == "Begin") & (F.lower("actor") == owner.lower())), F.lit(False))
    closes = kind == "WearOff"
    marked = events.where((opens | closes) & F.col("spell").isNotNull()).select("session_id", F.lower("spell").alias("_key"), "line_no", "s", "spell", "target", opens.alias("_open"), closes.alias("_close"))
    before = Window.partitionBy("session_id", "_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = marked.withColumn("_span", F.coalesce(F.count_if("_close").over(before), F.lit(0)))
    spans = numbered.groupBy("session_id", "_key", "_span").agg(F.min(F.when(F.col("_open"), F.col("s"))).alias("_from"), F.max(F.when(F.col("_close"), F.struct("s", "target", "spell"))).alias("_end"))
    ended = spans.where("_end is not null")
    paired = ended.where("_from is not null").select(F.col("_end.target").alias("actor"), F.lit("Buff").alias("item"), F.col("_end.spell").alias("label"), F.col("_from").alias("b"), F.col("_end.s").alias("e"))
    return paired, ended.where("_from is null").select(F.col("_end.target").alias("actor"), F.lit("Fade").alias("item"), F.col("_end.spell").alias("label"), F.col("_end.s").alias("s"))


def instants(events: DataFrame, stretches: DataFrame) -> DataFrame:
    """(session_id, line_no, s, actor, item, label): casts, abilities, deaths and resists inside the segments."""
    kind, cast = F.col("kind"), F.col("cast_kind")
    item = (
        F.when(kind == "Cast", F.when(cast == "Begin", F.when(F.coalesce("song", F.lit(False)), "Song").otherwise("Cast")).when(cast == "Interrupted", "Interrupt").otherwise("Fizzle"))
        .when(kind.isin("Ability", "Death", "Resist"), kind)
    )
    actor = F.when(kind == "Death", F.col("target")).when(kind == "Resist", F.coalesce("target", "actor")).otherwise(F.col("actor"))
    label = (
        F.when(kind == "Cast", F.coalesce("spell", F.lit("(unknown)"))).when(kind == "Ability", F.col("ability")).when(kind == "Resist", F.col("spell"))
        .otherwise(F.when(F.col("actor").isNull(), "died").otherwise(F.concat(F.lit("slain by "), F.col("actor"))))
    )
    rows = events.select("session_id", "line_no", "s", item.alias("item"), actor.alias("actor"), label.alias("label")).where("item is not null")
    return segments.within(rows, stretches.select("b", "e"), [], [], HOUR).drop("b", "e")


def with_amounts(marks: DataFrame, events: DataFrame) -> DataFrame:
    """marks with amount and effect: what a cast or song landed by its name within 12 s, or until the next one.

    Damage (but no shields and no spells that hit by themselves) and healing are added up apart, and the larger counts;
    of equal sums the damage.  Casts of one second share what follows.
    """
    casts = marks.where(F.col("item").isin("Cast", "Song")).select("session_id", F.lower("actor").alias("_a"), F.lower("label").alias("_l"), "s").distinct()
    kind = F.col("kind")
    harm = (kind == "Damage") & ~F.coalesce("is_spell", F.lit(False)) & (F.col("damage_kind") != "DamageShield")
    name = F.when(harm, F.col("sub_type")).when(kind == "Heal", F.col("spell"))
    landed = events.where(harm | (kind == "Heal")).where("amount > 0").select("session_id", F.lower("actor").alias("_a"), F.lower(name).alias("_l"), "s", "amount", (kind == "Heal").alias("_heal"))
    keys = ["session_id", "_a", "_l"]
    landed = landed.join(casts.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "s").agg(F.sum(F.when(F.col("_heal"), 0).otherwise(F.col("amount"))).alias("_harm"), F.sum(F.when(F.col("_heal"), F.col("amount")).otherwise(0)).alias("_mend"))
    # a second's casts come before what lands in it
    w = Window.partitionBy(*keys).orderBy("s", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = casts.withColumn("_side", F.lit(0)).unionByName(landed.withColumn("_side", F.lit(1)), allowMissingColumns=True).withColumn("_cast", F.max(F.when(F.col("_side") == 0, F.col("s"))).over(w))
    sums = both.where((F.col("_side") == 1) & (F.col("s") < F.col("_cast") + feeds.ATTRIBUTION_SECONDS)).groupBy(*keys, "_cast").agg(F.sum("_harm").alias("_harm"), F.sum("_mend").alias("_mend"))
    keyed = marks.withColumn("_a", F.when(F.col("item").isin("Cast", "Song"), F.lower("actor"))).withColumn("_l", F.lower("label"))
    met = keyed.join(sums.withColumnRenamed("_cast", "s"), [*keys, "s"], "left")
    more = F.col("_harm") >= F.col("_mend")
    return met.select(*marks.columns, F.greatest("_harm", "_mend").cast("long").alias("amount"), F.when(more, "Damage").when(~more, "Heal").alias("effect"))


def timeline(events: DataFrame, stretches: DataFrame, owner: str, stances: DataFrame, presence: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """COLUMNS of one session: spans have e, instants don't; amounts belong to casts and songs.

    stances: (held, b, e) of the owner; presence: (b, e) of the play sessions, at which a stance's span stops and goes on;
    known: (name, formula, cap) of spells, for buffs of the owner that never faded.
    """
    # what the parts read, stored once
    events = segments.cut(events.where(F.col("kind").isin(*HEARD)).select("session_id", "line_no", "s", "kind", "actor", "target", "amount", "damage_kind", "sub_type", "is_spell", "spell", "cast_kind", "song", "ability", "level"))
    stretches = segments.cut(stretches.select("b", "e"))
    limit = limits(stretches)
    faded, fades = buffs(events, owner)
    spans = faded
    if known is not None:
        open_ = spells.predicted_ends(events, known, owner).select(F.lit(owner).alias("actor"), F.lit("Buff").alias("item"), F.col("spell").alias("label"), "b", "e")
        spans = spans.unionByName(open_)
    held = stances.select(F.lit(owner).alias("actor"), F.lit("Stance").alias("item"), F.col("held").alias("label"), "b", "e", F.col("b").alias("_from"), F.col("e").alias("_to"))
    inside = held.crossJoin(F.broadcast(limit)).where("b <= high and e >= low").withColumn("b", F.greatest("b", "low")).withColumn("e", F.least("e", "high")).drop("low", "high").withColumn("_k", F.lit(0))
    pieces = intervals.intersect(inside, presence.select("b", "e").withColumn("_k", F.lit(0)), ["_k"])
    pieces = pieces.select("actor", "item", "label", "b", "e", (F.col("_from") < F.col("b")).alias("starts_before"), (F.col("_to") > F.col("e")).alias("ends_after"))
    marks = with_amounts(instants(events, stretches), events)
    faint = fades.crossJoin(F.broadcast(limit)).where("s between low and high").select("actor", "item", "label", "s", F.lit(None).cast("long").alias("amount"), F.lit(None).cast("string").alias("effect"))
    none = F.lit(None).cast("long")
    points = marks.select("actor", "item", "label", "s", "amount", "effect").unionByName(faint)
    points = points.select("actor", "item", "label", F.col("s").alias("b"), none.alias("e"), F.lit(False).alias("starts_before"), F.lit(False).alias("ends_after"), "amount", "effect")
    drawn = clipped(spans, limit).unionByName(pieces).withColumn("amount", none).withColumn("effect", F.lit(None).cast("string"))
    return drawn.select(*COLUMNS).unionByName(points.select(*COLUMNS))


def incoming(sided: DataFrame, stretches: DataFrame, fights: DataFrame, pets: DataFrame, defenders: list[str] | None = None) -> DataFrame:
    """Hits on the party inside the segments: attackers that are enemies for certain, defenders that aren't.

    sided: events with actor_npc, actor_player and target_npc.  defenders restricts the feed to names or their pets,
    whatever the case.  spell tells damage that can't be dodged; fight_id is the first fight of that enemy at the time.
    """
    hits = sided.where((F.col("kind") == "Damage") & (F.length("actor") > 0) & ~F.coalesce("is_spell", F.lit(False)) & F.col("actor_npc") & ~F.col("actor_player") & ~F.col("target_npc"))
    inside = segments.within(hits, stretches.select("b", "e"), [], [], HOUR)
    owned = inside.join(pets.select(F.col("pet").alias("target"), F.col("owner").alias("_owner")), "target", "left").withColumn("owner", F.coalesce("target_owner", "_owner"))
    if defenders:
        wanted = [d.lower() for d in defenders]
        owned = owned.where(F.lower("target").isin(*wanted) | F.coalesce(F.lower("owner").isin(*wanted), F.lit(False)))
    spell = F.col("damage_kind").isin("DirectDamage", "DamageOverTime", "DamageShield", "Other")
    attack: Column = F.coalesce(F.nullif("sub_type", F.lit("")), "damage_kind")
    rows = owned.select("line_no", "s", F.col("actor").alias("attacker"), F.col("target").alias("defender"), "owner", attack.alias("attack"), "damage_kind", "amount", "modifiers", spell.alias("spell"))
    return feeds.fight_at(rows, fights)
