"""Spell books: names behind emotes, durations by level, and emote lines as landings and fades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICK = 6
PERMANENT = 50


def duration(formula: Column, cap: Column, level: Column) -> Column:
    """Seconds of a spell cast at a level (1 at least), no longer than its cap if it has one; null if it is permanent."""
    n = F.greatest(level, F.lit(1))
    ticks = (
        F.when(formula == 0, 0).when(formula.isin(1, 6), F.floor(n / 2)).when(formula == 2, F.floor(n / 2) + 5).when(formula == 3, n * 30).when(formula == 4, 50).when(formula == 5, 2)
        .when(formula == 7, n).when(formula == 8, n + 10).when(formula == 9, n * 2 + 10).when(formula == 10, n * 3 + 10).when(formula == 12, F.floor(n / 4)).when(formula == 3600, 3600).otherwise(cap)
    )
    capped = F.when(ticks <= 0, 0).when(cap > 0, F.least(ticks, cap)).otherwise(ticks)
    return F.when(formula != PERMANENT, (capped * TICK).cast("long"))


def book(spells: DataFrame, strings: DataFrame) -> DataFrame:
    """(slot, emote, spell, candidates): the spell of each emote text, null and a count where several share it.

    spells: id, name; strings: id and the emotes landed_me, landed_other, gone.
    """
    named = strings.join(spells.select("id", "name"), "id")
    slots = F.stack(F.lit(3), F.lit("me"), F.col("landed_me"), F.lit("other"), F.col("landed_other"), F.lit("gone"), F.col("gone")).alias("slot", "emote")
    emotes = named.select("name", slots).where("emote is not null and emote <> ''").distinct()
    return emotes.groupBy("slot", "emote").agg(F.when(F.count(F.lit(1)) == 1, F.first("name")).alias("spell"), F.count(F.lit(1)).cast("int").alias("candidates"))


def durations(spells: DataFrame) -> DataFrame:
    """(name, formula, cap) of the first row of each name."""
    return spells.groupBy("name").agg(F.min_by(F.struct("formula", "cap"), "row").alias("d")).select("name", "d.formula", "d.cap")


def recognise(lines: DataFrame, emotes: DataFrame, owner: str) -> DataFrame:
    """Landed and WearOff rows of emote lines: the whole line for the owner's, the longest tail for others'.

    Lines are joined with the book by equality on every tail that begins at a blank or apostrophe.
    """
    whole = lines.join(emotes.where("slot <> 'other'"), F.col("action") == F.col("emote"))
    mine = whole.where("slot = 'me' or candidates = 1").select("session_id", "line_no", "ts", F.when(F.col("slot") == "me", "Landed").otherwise("WearOff").alias("kind"), F.lit(owner).alias("target"), "spell", "emote", "candidates")
    n = F.length("action")
    cut = lines.select("*", F.explode(F.sequence(F.lit(2), n)).alias("_at")).where(F.substr("action", F.col("_at"), F.lit(1)).isin(" ", "'", "`"))
    tails = cut.select("session_id", "line_no", "ts", F.substr("action", F.lit(1), F.col("_at") - 1).alias("target"), F.substr("action", F.col("_at")).alias("emote"))
    near = tails.where(~F.lower("target").isin("the", "a", "an")).join(emotes.where("slot = 'other'"), "emote")
    best = near.groupBy("session_id", "line_no", "ts").agg(F.max_by(F.struct("target", "spell", "emote", "candidates"), F.length("emote")).alias("b"))
    other = best.select("session_id", "line_no", "ts", F.lit("Landed").alias("kind"), "b.*")
    return mine.unionByName(other.join(mine.select("session_id", "line_no"), ["session_id", "line_no"], "left_anti"))


def predicted_ends(rows: DataFrame, known: DataFrame, owner: str) -> DataFrame:
    """(session_id, spell, b, e): buffs that never faded, up to the end that the owner's level at the cast gives them.

    rows has session_id, line_no, s, kind, actor, cast_kind, spell and level; known is (name, formula, cap), one row a
    name whatever its case.  A span opens with the owner's cast or a landing and closes with the spell's fading; later
    opens of an open span change nothing.  The level comes from announcements before the cast that opened a span, and
    stays known for the spell if a landing opens it again.  Spells that the owner never cast, or cast without a level,
    permanent ones and those without a duration have no row.
    """
    kind = F.col("kind")
    level = F.last(F.when(kind == "Level", F.col("level")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    own = (kind == "Cast") & (F.col("cast_kind") == "Begin") & (F.lower("actor") == owner.lower())
    own, closes = F.coalesce(own, F.lit(False)), kind == "WearOff"
    heard = rows.where(own | kind.isin("Level", "Landed", "WearOff"))
    marked = heard.select("session_id", F.lower("spell").alias("_key"), "line_no", "s", "spell", level.alias("_level"), own.alias("_own"), closes.alias("_close"), (kind == "Level").alias("_level_only")).where("_key is not null and not _level_only")
    earlier = Window.partitionBy("session_id", "_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = marked.withColumn("_span", F.coalesce(F.count_if("_close").over(earlier), F.lit(0))).groupBy("session_id", "_key", "_span").agg(
        F.min(F.when(~F.col("_close"), F.struct("line_no", "s", "spell", "_own", "_level"))).alias("_first"), F.bool_or("_close").alias("_closed")
    )
    cast = F.when(F.col("_first._own") & (F.col("_first._level") > 0), F.col("_span"))
    last = spans.groupBy("session_id", "_key").agg(F.max_by("_first._level", cast).alias("_at"), F.max(F.when(~F.col("_closed"), F.col("_first"))).alias("_open"))
    timed = last.where("_open is not null and _at is not null").join(known.select(F.lower("name").alias("_key"), "formula", "cap"), "_key")
    lasts = duration(F.col("formula"), F.col("cap"), F.col("_at"))
    return timed.where(lasts > 0).select("session_id", "_open.spell", F.col("_open.s").alias("b"), (F.col("_open.s") + lasts).alias("e"))
