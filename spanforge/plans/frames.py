"""Time frames of a client: what part of the log its panels ask about, and the fights and specs that follow from it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import moment
from .query import Filter, QuerySpec, Scope

#: Fixed value: more fights than this in a chart aren't drawn as bands.
MOST_BANDS = 120


@dataclass
class Frame:
    """Either the last `span` seconds (None: the whole log), or a range with the fights that it was made from."""

    span: int | None = None
    begin: str | None = None
    end: str | None = None
    fightIds: list[int] = field(default_factory=list)

    def scope(self, warmup: int = 0) -> Scope:
        """warmup: seconds of history before the frame that a rolling mean needs."""
        if self.begin is not None:
            begin = (datetime.fromisoformat(self.begin) - timedelta(seconds=warmup)).isoformat() if warmup > 0 else self.begin
            return Scope(timeRanges=[{"begin": begin, "end": self.end}])
        return Scope() if self.span is None else Scope(lastSeconds=self.span + warmup)


def frame_of_fights(fights: DataFrame, ids: list[int]) -> Frame | None:
    """From the chosen fights' first second to their last; None if none of them is there."""
    row = fights.where(F.col("id").isin(*ids)).agg(moment(F.min("begin")).cast("string"), moment(F.max("last_damage")).cast("string")).first() if ids else None
    if row is None or row[0] is None:
        return None
    return Frame(begin=row[0].replace(" ", "T"), end=row[1].replace(" ", "T"), fightIds=list(ids))


def fights_in(frame: Frame, fights: DataFrame) -> DataFrame:
    """The fights that a frame covers: its own, all, or those that lasted into its span before the newest one's end."""
    if frame.begin is not None:
        return fights.where(F.col("id").isin(*frame.fightIds)) if frame.fightIds else fights.limit(0)
    if frame.span is None:
        return fights
    newest = fights.agg(F.max_by("last_damage", "id").alias("_newest"))
    return fights.crossJoin(F.broadcast(newest)).where(F.col("last_damage") >= F.col("_newest") - frame.span).drop("_newest")


def fights_between(fights: DataFrame, anchor: int, target: int) -> list[int]:
    """The ids between two fights of the list, in either order, both included; the target alone if one isn't there."""
    known = {r["id"] for r in fights.where(F.col("id").isin(anchor, target)).select("id").collect()}
    if not {anchor, target} <= known:
        return [target]
    return [r["id"] for r in fights.where(F.col("id").between(min(anchor, target), max(anchor, target))).select("id").orderBy("id").collect()]


def fight_bands(fights: DataFrame, low: int, high: int, most: int = MOST_BANDS) -> DataFrame:
    """The fights that overlap [low, high], or none if there are more than can be told apart."""
    met = fights.where((F.coalesce("last_damage", "begin") >= low) & (F.col("begin") <= high)).select("id", "name", "begin", "last_damage")
    few = met.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most)
    return met.crossJoin(F.broadcast(few)).drop("_n")


def level_choices(estimates: DataFrame) -> DataFrame:
    """(defender_level, label, count): levels that attacks were seen at, the one seen last first."""
    seen = estimates.groupBy("defender_level").agg(F.count(F.lit(1)).alias("count"), F.max("last_seen").alias("last"))
    return seen.orderBy(F.desc("last"), F.col("defender_level").asc_nulls_last()).select("defender_level", F.coalesce(F.col("defender_level").cast("string"), F.lit("unknown")).alias("label"), "count")


@dataclass
class Panel:
    source: str = "damage"
    groupBy: list[str] = field(default_factory=lambda: ["player"])
    metrics: list[str] = field(default_factory=list)
    viz: str = "table"  # table, bar, line, droprate
    primaryMetric: str = "total"
    scopeMode: str = "frame"  # or recent: a window of its own
    lastSeconds: int = 60
    skipFirstSeconds: int = 0
    maxSeconds: int | None = None
    excludeFlags: list[str] = field(default_factory=list)
    ownerOnly: bool = False
    playerFilter: list[str] = field(default_factory=list)
    spellFilter: list[str] = field(default_factory=list)

    def spec(self, frame: Frame, pet_rollup: bool = True, character: str = "", played_time: bool = False, warmup: int = 0, bucket: int | None = None) -> QuerySpec:
        """The query behind the panel; warmup and bucket are a line's."""
        line = self.viz == "line"
        warmup = warmup if line else 0
        scope = Scope(lastSeconds=self.lastSeconds + warmup) if self.scopeMode == "recent" else frame.scope(warmup)
        scope.playedTimeOnly = played_time
        if self.scopeMode != "recent":
            scope.skipFirstSeconds = self.skipFirstSeconds or None
            scope.maxSeconds = self.maxSeconds or None
        filters = [Filter(flag=f, exclude=True) for f in self.excludeFlags]
        if self.ownerOnly and character:
            filters.append(Filter("player", [character]))
        filters += [Filter(dim, values) for dim, values in (("player", self.playerFilter), ("spell", self.spellFilter)) if values]
        names = ["loots"] if self.viz == "droprate" else list(self.metrics) if self.viz == "table" else list(dict.fromkeys([self.primaryMetric, "total"]))
        return QuerySpec(self.source, scope, list(self.groupBy), names, filters, bucket if line else None, pet_rollup)
