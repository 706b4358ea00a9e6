"""Engagements as they happen: a stateful stream by session, closed by death, zone lines, idle log time and idle wall clock.

The rules are those of `operators.fights`, applied line by line: more than 30 idle seconds end a fight with damage, more
than 60 one without; its enemy's death and any zone line end it at once.  A row that proves a name to be a player's
takes that name's fights back (`removed`).  A session's state is its open fights, the spells that players cast within
300 s, names that proved to be players', and the first lines of fights with one-word names, which such a proof may
take back; it doesn't grow with the log but for those names.

A session that falls silent has no next line to close its fights.  Its processing-time timer does: from the arrival of a
row on, wall-clock seconds count as log seconds, so a replay of an old log isn't cut where batches happen to end.

Rows of a micro-batch must follow those of the batches before (a tail's do); within a batch order doesn't matter.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import identity
from ..operators.fights import CAST_MEMORY, IDLE, IDLE_UNDAMAGED

FIGHT = (
    "session_id string, first_line long, name string, zone string, zone_change long, begin long, last_damage long, last_activity long, dead boolean, closed boolean, "
    "removed boolean, has_damage boolean, damage_total long, tanking_total long, taunts long, version long"
)
KEYS = ["session_id", "first_line"]
SIDES = ("actor_npc", "actor_player", "target_npc", "target_player")


def proven() -> Column:
    """The name that a row shows to be a player's."""
    kind = F.col("kind")
    chat = (kind == "Chat") & F.col("channel").isin(*identity.PLAYER_CHANNELS)
    leader = F.regexp_extract(F.coalesce("text", F.lit("")), r"^My leader is (\w+)", 1)
    name = F.when(chat | kind.isin("Membership", "Who"), F.col("actor")).when((kind == "Chat") & (leader != ""), leader)
    return F.when(identity.single_word(name), name)


def steps(sided: DataFrame) -> DataFrame:
    """What the state needs of events with sides; rows that change nothing still move the clock."""
    kind = F.col("kind")
    role = (
        F.when((kind == "Damage") & F.col("actor").isNotNull(), "damage").when(kind == "Death", "death").when(kind == "Zone", "zone").when(kind == "Taunt", "taunt")
        .when((kind == "Cast") & (F.col("cast_kind") == "Begin") & ~F.col("actor_npc") & F.col("spell").isNotNull(), "cast").when(proven().isNotNull(), "proof")
    )
    sides = [F.coalesce(c, F.lit(False)).alias(c) for c in SIDES]
    return sided.select("session_id", "line_no", "s", role.alias("role"), "actor", "target", F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("is_spell", F.lit(False)).alias("is_spell"), F.lower("spell").alias("spell"), "zone", proven().alias("proof"), *sides)


class Session:
    """One session's state between batches; `changed` are the fights to report."""

    def __init__(self, stored: str | None = None):
        held = json.loads(stored) if stored else {}
        self.open: dict[str, dict] = held.get("open", {})
        self.casts: dict[str, int] = held.get("casts", {})
        self.players: set[str] = set(held.get("players", []))
        self.named: dict[str, list[dict]] = held.get("named", {})
        self.zone: str | None = held.get("zone")
        self.zone_change: int = held.get("zone_change", 0)
        self.now: int = held.get("now", 0)
        self.version: int = held.get("version", 0) + 1
        self.changed: dict[int, dict] = {}

    def stored(self) -> str:
        casts = {k: s for k, s in self.casts.items() if self.now - s <= CAST_MEMORY}
        return json.dumps({"open": self.open, "casts": casts, "players": sorted(self.players), "named": self.named, "zone": self.zone, "zone_change": self.zone_change, "now": self.now, "version": self.version})

    def over(self, fight: dict, now: int) -> bool:
        idle = now - fight["last_activity"]
        return idle > IDLE_UNDAMAGED or (idle > IDLE and fight["has_damage"])

    def close(self, name: str) -> None:
        fight = self.open.pop(name)
        fight["closed"] = True
        self.changed[fight["first_line"]] = fight

    def expire(self, now: int) -> None:
        for name in [n for n, f in self.open.items() if self.over(f, now)]:
            self.close(name)

    def fight(self, name: str, line: int, s: int, create: bool = True) -> dict | None:
        if name in self.open and self.over(self.open[name], s):
            self.close(name)
        if name not in self.open:
            if not create:
                return None
            self.open[name] = {"first_line": line, "name": name, "zone": self.zone, "zone_change": self.zone_change, "begin": s, "last_damage": None, "last_activity": s, "dead": False, "closed": False, "removed": False, "has_damage": False, "damage_total": 0, "tanking_total": 0, "taunts": 0}
            if " " not in name:
                self.named.setdefault(name, []).append({"first_line": line, "begin": s, "zone_change": self.zone_change})
        found = self.open[name]
        found["last_activity"] = s
        self.changed[found["first_line"]] = found
        return found

    def damage(self, r: Any) -> None:
        a_npc, a_player, t_npc, t_player = r.actor_npc, r.actor_player, r.target_npc, r.target_player
        if r.is_spell:
            if self.now - self.casts.get(str(r.actor).lower(), -math.inf) > CAST_MEMORY:
                return
            a_npc, a_player = False, True
        if r.actor in self.players:
            a_npc, a_player = False, True
        if r.target in self.players:
            t_npc, t_player = False, True
        if (t_npc and not a_npc) or (a_player and not t_player and not t_npc and not (a_npc and not t_npc)):
            name, dealt = r.target, True
        elif (a_npc and not t_npc) or (t_player and not a_player and not a_npc):
            name, dealt = r.actor, False
        else:
            return
        if name is None:
            return
        fight = self.fight(name, r.line_no, r.s)
        fight["last_damage"], fight["has_damage"] = r.s, True
        fight["damage_total" if dealt else "tanking_total"] += r.amount

    def prove(self, name: str) -> None:
        """A player after all: fights with that name were none."""
        self.players.add(name)
        self.open.pop(name, None)
        for f in self.named.pop(name, []):
            gone = {"name": name, "zone": None, "last_damage": None, "last_activity": f["begin"], "dead": False, "closed": True, "has_damage": False, "damage_total": 0, "tanking_total": 0, "taunts": 0}
            self.changed[f["first_line"]] = gone | f | {"removed": True}

    def line(self, r: Any) -> None:
        self.now = r.s
        if r.role == "damage":
            self.damage(r)
        elif r.role == "taunt":
            if (r.target_npc or r.actor_player) and not r.target_player and r.target is not None and r.target not in self.players:
                self.fight(r.target, r.line_no, r.s)["taunts"] += 1
        elif r.role == "death":
            if r.target is not None and (fight := self.fight(r.target, r.line_no, r.s, create=False)):
                fight["dead"], fight["last_damage"] = True, r.s
                self.close(r.target)
        elif r.role == "zone":
            for name in list(self.open):
                self.close(name)
            self.zone, self.zone_change = r.zone, self.zone_change + 1
        elif r.role == "cast":
            self.casts[r.spell] = r.s
        elif r.role == "proof":
            self.prove(r.proof)

    def wait(self, now: int) -> int | None:
        """Seconds until the next open fight is over, if nothing happens; None without open fights."""
        left = [f["last_activity"] + (IDLE if f["has_damage"] else IDLE_UNDAMAGED) + 1 - now for f in self.open.values()]
        return max(1, min(left)) if left else None

    def rows(self, session_id: str) -> pd.DataFrame:
        names = [x.split()[0] for x in FIGHT.split(", ")]
        rows = [{**f, "session_id": session_id, "version": self.version} for _, f in sorted(self.changed.items())]
        return pd.DataFrame(rows, columns=names).astype({"last_damage": "Int64"})


#: Rows that are Python objects at a time.
STRETCH = 50_000


def in_order(frames: Iterator[pd.DataFrame]) -> tuple[int, Iterator[Any]]:
    """The latest second of a batch and its rows that have a role, by line; others move the clock and aren't kept."""
    latest, kept = [], []
    for frame in frames:
        if len(frame):
            latest.append(int(frame["s"].max()))
        kept.append(frame[frame["role"].notna()])
    rows = pd.concat(kept).sort_values("line_no", kind="stable")

    def each() -> Iterator[Any]:
        for at in range(0, len(rows), STRETCH):
            part = rows.iloc[at : at + STRETCH]
            yield from part.astype(object).where(part.notna(), None).itertuples(index=False)

    return max(latest), each()


def updates(sided: DataFrame, second: float | None = 1.0) -> DataFrame:
    """The fights (FIGHT) that each micro-batch, or a session's silence, changed, opened, closed or took back.

    sided: a stream of events with s and the sides of actor and target.  second is how long a log second of silence
    takes on the wall clock; None is for replays that end, where silence has no meaning.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Session(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            held.now += max(1, math.ceil((time.time() - state.get[1]) / second))
            arrived = time.time()
        else:
            latest, rows = in_order(frames)
            for r in rows:
                held.line(r)
            held.now = max(held.now, latest)
            arrived = time.time()
        held.expire(held.now)
        left = held.wait(held.now)
        if left is not None and second is not None:
            state.setTimeoutDuration(max(1, int(left * second * 1000)))
        state.update((held.stored(), arrived))
        yield held.rows(key[0])

    timer = GroupStateTimeout.NoTimeout if second is None else GroupStateTimeout.ProcessingTimeTimeout
    return steps(sided).groupBy("session_id").applyInPandasWithState(run, FIGHT, "held string, arrived double", "update", timer)


def newest(rows: DataFrame) -> DataFrame:
    """The last version of each fight, without those that were taken back."""
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rows.columns), "version").alias("_row")).select("_row.*").where("not removed")
