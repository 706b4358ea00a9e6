"""Counters, as mergeable aggregates of event rows, and the metrics that are formulas over them.

A query builds only the counters that its metrics read: `needed` finds them by evaluating the formulas once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.schema import AVOIDED, LANDED, MODIFIERS  # noqa: F401
from ..functions.timeutil import ratio

#: Attacks that flurry rates are measured against, and the bow.
REGULAR_MELEE = ("Bites", "Claws", "Crushes", "Pierces", "Punches", "Slashes", "Hits")
BOW = "Shoots"


def has(*names: str) -> Column:
    return F.col("modifiers").bitwiseAND(F.lit(sum(MODIFIERS[n] for n in names))) != 0


def kind_is(*kinds: str) -> Column:
    return F.col("damage_kind").isin(*kinds)



def damage() -> Column:
    return F.col("kind") == "Damage"


def heal() -> Column:
    return F.col("kind") == "Heal"


def landed() -> Column:
    return (damage() & kind_is(*LANDED)) | heal()


def melee() -> Column:
    return damage() & kind_is("Melee")


def attempt() -> Column:
    return damage() & (kind_is("Melee") | (kind_is(*AVOIDED) & F.col("sub_type").isNotNull()))


def xp() -> Column:
    return F.col("kind") == "Experience"


def standing() -> Column:
    return F.col("kind") == "Faction"


@dataclass(frozen=True)
class Counter:
    """how: the aggregate that merges parts; over: the value of a row (null where the row has none)."""

    how: str
    over: Callable[[], Column]


def count_if(test: Callable[[], Column]) -> Counter:
    return Counter("sum", lambda: F.when(test(), F.lit(1)).otherwise(F.lit(0)).cast("long"))


def sum_if(test: Callable[[], Column], value: Callable[[], Column]) -> Counter:
    return Counter("sum", lambda: F.when(test(), value()).otherwise(F.lit(0)))


def amount() -> Column:
    return F.col("amount")


COUNTERS: dict[str, Counter] = {
    "total": sum_if(landed, amount),
    "hits": count_if(landed),
    "max_hit": Counter("max", lambda: F.when(landed(), amount())),
    "min_hit": Counter("min", lambda: F.when(landed() & (amount() > 0), amount())),
    "extra": sum_if(heal, lambda: F.col("potential") - amount()),
    "max_potential": Counter("max", lambda: F.when(heal(), F.col("potential"))),
    "hot_hits": count_if(lambda: heal() & F.col("over_time")),
    "crit_hits": count_if(lambda: landed() & has("Critical")),
    "crit_total": sum_if(lambda: landed() & has("Critical"), amount),
    "lucky_hits": count_if(lambda: landed() & has("Lucky")),
    "lucky_total": sum_if(lambda: landed() & has("Lucky"), amount),
    "twincast_hits": count_if(lambda: landed() & has("Twincast")),
    "twincast_direct": count_if(lambda: damage() & kind_is("DirectDamage") & has("Twincast")),
    "twincast_dot": count_if(lambda: damage() & kind_is("DamageOverTime") & has("Twincast")),
    "spell_hits": count_if(lambda: damage() & kind_is("DirectDamage", "DamageOverTime")),
    "melee_hits": count_if(melee),
    "melee_attempts": count_if(attempt),
    "regular_hits": count_if(lambda: melee() & F.col("sub_type").isin(*REGULAR_MELEE)),
    "bow_hits": count_if(lambda: melee() & (F.col("sub_type") == BOW)),
    "flurry": count_if(lambda: melee() & has("Flurry")),
    "rampage": count_if(lambda: melee() & has("Rampage", "WildRampage")),
    "riposte": count_if(lambda: melee() & has("Riposte")),
    "strikethrough": count_if(lambda: melee() & has("Strikethrough")),
    "double_bow": count_if(lambda: melee() & has("DoubleBowShot")),
    "assassinate": count_if(lambda: landed() & has("Assassinate")),
    "headshot": count_if(lambda: landed() & has("Headshot")),
    "finishing_blow": count_if(lambda: landed() & has("FinishingBlow")),
    "slay_undead": count_if(lambda: landed() & has("SlayUndead")),
    **{f"{k.lower()}_count": count_if(lambda k=k: attempt() & kind_is(k)) for k in AVOIDED},
    "deaths": count_if(lambda: F.col("kind") == "Death"),
    **{f"cast_{k.lower()}": count_if(lambda k=k: (F.col("kind") == "Cast") & (F.col("cast_kind") == k)) for k in ("Begin", "Interrupted", "Fizzle")},
    "xp_percent": sum_if(lambda: xp() & ~F.col("aa_point"), lambda: F.coalesce("percent", F.lit(0.0))),
    "xp_gains": count_if(lambda: xp() & ~F.col("aa_point")),
    "aa_points": count_if(lambda: xp() & F.col("aa_point")),
    "faction_net": sum_if(lambda: standing() & ~F.col("capped"), lambda: F.coalesce("delta", F.when(F.col("better"), 1).otherwise(-1)).cast("long")),
    "faction_ups": count_if(lambda: standing() & ~F.col("capped") & F.col("better")),
    "faction_downs": count_if(lambda: standing() & ~F.col("capped") & ~F.col("better")),
    "faction_capped": count_if(lambda: standing() & F.col("capped")),
    "loots": sum_if(lambda: (F.col("kind") == "Loot") & F.col("item").isNotNull(), lambda: F.col("quantity").cast("long")),
    "copper": sum_if(lambda: F.col("kind") == "Loot", lambda: F.coalesce("copper", F.lit(0))),
    "considers": count_if(lambda: F.col("kind") == "Consider"),
    "con_level": Counter("max", lambda: F.when(F.col("kind") == "Consider", F.col("level"))),
}

AVOIDANCES = ("miss_count", "dodge_count", "parry_count", "block_count", "invulnerable_count", "absorb_count")


def _percent(over: str, under: str):
    return lambda c: ratio(c[over], c[under], 100.0)


def _share_undefended(c):
    left = c["melee_attempts"]
    for a in AVOIDANCES:
        left = left - c[a]
    return ratio(left, c["melee_attempts"], 100.0)


def _accuracy(c):
    under = c["melee_attempts"]
    for a in AVOIDANCES[1:]:
        under = under - c[a]
    return ratio(c["melee_hits"], under, 100.0)


#: Formulas over counters and over active (own seconds), raid (root's seconds), root_total, stance (own) and stance_scope.
METRICS: dict[str, Callable[[dict[str, Column]], Column]] = {
    "stanceSeconds": lambda c: c["stance"],
    "stanceDps": lambda c: ratio(c["total"], c["stance"]),
    "stanceUptime": lambda c: ratio(c["stance"], c["stance_scope"], 100.0),
    "total": lambda c: c["total"],
    "extra": lambda c: c["extra"],
    "potential": lambda c: c["total"] + c["extra"],
    "hits": lambda c: c["hits"],
    "critHits": lambda c: c["crit_hits"],
    "luckyHits": lambda c: c["lucky_hits"],
    "twincastHits": lambda c: c["twincast_hits"],
    "maxHit": lambda c: c["max_hit"],
    "minHit": lambda c: c["min_hit"],
    "maxPotentialHit": lambda c: c["max_potential"],
    "activeSeconds": lambda c: c["active"],
    "raidSeconds": lambda c: c["raid"],
    "dps": lambda c: ratio(c["total"], c["active"]),
    "sdps": lambda c: ratio(c["total"], c["raid"]),
    "pdps": lambda c: ratio(c["total"] + c["extra"], c["active"]),
    "avgHit": lambda c: ratio(c["total"], c["hits"]),
    "avgCrit": lambda c: ratio(c["crit_total"] - c["lucky_total"], c["crit_hits"] - c["lucky_hits"]),
    "avgLucky": lambda c: ratio(c["lucky_total"], c["lucky_hits"]),
    "critRate": _percent("crit_hits", "hits"),
    "luckyRate": _percent("lucky_hits", "crit_hits"),
    "twincastRate": lambda c: F.least(F.lit(100.0), ratio(2 * c["twincast_direct"] + c["twincast_dot"], c["spell_hits"], 100.0)),
    "flurryRate": _percent("flurry", "regular_hits"),
    "rampageRate": _percent("rampage", "melee_hits"),
    "riposteRate": _percent("riposte", "melee_hits"),
    "doubleBowRate": _percent("double_bow", "bow_hits"),
    "strikethroughRate": _percent("strikethrough", "melee_hits"),
    "meleeHitRate": _percent("melee_hits", "melee_attempts"),
    "meleeAccuracy": _accuracy,
    "undefendedRate": _share_undefended,
    "overhealRate": lambda c: ratio(c["extra"], c["total"] + c["extra"], 100.0),
    "percentOfTotal": lambda c: ratio(c["total"], c["root_total"], 100.0),
    "meleeAttempts": lambda c: c["melee_attempts"],
    "misses": lambda c: c["miss_count"],
    "dodges": lambda c: c["dodge_count"],
    "parries": lambda c: c["parry_count"],
    "blocks": lambda c: c["block_count"],
    "absorbs": lambda c: c["absorb_count"],
    "invulnerable": lambda c: c["invulnerable_count"],
    "hotHits": lambda c: c["hot_hits"],
    "deaths": lambda c: c["deaths"],
    "casts": lambda c: c["cast_begin"],
    "interrupts": lambda c: c["cast_interrupted"],
    "fizzles": lambda c: c["cast_fizzle"],
    "taunts": lambda c: F.lit(0),
    "xpPercent": lambda c: c["xp_percent"],
    "xpPerHour": lambda c: ratio(c["xp_percent"], c["raid"], 3600.0),
    "xpGains": lambda c: c["xp_gains"],
    "aaPoints": lambda c: c["aa_points"],
    "factionNet": lambda c: c["faction_net"],
    "factionUps": lambda c: c["faction_ups"],
    "factionDowns": lambda c: c["faction_downs"],
    "factionCapped": lambda c: c["faction_capped"],
    "loots": lambda c: c["loots"],
    "platinum": lambda c: c["copper"] / F.lit(1000.0),
    "platPerHour": lambda c: ratio(c["copper"], c["raid"], 3.6),
    "considers": lambda c: c["considers"],
    "conLevel": lambda c: c["con_level"],
}

#: Metrics of a query that names none; the first ranks.
DEFAULTS = {
    "damage": ("total", "dps", "sdps", "percentOfTotal", "hits", "avgHit", "maxHit", "critRate", "luckyRate", "twincastRate", "activeSeconds"),
    "healing": ("total", "extra", "potential", "overhealRate", "dps", "percentOfTotal", "hits", "avgHit", "maxHit", "critRate", "activeSeconds"),
    "tanking": ("total", "dps", "percentOfTotal", "hits", "meleeAttempts", "undefendedRate", "avgHit", "maxHit", "activeSeconds"),
    "casts": ("casts", "interrupts", "fizzles"),
    "deaths": ("deaths",),
    "experience": ("xpPercent", "xpPerHour", "xpGains", "aaPoints"),
    "faction": ("factionNet", "factionUps", "factionDowns", "factionCapped"),
    "loot": ("loots", "platinum", "platPerHour"),
    "considers": ("considers", "conLevel"),
}


def metric(name: str, c: dict[str, Column]) -> Column:
    """The metric over counters c; a name outside the catalog is 0."""
    return METRICS[name](c) if name in METRICS else F.lit(0.0)


def needed(names: list[str]) -> set[str]:
    """What the formulas of these metrics read."""
    seen: set[str] = set()

    class Asked(dict):
        def __missing__(self, key: str) -> Column:
            seen.add(key)
            return F.lit(1)

    for name in names:
        metric(name, Asked())
    return seen


def parts(names: set[str]) -> list[Column]:
    """Counters as aggregates of event rows."""
    return [getattr(F, COUNTERS[n].how)(COUNTERS[n].over()).alias(n) for n in sorted(names & COUNTERS.keys())]


def times(names: set[str], n: Column) -> dict[str, Column]:
    """Counters of n copies of the same rows; the largest and smallest are those of one."""
    return {c: F.col(c) * n for c in sorted(names & COUNTERS.keys()) if COUNTERS[c].how == "sum"}


def merged(names: set[str], final: bool = False) -> list[Column]:
    """Counters as aggregates of counters; final ones are never null."""
    out = []
    for n in sorted(names & COUNTERS.keys()):
        c = getattr(F, COUNTERS[n].how)(n)
        out.append((F.coalesce(c, F.lit(0)) if final else c).alias(n))
    return out
