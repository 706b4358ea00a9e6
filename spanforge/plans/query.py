"""The query description and its compilation to DataFrames.

A query picks a source, a scope of seconds, dimensions to group by, metrics, filters, a bucket width and whether pets
count for their owners.  The compiled plan joins events with scope units by bucketed equality, aggregates once by the
whole key and second, and rolls the small result up level by level.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import LANDED
from ..functions.timeutil import bucket, moment, seconds
from ..operators import intervals, metrics, segments

HOUR = 3600
NO_STANCE = "(no stance)"
PROGRESSION = ("experience", "faction", "loot", "considers")
#: What a flag filter can ask of a damage row.
FLAGS = ("damageShield", "bane", "headshot", "assassinate", "finishingBlow", "slayUndead")


@dataclass
class Scope:
    fightIds: list[int] | None = None  # none of them and an empty list mean all fights, but progression takes play sessions for none
    timeRanges: list[dict] = field(default_factory=list)
    lastSeconds: int | None = None
    skipFirstSeconds: int | None = None
    maxSeconds: int | None = None
    playedTimeOnly: bool = False
    openFights: bool = False  # the fights that are open when the query runs, or the last one


@dataclass
class Filter:
    dim: str | None = None
    values: list[str] = field(default_factory=list)
    flag: str | None = None
    exclude: bool = False


@dataclass
class QuerySpec:
    source: str = "damage"
    scope: Scope = field(default_factory=Scope)
    groupBy: list[str] = field(default_factory=lambda: ["player"])
    metrics: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    bucketSeconds: int | None = None
    petRollup: bool = True

    @classmethod
    def from_json(cls, text: str) -> QuerySpec:
        """What a client sent; what it left out or sent as null has its default."""
        raw = {k: v for k, v in json.loads(text).items() if v is not None}
        return cls(**{**raw, "scope": Scope(**raw.get("scope", {})), "filters": [Filter(**f) for f in raw.get("filters", [])]})

    def to_json(self) -> str:
        """The same text for equal queries; empty lists are kept where none of them means something else."""
        lean = lambda x: {k: lean(v) for k, v in x.items() if v not in (None, [], {}) or (k in ("fightIds", "groupBy") and v == [])} if isinstance(x, dict) else [lean(v) for v in x] if isinstance(x, list) else x
        return json.dumps(lean(asdict(self)))


@dataclass
class World:
    """What a session offers to queries; events carry s, their second.  The dimension tables are one row a name.

    Fights may be given as a function that finds them, which queries that need none don't call.
    """

    events: DataFrame
    fights: DataFrame | Callable[[], DataFrame]  # id, name, begin, last_damage, last_activity in seconds
    pets: DataFrame  # pet, owner
    npcs: DataFrame  # name
    verified: DataFrame  # name
    owner: str = "You"

    def listed(self) -> DataFrame:
        """The fights, found now if they haven't been."""
        if not isinstance(self.fights, DataFrame):
            self.fights = self.fights()
        return self.fights

    def presence(self) -> DataFrame:
        login = (F.col("kind") == "Zone") & F.coalesce("welcome", F.lit(False))
        # of a second's rows that aren't logins the first says as much as all of them
        few = self.events.groupBy("session_id", "s", F.when(login, F.col("line_no")).alias("_login")).agg(F.min("line_no").alias("line_no"))
        return segments.long_presence(few, ["session_id"], ["s", "line_no"], marker=F.col("_login").isNotNull()).select("b", "e")


def name_table(world: World) -> DataFrame:
    """(name, npc, known, owner): one row for each name that is known to be an enemy, a player or a pet."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = world.npcs.select("name", F.lit(True).alias("npc"), null("boolean").alias("known"), null("string").alias("owner"))
    rows = rows.unionByName(world.verified.select("name", null("boolean").alias("npc"), F.lit(True).alias("known"), null("string").alias("owner")))
    rows = rows.unionByName(world.pets.select(F.col("pet").alias("name"), null("boolean").alias("npc"), null("boolean").alias("known"), "owner"))
    return rows.groupBy("name").agg(*[F.max(c).alias(c) for c in ("npc", "known", "owner")])


def sided(world: World) -> DataFrame:
    """Events with actor_npc, target_npc, target_player and the owner of the actor, by one left join on names a side."""
    e, names = world.events, name_table(world)
    for side in ("actor", "target"):
        e = e.join(names.select(F.col("name").alias(side), *[F.col(c).alias(f"_{side}_{c}") for c in ("npc", "known", "owner")]), side, "left")
        name = F.col(side)
        pet = F.col(f"_{side}_owner").isNotNull() | name.rlike(r"[`']s (pet|warder|familiar)$")
        known = F.coalesce(F.col(f"_{side}_known"), F.lit(False))
        npc = ~known & ~pet & (F.coalesce(F.col(f"_{side}_npc"), F.lit(False)) | name.rlike(r"(?i)^(a|an|the) ") | name.contains(" "))
        e = e.withColumn(f"{side}_npc", F.coalesce(npc, F.lit(False))).withColumn(f"{side}_player", F.coalesce(known | pet, F.lit(False)))
    return e.withColumn("owner", F.coalesce("_actor_owner", "actor"))


def ranges_of(world: World, scope: Scope) -> DataFrame:
    spark = world.events.sparkSession
    at = lambda t: int((datetime.fromisoformat(str(t)) - datetime(1970, 1, 1)).total_seconds())
    return spark.createDataFrame([(i, at(r["begin"]), at(r["end"])) for i, r in enumerate(scope.timeRanges)], "range int, b long, e long")


def open_fights(world: World) -> DataFrame:
    """(id): all open fights, or the last one where none is open."""
    now = world.listed().where("not closed").select("id")
    last = world.listed().orderBy(F.desc("last_activity"), F.desc("id")).limit(1).select("id", F.lit(0).alias("_k"))
    return now.unionByName(last.join(now.limit(1).select(F.lit(0).alias("_k")), "_k", "left_anti").select("id"))


def units(world: World, spec: QuerySpec) -> DataFrame:
    """(name, b, e, n, lo, hi): the seconds that count, with the fight's name where they are fights'.

    The rows are pieces of `intervals.covered`: a row of the log in one counts n times, once for each unit (a fight, what
    the scope leaves of it, a play session) that holds it, and these reach from lo to hi.  Units that overlap many times
    over are not listed.
    """
    scope, source = spec.scope, spec.source
    none = F.lit(None).cast("string")
    alone = lambda found: found.select(none.alias("name"), "b", "e", F.lit(1).cast("long").alias("n"), F.col("b").alias("lo"), F.col("e").alias("hi"))
    if scope.lastSeconds:
        last = world.events.agg(F.max("s").alias("e"))
        return alone(last.where("e is not null").select((F.col("e") - (scope.lastSeconds - 1)).alias("b"), "e"))
    progression = source in PROGRESSION
    if not progression or (not scope.timeRanges and (scope.fightIds is not None or scope.openFights)):
        fights = world.listed().select("id", "name", F.col("begin").alias("b"), F.greatest("last_damage", "begin").alias("e"))
    if scope.timeRanges:
        ranges = ranges_of(world, scope)
        found = ranges.select("range", none.alias("name"), "b", "e")
        if not progression:
            met = fights.alias("f").join(F.broadcast(ranges).alias("r"), (F.col("f.b") <= F.col("r.e")) & (F.col("f.e") >= F.col("r.b")))
            cut = met.select("range", "name", F.greatest("f.b", "r.b").alias("b"), F.least("f.e", "r.e").alias("e"))
            found = cut.unionByName(found.join(cut.select("range").distinct(), "range", "left_anti"))
        found = found.drop("range")
    elif progression and scope.fightIds is None and not scope.openFights:
        found = world.presence().select(none.alias("name"), "b", "e")
    else:
        chosen = fights.join(open_fights(world), "id", "left_semi") if scope.openFights else fights.where(F.col("id").isin(*scope.fightIds)) if scope.fightIds else fights
        found = chosen.select("name", "b", "e")
    played = world.presence() if scope.playedTimeOnly else None
    trimmed = bool(scope.skipFirstSeconds) or scope.maxSeconds is not None
    by_fight = source in ("damage", "tanking")
    if trimmed or not by_fight:
        # of whole seconds the union of all overlaps is what the unions share
        key = lambda df: intervals.merge(df.select("b", "e").withColumn("_k", F.lit(0)), ["_k"])
        union = key(found) if played is None else intervals.intersect(key(found), key(played), ["_k"], HOUR)
        if trimmed:
            union = intervals.trim(union, ["_k"], scope.skipFirstSeconds or 0, scope.maxSeconds)
        if not by_fight:
            return alone(union)
    pieces = intervals.covered(found, ["name"])
    if played is not None:
        pieces = intervals.covered_by_both(pieces, intervals.covered(played, []))
    if trimmed:
        pieces = intervals.covered_by_both(pieces, intervals.covered(union, []))
    return pieces


#: Kind of event and who it counts for, of the sources that aren't damage.
ROUTES = {
    "healing": ("Heal", lambda owner: F.coalesce("actor", "spell", F.lit("Unknown"))), "casts": ("Cast", lambda owner: F.col("actor")), "deaths": ("Death", lambda owner: F.col("target")),
    "experience": ("Experience", lambda owner: F.lit(owner)), "faction": ("Faction", lambda owner: F.col("faction")), "loot": ("Loot", lambda owner: F.col("actor")), "considers": ("Consider", lambda owner: F.col("target")),
}


def sources(world: World, spec: QuerySpec, events: DataFrame) -> list[tuple[DataFrame, DataFrame, list[str], int]]:
    """The source's rows with who they count for, the units that they may fall in, and keys and width of their join.

    Units are the pieces of `units`.  Those of fights join on the enemy's name and the minute, in which there are sixty at
    most; others are few or disjoint and join on the hour.
    """
    scope, source = spec.scope, spec.source
    spans = units(world, spec)
    if source not in ("damage", "tanking"):
        kind, who = ROUTES[source]
        return [(events.where(F.col("kind") == kind).withColumn("who", who(world.owner)), spans.drop("name"), [], HOUR)]
    hits = events.where("kind = 'Damage' and actor is not null" if source == "damage" else "kind = 'Damage'")
    side, other = ("target", "actor") if source == "damage" else ("actor", "target")
    hits = hits.withColumn("who", F.col(other))
    parts = []
    if not scope.lastSeconds:
        named = hits.withColumn("_name", F.col(side)).where("_name is not null")
        parts.append((named, spans.where("name is not null").withColumnRenamed("name", "_name"), ["_name"], intervals.MINUTE))
    if scope.lastSeconds or scope.timeRanges:
        ranged = ~F.coalesce("target_player", F.lit(False)) & ~F.col("actor_npc") & ~F.coalesce("is_spell", F.lit(False)) if source == "damage" else F.col("actor_npc")
        parts.append((hits.where(ranged), spans.where("name is null").drop("name"), [], HOUR))
    return parts


def kind_label() -> Column:
    """The outcome of a hit in the client's spelling (directDamage); those that avoid one keep theirs (Miss)."""
    kind = F.col("damage_kind")
    return F.when(kind.isin(*LANDED), F.concat(F.lower(F.substring(kind, 1, 1)), F.expr("substring(damage_kind, 2)"))).otherwise(kind)


def owner_of_who() -> Column:
    """The owner of the pet that a row counts for, or that one itself."""
    own = F.when(F.col("who") == F.col("actor"), F.col("_actor_owner")).when(F.col("who") == F.col("target"), F.col("_target_owner"))
    return F.coalesce(own, F.col("who"))


def own_side(owner: str) -> Column:
    """Whether the one that a row counts for is the log's owner or a pet of theirs, whose stance the log knows."""
    return F.coalesce(F.lower(owner_of_who()) == owner.lower(), F.lit(False)) | F.coalesce(F.lower("who") == owner.lower(), F.lit(False))


def dimension(dim: str, source: str, owner: str) -> Column:
    kind, none = F.col("kind"), F.lit("Unknown")
    if dim == "player":
        return F.col("who")
    if dim == "character":
        return F.lit(owner)
    if dim == "target":
        other = F.col("target") if source == "damage" else F.col("actor")
        return F.coalesce(F.when(kind == "Damage", other).when(kind == "Heal", F.col("target")).when(kind == "Death", F.col("actor")).when(kind == "Loot", F.col("source")), none)
    if dim == "spell":
        return F.coalesce(
            F.when(kind == "Damage", F.coalesce("sub_type", kind_label())).when(kind.isin("Heal", "Cast"), F.col("spell"))
            .when(kind == "Experience", F.when(F.col("aa_point"), "AA point").when(F.col("party"), "party").otherwise("solo"))
            .when(kind == "Faction", F.when(F.col("capped"), "capped").when(F.col("better"), "up").otherwise("down"))
            .when(kind == "Loot", F.coalesce("item", F.lit("coin"))).when(kind == "Consider", F.col("attitude")),
            none,
        )
    if dim == "damageType":
        return F.coalesce(F.when(kind == "Damage", F.coalesce("school", kind_label())), none)
    if dim == "stance":
        return F.when(own_side(owner), F.coalesce("held", F.lit(NO_STANCE))).otherwise(F.lit("(not you)"))
    return none


def flag(name: str) -> Column:
    """Whether a row is of the flag's kind; only damage is.  An unknown flag is an error, as it would keep or drop everything."""
    if name not in FLAGS:
        raise ValueError(f"unknown flag {name!r}; there are {', '.join(FLAGS)}")
    test = metrics.kind_is("DamageShield") if name == "damageShield" else F.lower("school") == "bane" if name == "bane" else metrics.has(name[0].upper() + name[1:])
    return (F.col("kind") == "Damage") & F.coalesce(test, F.lit(False))


def series_value(source: str) -> Column | None:
    signed = F.when(F.col("capped"), F.lit(0)).otherwise(F.coalesce("delta", F.when(F.col("better"), 1).otherwise(-1)))
    return {"damage": F.col("amount"), "tanking": F.col("amount"), "healing": F.col("amount"), "experience": F.coalesce("percent", F.lit(0.0)), "faction": signed, "loot": F.coalesce("copper", F.lit(0)) / 1000.0}.get(source)


def stance_spans(world: World) -> DataFrame:
    """(held, b, e): the owner's stances from switch to switch, the last one to the log's end; unknown before the first."""
    own = world.events.where((F.col("kind") == "Stance") & (F.lower("actor") == world.owner.lower()))
    whole = world.events.agg(F.min("s").alias("_first"), F.max("s").alias("_last"))
    held = segments.steps(own, ["session_id"], ["line_no"], "stance", keep_repeats=True).crossJoin(F.broadcast(whole))
    known = held.select(F.col("stance").alias("held"), "b", F.coalesce("e", "_last").alias("e"))
    first = held.agg(F.min("b").alias("_b"), F.first("_first").alias("b")).where("b < _b").select(F.lit(NO_STANCE).alias("held"), "b", (F.col("_b") - 1).alias("e"))
    return known.unionByName(first).where("e >= b")


def with_stance(world: World, rows: DataFrame) -> DataFrame:
    """rows with held and the stretch (hb, he) of it, within the play session, at their second."""
    key = lambda df: df.withColumn("_k", F.lit(0))
    pieces = intervals.intersect(key(stance_spans(world)), key(world.presence()), ["_k"]).withColumn("hb", F.col("b")).withColumn("he", F.col("e"))
    # a second that two play sessions share counts for the first
    first = segments.within(rows.select("s").distinct(), pieces, [], ["held", "hb", "he"], HOUR).groupBy("s").agg(F.min(F.struct("hb", "he", "held")).alias("p"))
    seconds_of = first.select("s", "p.held", "p.hb", "p.he")
    return rows.join(seconds_of, "s", "left")


def no_path() -> Column:
    return F.expr("cast(array() as array<string>)")


@dataclass
class Compiled:
    rows: DataFrame  # level, path, label, metrics, rank; level 0 is the total
    series: DataFrame | None  # path, at, value of every node, the total's too


def compile_query(world: World, spec: QuerySpec) -> Compiled:
    names = list(spec.metrics) or list(metrics.DEFAULTS[spec.source])
    stances = "stance" in spec.groupBy or any(f.dim == "stance" for f in spec.filters) or any(n.startswith("stance") for n in names)
    wanted = metrics.needed(names) | ({"total"} if "percentOfTotal" in names else set())
    value = series_value(spec.source) if spec.bucketSeconds else None
    dims: list[str] = []
    for i, dim in enumerate(spec.groupBy):
        dims += [f"d{i}", f"d{i}_actor"] if dim == "player" and spec.petRollup else [f"d{i}"]

    def by_second(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Counters by dims, keys and second: many units that overlap then meet seconds, not every row of them."""
        if stances:
            rows = with_stance(world, rows).withColumn("_own", own_side(world.owner))
        for f in spec.filters:
            if f.flag:
                test = flag(f.flag)
            elif f.values:
                key = owner_of_who() if f.dim == "player" and spec.petRollup else dimension(f.dim, spec.source, world.owner)
                test = key.isin(*f.values)
            else:
                continue
            rows = rows.where(~test if f.exclude else test)
        for i, dim in enumerate(spec.groupBy):
            if dim == "player" and spec.petRollup:
                rows = rows.withColumn(f"d{i}", owner_of_who()).withColumn(f"d{i}_actor", F.col("who"))
            else:
                rows = rows.withColumn(f"d{i}", dimension(dim, spec.source, world.owner))
        summed = [F.sum(value).alias("_v")] if value is not None else []
        return rows.groupBy(*dims, *keys, "s", *(["_own", "hb", "he"] if stances else [])).agg(*metrics.parts(wanted), F.min("line_no").alias("first_seen"), *summed)

    met = [segments.within(by_second(found, keys), spans, keys, ["n", "lo", "hi"], width).withColumn("_name", F.col(keys[0]) if keys else F.lit(None).cast("string")) for found, spans, keys, width in sources(world, spec, sided(world))]
    rows = met[0] if len(met) == 1 else met[0].unionByName(met[1], allowMissingColumns=True)
    # a second's rows count once for each unit that holds it
    copies = metrics.times(wanted, F.col("n")) | ({"_v": F.col("_v") * F.col("n")} if value is not None else {})
    rows = rows.withColumns(copies) if copies else rows
    stretch = F.struct(F.greatest("hb", "lo").alias("b"), F.least("he", "hi").alias("e"))
    touched = [F.collect_set(F.when(F.col("_own"), stretch)).alias("touched")] if stances else []
    # seconds of a group are active up to the next that a unit holds with them; groups are cut at the hours
    hour = Window.partitionBy(*dims, "_name", "_hour").orderBy("s")
    stretches = rows.withColumn("_hour", F.floor(F.col("s") / HOUR)).withColumn("_new", F.when(F.col("s") > F.lag("hi").over(hour), 1).otherwise(0)).withColumn("_stretch", F.sum("_new").over(hour))
    base = stretches.groupBy(*dims, "_name", "_hour", "_stretch").agg(*metrics.merged(wanted), F.min("s").alias("b"), F.max("s").alias("e"), F.max("hi").alias("hi"), F.min("first_seen").alias("first_seen"), *touched)
    for d in [d for d in dims if d.endswith("_actor")]:
        base = flattened(base, dims, d)
    tree = segments.cut(nodes(base, dims).select("path", "label", "_name", "b", "e", "hi", "first_seen", *sorted(wanted & metrics.COUNTERS.keys()), *(["touched"] if stances else [])))
    active = seconds_of_paths(intervals.reached(tree, ["path", "_name"]), "active")
    whole = tree.groupBy("path").agg(*metrics.merged(wanted, final=True), F.min("first_seen").alias("first_seen"), F.max("label").alias("label")).join(active, "path")
    if stances:
        held = seconds_of_paths(tree.select("path", F.explode("touched").alias("t")).select("path", "t.b", "t.e"), "stance")
        whole = whole.join(held, "path", "left").withColumn("stance", F.coalesce("stance", F.lit(0)))
    else:
        whole = whole.withColumn("stance", F.lit(0))
    root = whole.where("size(path) = 0").select(F.col("active").alias("raid"), F.col("stance").alias("stance_scope"), *([F.col("total").alias("root_total")] if "total" in wanted else []))
    c = {n: F.col(n) for n in [*(wanted & metrics.COUNTERS.keys()), "active", "raid", "root_total", "stance", "stance_scope"]}
    valued = whole.join(F.broadcast(root)).select(F.size("path").alias("level"), "path", "label", "first_seen", *[metrics.metric(n, c).alias(n) for n in names])
    parent = Window.partitionBy("level", F.slice("path", 1, F.greatest(F.col("level") - 1, F.lit(0)))).orderBy(F.desc(names[0]), "first_seen")
    ranked = valued.withColumn("rank", F.row_number().over(parent)).drop("first_seen")
    series = None
    if value is not None:
        keyed = rows.withColumn("at", bucket(F.col("s"), spec.bucketSeconds))
        small = keyed.groupBy(*dims, "at").agg(F.sum("_v").alias("value"))
        for d in [d for d in dims if d.endswith("_actor")]:
            small = flattened(small, dims, d)
        series = nodes(small, dims).groupBy("path", "at").agg(F.sum("value").alias("value")).select("path", moment(F.col("at")).alias("at"), "value")
    return Compiled(ranked, series)


def flattened(base: DataFrame, dims: list[str], actor: str) -> DataFrame:
    """base with {actor}_lone: whether the owner before has no actor but itself, so that their level of actors goes."""
    upto = dims[: dims.index(actor)]
    one = base.groupBy(*upto).agg((F.min(actor).eqNullSafe(F.max(actor)) & F.min(actor).eqNullSafe(F.first(upto[-1]))).alias(f"{actor}_lone"))
    named = one.select(*[F.col(k).alias(f"_j_{k}") for k in upto], f"{actor}_lone")
    on = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in upto]
    return base.join(named, on).drop(*[f"_j_{k}" for k in upto])


def nodes(base: DataFrame, dims: list[str]) -> DataFrame:
    """A row for each row and node of the tree that it is in, with path (empty for the total) and label."""
    steps, labels = [no_path()], [no_path()]
    for i, d in enumerate(dims):
        lone = F.col(f"{d}_lone") if d.endswith("_actor") else None
        pets = f"{dims[i + 1]}_lone" if i + 1 < len(dims) and dims[i + 1].endswith("_actor") else None
        label = F.when(F.col(pets), F.col(d)).otherwise(F.concat(d, F.lit(" +Pets"))) if pets else F.col(d)
        for into, value in ((steps, F.col(d)), (labels, label)):
            into.append(F.array(value) if lone is None else F.when(lone, no_path()).otherwise(F.array(value)))
    placed = base.withColumn("_path", F.concat(*steps)).withColumn("_labels", F.concat(*labels))
    levels = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.size("_path"))))
    path, label = F.slice("_path", 1, F.col("_level")), F.when(F.col("_level") == 0, F.lit("Total")).otherwise(F.get("_labels", F.col("_level") - 1))
    return levels.withColumn("path", path).withColumn("label", label)


def seconds_of_paths(stretches: DataFrame, name: str) -> DataFrame:
    return intervals.merge(stretches, ["path"]).groupBy("path").agg(intervals.total().alias(name))


#: The queries that every session offers, by name.
CANNED = {
    "DamageSummary": {"source": "damage", "groupBy": ["player", "spell"]},
    "HealingSummary": {"source": "healing", "groupBy": ["player", "spell"]},
    "TankingSummary": {"source": "tanking", "groupBy": ["player", "spell"]},
    "DpsOverTime": {"source": "damage", "groupBy": ["player"], "metrics": ["total", "dps", "sdps"], "bucketSeconds": 1},
    "DeathLog": {"source": "deaths", "groupBy": ["player", "target"]},
}


def canned(name: str, fight_ids: list[int] | None = None, bucket_seconds: int | None = None) -> QuerySpec:
    """A query of CANNED over some fights (all by default); bucket_seconds is for a series."""
    spec = QuerySpec.from_json(json.dumps(CANNED[name]))
    spec.scope.fightIds = fight_ids
    if spec.bucketSeconds and bucket_seconds:
        spec.bucketSeconds = bucket_seconds
    return spec


def live_meter(world: World) -> QuerySpec:
    """Damage by player over the fights that are open, or the last one."""
    return QuerySpec("damage", Scope(openFights=True), ["player"], ["total", "dps", "sdps", "percentOfTotal"])


def with_seconds(events: DataFrame) -> DataFrame:
    return events.withColumn("s", seconds("ts"))
