"""Indexes learned over many sessions: idempotent samples, robust estimates with grades, exact logarithmic histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments

KEPT_SAMPLES = 200
CROWD_SECONDS = 20
LEAST_CLEAN = 4
HISTOGRAM_TOP = 79


def merge_samples(old: DataFrame, new: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Both without repeats of the same keys and identity: merging twice is merging once."""
    return old.unionByName(new).dropDuplicates([*keys, *identity])


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = KEPT_SAMPLES) -> DataFrame:
    """The first n rows of each key in that order; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def uncrowded(df: DataFrame, keys: list[str], order: list[str], within: int = CROWD_SECONDS, least: int = LEAST_CLEAN) -> DataFrame:
    """df with clean: no neighbour of its key less than `within` seconds away; all rows are clean if fewer than `least` would be."""
    w = Window.partitionBy(*keys).orderBy("s", *order)
    apart = lambda other: other.isNull() | (F.abs(other - F.col("s")) >= within)
    alone = df.withColumn("_alone", apart(F.lag("s").over(w)) & apart(F.lead("s").over(w)))
    enough = F.sum(F.col("_alone").cast("int")).over(Window.partitionBy(*keys)) >= least
    return alone.withColumn("clean", F.col("_alone") | ~enough).drop("_alone")


def nearest_rank(column: str, p: float) -> Column:
    """Nearest-rank percentile: the value at rank ceil(p * n)."""
    return F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY {column}) as bigint)")


def estimates(clean: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, spread and grade of each key's clean samples."""
    found = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[nearest_rank(value, p).alias(f"p{round(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)],
    )
    return found.withColumn("grade", grade(F.col("n"), (F.col("p75") - F.col("p25")) / F.col("p50")))


def grade(n: Column, spread: Column) -> Column:
    return F.when((n >= 10) & (spread <= 0.25), "High").when((n >= 4) & (spread <= 0.5), "Medium").otherwise("Low")


def attack_grade(swings: Column, level: Column) -> Column:
    return F.when((swings >= 200) & level.isNotNull(), "High").when(swings >= 40, "Medium").otherwise("Low")


def log_bucket(x: Column) -> Column:
    """Four buckets an octave, from 0 to 79."""
    return F.least(F.greatest(F.floor(F.log2(x) * 4), F.lit(0)), F.lit(HISTOGRAM_TOP)).cast("int")


def bucket_value(b: Column) -> Column:
    return F.round(F.pow(F.lit(2.0), (b + 0.5) / 4)).cast("long")


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value) > 0).groupBy(*keys, log_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(hist: DataFrame, keys: list[str], p: float) -> DataFrame:
    """(keys, value): nearest-rank quantile of a sparse histogram; a key has 80 buckets at most."""
    w = Window.partitionBy(*keys)
    so_far = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.withColumn("_so_far", so_far).withColumn("_rank", F.ceil(F.lit(p) * F.sum("n").over(w)))
    return ranked.where("_so_far >= _rank").groupBy(*keys).agg(bucket_value(F.min("bucket")).alias("value"))


def harvest_kills(fights: DataFrame, watermark: str | None = None) -> DataFrame:
    """Kill samples of finished fights: dead, damaged, in a known zone, after the watermark."""
    done = fights.where("dead and has_damage and damage_total > 0 and zone is not null")
    if watermark is not None:
        done = done.where(F.col("last_damage") > F.lit(watermark).cast("timestamp_ntz"))
    return done.select(F.lower("name").alias("mob_key"), F.lower("zone").alias("zone_key"), "difficulty", "name", "zone", F.col("damage_total").alias("damage"), F.col("last_damage").alias("killed_at"))


COUNTS = ("swings", "landed", "misses", "dodges", "parries", "blocks", "absorbs", "invulnerable", "total")
AVOIDANCES = {"misses": "Miss", "dodges": "Dodge", "parries": "Parry", "blocks": "Block", "absorbs": "Absorb", "invulnerable": "Invulnerable"}
#: Skills of damage without a sub type; those of other kinds are "Other".
UNNAMED = {"DamageShield": "Damage shield", "DirectDamage": "Spell", "DamageOverTime": "Damage over time", "Melee": "Melee"}
QUANTILES = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def attack_tallies(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, skill, bucket, spell, counts, max_hit, min_hit): tallies of damage rows by skill and histogram bucket.

    hits has damage_kind, sub_type and amount.  A skill is the sub type or, without one, a name for the kind.  Only melee attempts
    are swings; an attack lands if its amount is positive.  What didn't land has no bucket.  A skill with any spell
    damage is a spell.  A null kind counts for nothing.
    """
    kind, amount = F.coalesce("damage_kind", F.lit("")), F.coalesce("amount", F.lit(0))
    spell = kind.isin("DirectDamage", "DamageOverTime", "DamageShield", "Other")
    landed = (spell | (kind == "Melee")) & (amount > 0)
    unnamed = F.coalesce(*[F.when(kind == k, name) for k, name in UNNAMED.items()], F.lit("Other"))
    skill = F.coalesce(F.nullif("sub_type", F.lit("")), unnamed).alias("skill")
    return hits.groupBy(*keys, skill, F.when(landed, log_bucket(amount)).alias("bucket")).agg(
        F.bool_or(spell).alias("spell"), F.count_if(~spell & (kind != "")).alias("swings"), F.count_if(landed).alias("landed"),
        *[F.count_if(kind == k).alias(name) for name, k in AVOIDANCES.items()], F.sum(F.when(landed, amount).otherwise(0)).alias("total"),
        F.max(F.when(landed, amount)).alias("max_hit"), F.min(F.when(landed, amount)).alias("min_hit"),
    )


def merge_tallies(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and histograms add, extremes carry over, a spell in any part is a spell; the parts' shape is kept."""
    return parts.groupBy(*keys, "skill", "bucket").agg(
        F.bool_or("spell").alias("spell"), *[F.sum(c).alias(c) for c in COUNTS], F.max("max_hit").alias("max_hit"), F.min("min_hit").alias("min_hit")
    )


def tally_summary(tallies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts, extremes, avg_hit, p10, median, p90) over a key's skills; without a hit these are 0.

    Tallies add up by bucket first, so a key has 81 rows at most when its quantiles are ranked.
    """
    cells = tallies.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("max_hit").alias("max_hit"), F.min("min_hit").alias("min_hit"))
    w = Window.partitionBy(*keys)
    so_far = F.sum("landed").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("_so_far", so_far).withColumn("_n", F.sum("landed").over(w))
    at = lambda p: F.min(F.when(F.col("_so_far") >= F.ceil(F.lit(p) * F.col("_n")), F.col("bucket")))
    found = ranked.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.coalesce(F.max("max_hit"), F.lit(0)).alias("max_hit"), F.coalesce(F.min("min_hit"), F.lit(0)).alias("min_hit"),
        *[F.coalesce(bucket_value(at(p)), F.lit(0)).alias(name) for name, p in QUANTILES.items()],
    )
    return found.withColumn("avg_hit", F.when(F.col("landed") > 0, F.col("total") / F.col("landed")).otherwise(0.0))


def attack_estimates(tallies: DataFrame, keys: list[str], level: str) -> DataFrame:
    """One row for each key: sizes and rates of its melee, its totals with spells, and a grade of the melee hits.

    level is one of the keys.  A key with nothing but spells has zeros for its melee.
    """
    tallies = tallies.withColumn("spell", F.bool_or("spell").over(Window.partitionBy(*keys, "skill")))
    # spells take part with nothing, so that their keys stay
    melee = tallies.select(*keys, F.when(~F.col("spell"), F.col("bucket")).alias("bucket"), *[F.when(F.col("spell"), 0).otherwise(F.col(c)).alias(c) for c in COUNTS], *[F.when(~F.col("spell"), F.col(c)).alias(c) for c in ("max_hit", "min_hit")])
    every = tallies.groupBy(*keys).agg(F.sum("landed").alias("all_landed"), F.sum("total").alias("all_total"), F.sum(F.when(F.col("spell"), F.col("total")).otherwise(0)).alias("spell_total"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    both = tally_summary(melee, keys).alias("m").join(every.alias("a"), same).select("m.*", "a.all_landed", "a.all_total", "a.spell_total")
    rate = lambda c: F.when(F.col("swings") > 0, 100.0 * c / F.col("swings")).otherwise(0.0)
    rates = {"hit_rate": F.col("landed"), "miss_rate": F.col("misses"), "dodge_rate": F.col("dodges"), "parry_rate": F.col("parries"), "block_rate": F.col("blocks"), "absorb_rate": F.col("absorbs") + F.col("invulnerable")}
    return both.select("*", *[rate(c).alias(name) for name, c in rates.items()], attack_grade(F.col("landed"), F.col(level)).alias("grade"))


def newest_evidence(df: DataFrame) -> DataFrame:
    """Last seen first, then the one of most evidence, then by name whatever its case."""
    return df.orderBy(F.desc("last_seen"), F.desc("landed"), F.lower("mob"))


def first_arrivals(samples: DataFrame, keys: list[str], stamp: str, order: list[str]) -> DataFrame:
    """One sample for each key and fight start, the first to arrive; a second defender at the same key and start is dropped."""
    return samples.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, stamp).orderBy(*order))).where("_nth = 1").drop("_nth")


#: What an attack record is kept by, and the fight starts that it remembers.
ATTACK_KEY = ("mob_key", "zone_key", "difficulty", "tier", "defender_level")
FIGHTS_PER_KEY = 500


def counted(named: DataFrame, own: DataFrame) -> DataFrame:
    """Of fights that begin at once, the one that `merge_attacks` counts, and _who it counts of it, where no levels tell defenders apart.

    A second of an enemy's hits is one row here, so fights that overlap meet seconds and not every hit in them.
    """
    hits = named.groupBy("mob_key", "s").agg(F.min("line_no").alias("_line"), F.min_by("_who", "line_no").alias("_who"))
    met = segments.within(hits, own, ["mob_key"], ["zone_key", "difficulty", "tier", "stamp", "fight", "mob", "ends"], 60)
    one = met.groupBy("mob_key", "zone_key", "difficulty", "tier", "stamp").agg(F.min(F.struct("fight", "_line", "_who", "mob", "ends")).alias("_one"))
    return one.select("mob_key", "zone_key", "difficulty", "tier", "stamp", "_one.fight", "_one._who", "_one.mob", F.col("stamp").alias("b"), F.col("_one.ends").alias("e"))


def harvest_attacks(sided: DataFrame, fights: DataFrame, levels: DataFrame | None = None, since: int | None = None, every: bool = True) -> DataFrame:
    """Tallies (as of `attack_tallies`) by ATTACK_KEY, stamp, fight, defender and skill: what closed fights' enemies did.

    A sample is a fight and a defender that isn't an enemy; its hits are those of the fight's enemy (whatever its case)
    from the fight's begin to its last damage.  Open fights, fights in no known zone and, with since, those that ended by
    then are left out.  fights: id, name, begin, last_damage, closed, zone and, where known, difficulty and tier;
    levels: (name, s, line_no, level, stated), from which the defender's level at the fight's begin is taken.  Unless
    every, samples that `merge_attacks` would leave out of this harvest aren't made, where there are no levels.
    """
    done = fights.where("closed and last_damage is not null and length(zone) > 0")
    if since is not None:
        done = done.where(F.col("last_damage") > since)
    value = lambda c, kind: F.col(c).cast(kind) if c in fights.columns else F.lit(None).cast(kind)
    own = done.select(F.lower("name").alias("mob_key"), F.lower("zone").alias("zone_key"), value("difficulty", "int").alias("difficulty"), value("tier", "string").alias("tier"), F.col("name").alias("mob"), F.col("id").alias("fight"), F.col("begin").alias("stamp"), F.col("begin").alias("b"), F.col("last_damage").alias("e"))
    hits = sided.where((F.col("kind") == "Damage") & (F.length("actor") > 0) & ~F.coalesce("is_spell", F.lit(False)) & ~F.col("target_npc"))
    named = hits.select(F.lower("actor").alias("mob_key"), F.col("target").alias("defender"), F.lower("target").alias("_d"), "line_no", "s", "damage_kind", "sub_type", "amount")
    fields = ["zone_key", "difficulty", "tier", "mob", "fight", "stamp"]
    if every or levels is not None:
        met = segments.within(named, own, ["mob_key"], fields, 300).drop("b", "e")
    else:
        named = named.withColumn("_who", F.coalesce(F.concat(F.lit("+"), "_d"), F.lit("")))
        met = segments.within(named, counted(named, own.withColumn("ends", F.col("e"))), ["mob_key", "_who"], fields, 300).drop("b", "e", "_who")
    sample = ["mob_key", *fields, "_d"]
    first = met.groupBy(*sample).agg(F.min("line_no").alias("first_line"), F.min_by("defender", "line_no").alias("defender"))
    if levels is None:
        first = first.withColumn("defender_level", F.lit(None).cast("int"))
    else:
        at = first.withColumn("s", F.col("stamp")).withColumn("name", F.col("_d")).withColumn("line_no", F.lit(2**62))
        first = segments.level_as_of(at, levels.withColumn("name", F.lower("name")), ["name"], ["line_no"]).withColumnRenamed("level", "defender_level").drop("s", "name", "line_no")
    tallies = attack_tallies(met, sample)
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in sample]
    both = tallies.alias("t").join(first.alias("f"), same)
    return both.select(*[f"f.{c}" for c in (*ATTACK_KEY, "mob", "stamp", "fight", "defender", "first_line")], *[f"t.{c}" for c in tallies.columns if c not in sample])


def merge_attacks(samples: DataFrame, fights: DataFrame | None = None, tallies: DataFrame | None = None, remembered: int = FIGHTS_PER_KEY) -> tuple[DataFrame, DataFrame]:
    """(fights, tallies) after a harvest: (ATTACK_KEY, stamps) and tallies by ATTACK_KEY, skill and bucket.

    A key counts one sample for each fight start: the first by fight and line, of new ones as of those it remembers.  It
    remembers the newest starts; with so many of them, a start older than all is taken for one that has been counted.
    Samples arrive by start, so what is accepted doesn't change which later ones are: merging twice is merging once.
    """
    key = list(ATTACK_KEY)
    own = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    starts = samples.groupBy(*key, "stamp").agg(F.min(F.struct("fight", "first_line")).alias("_one"))
    if fights is not None:
        held = fights.select(*key, "stamps")
        met = starts.alias("n").join(held.alias("h"), own("n", "h"), "left").select("n.*", F.coalesce("h.stamps", F.expr("cast(array() as array<bigint>)")).alias("_held"))
        full = F.size("_held") >= remembered
        starts = met.where(~F.array_contains("_held", F.col("stamp")) & (~full | (F.col("stamp") >= F.array_min("_held")))).drop("_held")
    taken = samples.alias("s").join(starts.alias("o"), [*own("s", "o"), F.col("s.stamp") == F.col("o.stamp"), F.col("s.fight") == F.col("o._one.fight"), F.col("s.first_line") == F.col("o._one.first_line")]).select("s.*")
    shape = [*key, "skill", "bucket", "spell", *COUNTS, "max_hit", "min_hit"]
    rows = taken.select(*shape) if tallies is None else taken.select(*shape).unionByName(tallies.select(*shape))
    stamps = starts.select(*key, "stamp")
    if fights is not None:
        stamps = stamps.unionByName(fights.select(*key, F.explode("stamps").alias("stamp")))
    kept = newest(stamps, key, [F.desc("stamp")], remembered).groupBy(*key).agg(F.sort_array(F.collect_list("stamp")).alias("stamps"))
    return kept, merge_tallies(rows, key)


ITEM_SUFFIX = r"( \(Exaltation\)| \+\d+)+$"


def item_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, ITEM_SUFFIX, ""))


def item_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(item_name(c), r"\s+", " "))


def item_registry(observations: DataFrame) -> DataFrame:
    """One row for each item: observations has name, seen, source_bit, looted, sold, bought and from_file (its casing wins)."""
    return observations.groupBy(item_key(F.col("name")).alias("key")).agg(
        F.max_by(item_name(F.col("name")), F.struct(F.col("from_file").cast("int"), F.col("seen"))).alias("name"),
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.bit_or("source_bit").alias("sources"),
        *[F.sum(c).alias(c) for c in ("looted", "sold", "bought")],
    )


def first_names(df: DataFrame, keys: list[str], name: str, order: list[str], most: int = 8) -> DataFrame:
    """(keys, names): the first `most` names of each key in order of arrival, told apart without regard to case."""
    once = df.where(F.col(name).isNotNull()).groupBy(*keys, F.lower(name).alias("_low")).agg(F.min(F.struct(*order, F.col(name).alias("_name"))).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[f"_first.{c}" for c in order], "_low"))
    kept = once.withColumn("_nth", place).where(F.col("_nth") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_first._name"))), lambda x: x["_name"]).alias("names"))


def observed_levels(considers: DataFrame, target: str = "target", level: str = "level") -> DataFrame:
    """(target, levels): the distinct levels that considers showed, ascending; targets without one are left out."""
    return considers.where(F.col(level).isNotNull() & F.col(target).isNotNull()).groupBy(target).agg(F.array_sort(F.collect_set(level)).alias("levels"))
