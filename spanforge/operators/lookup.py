"""Reference lookups: normalised names, ranked search, variants by level, bands, maps and shortest routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import cut


def npc_key(c: Column) -> Column:
    """Name without a leading article and outer blanks, in lower case; an article alone stays."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"(?i)^(an|a|the)\s+(?=\S)", "")))


def zone_key(c: Column) -> Column:
    """Letters and digits in lower case, without a leading "the"."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(plain.rlike("^the."), F.substring(plain, 4, 1 << 20)).otherwise(plain)


def split_level(c: Column) -> Column:
    """struct(name, level) of "name (level)"; level is null without a positive number at the end."""
    level = F.regexp_extract(c, r"\((\d{1,9})\)\s*$", 1).try_cast("int")
    found = level > 0
    return F.struct(F.when(found, F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""))).otherwise(F.trim(c)).alias("name"), F.when(found, level).alias("level"))


def build_index(npcs: DataFrame) -> DataFrame:
    """(key, name, variants): an articled display name is preferred; variants by level, unknown levels last."""
    variant = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("order"), "id", "level")
    return npcs.groupBy(npc_key(F.col("name")).alias("key")).agg(
        F.min_by("name", F.struct((~F.lower("name").rlike(r"^(an|a|the) ")).cast("int"), "id")).alias("name"),
        F.transform(F.array_sort(F.collect_list(variant)), lambda v: F.struct(v["level"].alias("level"), v["id"].alias("id"))).alias("variants"),
    )


def resolve_variant(observed: DataFrame, variants: DataFrame, keys: list[str], level: str = "level", observed_level: str = "observed", order: str = "id") -> DataFrame:
    """observed with the variant of its key whose level is nearest; the first of equals; exact if at most 2 away."""
    apart = F.abs(F.col(level) - F.col(observed_level))
    best = observed.join(variants, keys).groupBy(*observed.columns).agg(F.min(F.struct(apart.alias("apart"), F.col(order).alias("variant"), F.col(level).alias("level"))).alias("v"))
    return best.select(*observed.columns, "v.variant", "v.level", "v.apart", (F.col("v.apart") <= 2).alias("exact"))


def one_per_level(npcs: DataFrame, keys: list[str]) -> DataFrame:
    """The first variant of each level; all of unknown level."""
    w = Window.partitionBy(*keys, "level").orderBy("id")
    return npcs.withColumn("_nth", F.row_number().over(w)).where("_nth = 1 or level is null").drop("_nth")


def ranked_search(df: DataFrame, key: str, query: str, limit: int, band: tuple[int, int] | None = None, level: str = "level") -> DataFrame:
    """Rows whose key is, begins with or holds the query, in this order, then by key and by the other columns from the left.

    Rows of one key thus have one order, whatever the limit cuts; an empty query needs a band.
    """
    query = query.strip().lower()
    if not query and band is None:
        return df.withColumn("rank", F.lit(0)).limit(0)
    rank = F.when(F.col(key) == query, 0).when(F.col(key).startswith(query), 1).when(F.col(key).contains(query), 2)
    found = df.withColumn("rank", rank).where("rank is not null")
    if band is not None:
        found = found.where(F.col(level).between(*band))
    return found.orderBy("rank", key, *[c for c in df.columns if c != key]).limit(limit)


def quartile_band(df: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """(keys, n, low, high): values at index floor(n/4) and floor(3n/4) of the sorted values, for keys with enough of them.

    Ranks come from value counts, so a key is never gathered whole.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("n", F.sum("c").over(w)).withColumn("to", F.sum("c").over(w.orderBy(value)))
    at = lambda f: F.min(F.when(F.col("to") > F.floor(F.lit(f) * F.col("n")), F.col(value)))
    return ranked.where(F.col("n") >= least).groupBy(*keys, "n").agg(at(0.25).alias("low"), at(0.75).alias("high"))


def band(c: Column, bounds: list[tuple[int, int, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for low, high, name in reversed(bounds):
        out = F.when(c.between(low, high), F.lit(name)).otherwise(out)
    return out


def destinations(labels: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, destination): what exit labels lead to.

    "to X" and "from X" name X; another label must begin with a capital.  Text from a bracket on goes; slashes, commas,
    "or", "and" and ampersands part several; parts of two letters or fewer go.
    """
    led = F.regexp_extract(label, r"(?i)\b(?:to|from)\s+(.+)$", 1)
    named = F.when(led != "", led).when(F.col(label).rlike(r"^\p{Lu}"), F.col(label))
    parts = F.split(F.regexp_replace(named, r"\(.*$", ""), r"\s*(?:/|,|&|\bor\b|\band\b)\s*")
    return labels.select(*keys, F.explode(parts).alias("p")).select(*keys, F.trim("p").alias("destination")).where("length(destination) > 2")


def routes(edges: DataFrame, start: str, allowed: DataFrame | None = None) -> DataFrame:
    """(node, hops, via, path): the way of fewest hops from start over undirected edges (a, b), of equally short ones the
    first in the ordinal order of its nodes; via is the node before the last.

    allowed (node): the nodes that a way may use, its ends included; without it, all.  One frontier join a hop, small
    against what is reached so far; it stops when nothing new is reached.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    if allowed is not None:
        for end in ("a", "b"):
            both = both.join(allowed.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    spark = edges.sparkSession
    reached = spark.createDataFrame([(start, 0, [start])], "node string, hops int, path array<string>")
    if allowed is not None:
        reached = reached.join(allowed.select("node").distinct(), "node", "left_semi")
    frontier, hops = reached, 0
    while True:
        hops += 1
        step = frontier.join(both, frontier.node == both.a).select(F.col("b").alias("node"), "path")
        fresh = step.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(fresh.select("node", F.lit(hops).alias("hops"), F.concat("path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if hops % 16 == 0:  # a long way's union of frontiers is kept shallow
            reached = cut(reached)
    return reached.select("node", "hops", F.get("path", F.size("path") - 2).alias("via"), "path")


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


def strokes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each colour as one array of six coordinates each."""
    packed = F.array("x1", "y1", "z1", "x2", "y2", "z2")
    return lines.groupBy(*keys, "r", "g", "b").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", packed.alias("p")))), lambda x: x["p"])).alias("stroke"))


def era_of(zones: DataFrame, bands: DataFrame, overrides: DataFrame) -> DataFrame:
    """zones (key, id) with their era: an override's, else the band of the lowest id, else null; spanning tells more than one band."""
    low = zones.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    placed = low.join(F.broadcast(bands), (F.col("low") >= F.col("first")) & (F.col("low") <= F.col("last")), "left")
    return placed.join(overrides.withColumnRenamed("era", "_own"), "key", "left").select("key", F.coalesce("_own", "era").alias("era"), (F.col("high") > F.col("last")).alias("spanning"))


def shard_of(npc_id: Column) -> Column:
    """The zone that an NPC's id belongs to."""
    return F.floor(npc_id / 1000).cast("long")


def browse_rows(index: DataFrame) -> DataFrame:
    """Rows of build_index as they are listed: lowest and highest known level (null if none is known) and number of variants."""
    known = F.filter(F.transform("variants", lambda v: v["level"]), lambda level: level.isNotNull())
    return index.select("name", F.array_min(known).alias("min_level"), F.array_max(known).alias("max_level"), F.size("variants").cast("long").alias("variants"))


def within_era(zone_era: Column, through: str | None, eras: list[str]) -> Column:
    """Whether a zone's era is at most `through` in the order of eras; an unknown era on either side filters nothing."""
    if through not in eras:
        return F.lit(True)
    return ~F.coalesce(zone_era.isin(eras[eras.index(through) + 1 :]), F.lit(False))


def zones_by_id(zones: DataFrame) -> DataFrame:
    """(id, entries): the zone table's rows for each id, in its order; zones has nth, short, display, era and ids."""
    return zones.select(F.explode("ids").alias("id"), F.struct("nth", "short", "display", "era").alias("e")).groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("entries"))


def maps_of(names: DataFrame, zones: DataFrame) -> DataFrame:
    """names (zone, as a log writes it) with maps: the drawings of that place in the table's order, none for an unknown one.

    An instance goes by its base name; names meet by their letters and digits.
    """
    from ..functions.grammar import instance_zone

    known = zones.where("display is not null").groupBy(zone_key(F.col("display")).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("nth", "short"))).alias("_all"))
    keyed = names.withColumn("_key", zone_key(instance_zone(F.col("zone"))["base"]))
    return keyed.join(known, "_key", "left").withColumn("maps", F.coalesce(F.array_distinct(F.transform("_all", lambda m: F.lower(m["short"]))), F.expr("cast(array() as array<string>)"))).drop("_key", "_all")


def mob_places(variants: DataFrame, zones: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, zone_id, place, short, maps, era, levels, ids): where each name is listed, by the zone that its ids belong to.

    variants (name, id, level); zones as of `zones_by_id`; sites (short, long): the reference site's zones.  A place is
    named by the table, else by the site; the site's row is found by any of the place's short names, else by its name.
    A place that neither can name stays, without a name.
    """
    grouped = variants.groupBy("name", shard_of(F.col("id")).alias("zone_id")).agg(F.sort_array(F.collect_set("level")).alias("levels"), F.sort_array(F.collect_list("id")).alias("ids"))
    table = zones_by_id(zones).select(F.col("id").alias("zone_id"), "entries")
    known = grouped.select("zone_id").distinct().join(table, "zone_id")
    first = F.col("entries")[0]
    site = sites.select(F.lower("short").alias("_s"), F.col("short").alias("site_short"), F.col("long").alias("site_long"))
    by_short = known.select("zone_id", F.posexplode("entries").alias("at", "e")).withColumn("_s", F.lower("e.short")).join(site, "_s").groupBy("zone_id").agg(F.min_by(F.struct("site_short", "site_long"), "at").alias("a"))
    by_name = known.select("zone_id", zone_key(first["display"]).alias("_n")).join(sites.groupBy(zone_key(F.col("long")).alias("_n")).agg(F.min(F.struct(F.col("short").alias("site_short"), F.col("long").alias("site_long"))).alias("b")), "_n").select("zone_id", "b")
    named = known.join(by_short, "zone_id", "left").join(by_name, "zone_id", "left").select("zone_id", "entries", F.coalesce("a", "b").alias("site"))
    met = grouped.join(named, "zone_id", "left")
    maps = F.coalesce(F.array_distinct(F.transform("entries", lambda e: F.lower(e["short"]))), F.expr("cast(array() as array<string>)"))
    return met.select("name", "zone_id", F.coalesce(first["display"], F.col("site.site_long")).alias("place"), F.coalesce(F.col("site.site_short"), F.get(maps, F.lit(0))).alias("short"), maps.alias("maps"), first["era"].alias("era"), "levels", "ids")


def zone_roster(details: DataFrame, zones: DataFrame) -> DataFrame:
    """(short, id, name, level, rank): who is listed in each zone, by level (unknown last) and name.

    details (id, name, level, places array<struct<short, long>>) come from the shards of a zone's ids, of which the first
    that lists anybody counts; a listing belongs by the zone's short name or its name's letters and digits.
    """
    from pyspark.sql import Window

    wanted = zones.select("short", "display", F.posexplode("ids").alias("at", "zone_id"))
    listed = details.select("id", "name", "level", shard_of(F.col("id")).alias("zone_id"), F.explode("places").alias("p"))
    met = wanted.join(listed, "zone_id").where((F.lower("p.short") == F.lower("short")) | (zone_key(F.col("p.long")) == zone_key(F.col("display"))))
    one = met.select("short", "at", "id", "name", "level").distinct()
    here = one.join(one.groupBy("short").agg(F.min("at").alias("at")), ["short", "at"])
    order = Window.partitionBy("short").orderBy(F.col("level").asc_nulls_last(), F.lower("name"), "id")
    return here.select("short", "id", "name", "level", F.row_number().over(order).alias("rank"))


#: Up to a player level, the largest level difference that is still green, and still light blue if any is.
CON_COLOURS = (
    (8, -4, None), (9, -6, -4), (13, -7, -5), (15, -7, -5), (17, -8, -6), (21, -9, -7), (25, -10, -8), (29, -11, -9), (31, -12, -9), (33, -13, -10), (37, -14, -11), (41, -16, -12),
    (45, -17, -13), (49, -18, -14), (53, -19, -15), (55, -20, -15), (57, -21, -16), (59, -22, -16), (61, -23, -17), (63, -24, -17), (65, -25, -18), (67, -26, -18), (69, -27, -19), (None, -28, -19),
)


def con_colour(player: Column, mob: Column) -> Column:
    """What a mob of a level looks like to a player of one: red, yellow, white, blue, lightblue or green."""
    diff = mob - player
    tier = lambda i: F.coalesce(*[F.when(player <= row[0] if row[0] is not None else F.lit(True), F.lit(row[i] if row[i] is not None else -(2**31))) for row in CON_COLOURS])
    return (
        F.when(diff == 0, "white").when(diff >= 3, "red").when(diff > 0, "yellow").when(diff <= tier(1), "green").when(diff <= tier(2), "lightblue").when(diff.isNotNull(), "blue")
    )


def standing_in(places: DataFrame, short: str) -> DataFrame:
    """The rows of mob_places that a drawing shows, as the place's own short name or as one of its maps."""
    return places.where((F.col("short") == short) | F.array_contains("maps", short))


def in_band(index: DataFrame, low: int | None, high: int | None) -> int:
    """How many names of build_index have a listing of a known level within the band; an open end holds all."""
    fits = lambda v: v["level"].isNotNull() & ((v["level"] >= low) if low is not None else F.lit(True)) & ((v["level"] <= high) if high is not None else F.lit(True))
    return index.where(F.exists("variants", fits)).count()


def place_graph(maps: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (place, display, maps, degree) and edges (a, b) in both directions.

    maps (short, display, nth): the drawings in catalogue order; those of one display name are one place, which bears the
    first one's name, and those without a display name take no part.  labels (short, destination): where a drawing's
    labels lead; names meet by their letters and digits.  Labels that lead to no place or to their own are dropped.
    """
    named = maps.where(F.col("display").isNotNull())
    places = named.groupBy("display").agg(F.min_by("short", "nth").alias("place"), F.count(F.lit(1)).alias("maps"))
    here = named.join(places.select("display", "place"), "display").select("short", F.col("place").alias("a"))
    there = places.select(zone_key(F.col("display")).alias("_key"), F.col("place").alias("b"))
    one_way = labels.join(here, "short").withColumn("_key", zone_key(F.col("destination"))).join(there, "_key").where("a <> b").select("a", "b").distinct()
    edges = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = edges.groupBy(F.col("a").alias("place")).agg(F.count(F.lit(1)).alias("degree"))
    return places.join(degree, "place", "left").select("place", "display", "maps", F.coalesce("degree", F.lit(0)).alias("degree")), edges
