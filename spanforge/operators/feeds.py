"""Ordered feeds and timelines: newest rows, merged feeds, span pairing, attribution of amounts to casts, mention scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEED_LIMIT, FEED_MOST = 200, 2000
ATTRIBUTION_SECONDS = 12


def tail(df: DataFrame, order: list[str], limit: int = FEED_LIMIT) -> DataFrame:
    """The newest rows, oldest first, with total: the rows there are.  The limit is clamped to 1 .. 2000."""
    limit = max(1, min(FEED_MOST, limit))
    newest = df.orderBy(*[F.desc(c) for c in order]).limit(limit)
    return newest.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).orderBy(*order)


def newest_first(parts: list[DataFrame], order: list[Column], limit: int = FEED_LIMIT) -> DataFrame:
    """Several feeds of one shape as one, newest first."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.orderBy(*order).limit(limit)


#: Seconds of the stretches that fights are dealt to.
MINUTE = 60


def first_by_minute(fights: DataFrame) -> DataFrame:
    """(_npc, _minute, _b, _e, id): the part of each enemy's minute that fights span, with the first of those that span it."""
    spans = fights.select(F.lower("name").alias("_npc"), F.col("begin").alias("b"), F.col("last_damage").alias("e"), "id").where("b <= e")
    dealt = spans.withColumn("_minute", F.explode(F.sequence(F.floor(F.col("b") / MINUTE), F.floor(F.col("e") / MINUTE))))
    low = F.col("_minute") * MINUTE
    return dealt.groupBy("_npc", "_minute", F.greatest("b", low).alias("_b"), F.least("e", low + (MINUTE - 1)).alias("_e")).agg(F.min("id").alias("id"))


def fight_at(hits: DataFrame, fights: DataFrame, npc: str = "attacker") -> DataFrame:
    """hits with fight_id: the first fight of that enemy (whatever its case) that spans the hit's second.

    An enemy's minute has few parts to look at, however many fights overlap in it.
    """
    # equal hits are equal rows: each distinct one is looked up once
    named = hits.withColumn("_npc", F.lower(npc))
    points = named.select("_npc", "s").distinct().withColumn("_minute", F.floor(F.col("s") / MINUTE))
    met = points.join(first_by_minute(fights), ["_npc", "_minute"]).where("s between _b and _e")
    found = met.groupBy("_npc", "s").agg(F.min("id").alias("fight_id"))
    return named.join(found, ["_npc", "s"], "left").drop("_npc")


def pair_spans(rows: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """(keys, b, e, faded): the earliest open mark of each key up to its next close; a close without one is an instant.

    A span that is still open at the end has no e.
    """
    w = Window.partitionBy(*keys).orderBy("s", *order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_open", opens).withColumn("_close", closes).where("_open or _close")
    closed = marked.withColumn("_span", F.coalesce(F.sum(F.col("_close").cast("int")).over(w), F.lit(0)))
    first, last = F.min(F.when(F.col("_open"), F.col("s"))), F.max(F.when(F.col("_close"), F.col("s")))
    return closed.groupBy(*keys, "_span").agg(F.coalesce(first, last).alias("b"), last.alias("e"), last.isNotNull().alias("faded")).drop("_span")


def attribute(casts: DataFrame, landings: DataFrame, keys: list[str], order: list[str], seconds: int = ATTRIBUTION_SECONDS) -> DataFrame:
    """casts with amount and landed: what landed for the same keys from the cast on, until `seconds` later or the next cast.

    Both are one ordered stream per key: each landing belongs to the last cast at or before it, so no range join is needed.
    """
    one = casts.select(*keys, "s", *order, F.lit(0).alias("_side"), F.lit(0).cast("long").alias("amount"))
    both = one.unionByName(landings.select(*keys, "s", *order, F.lit(1).alias("_side"), F.col("amount").cast("long").alias("amount")))
    # casts of one second follow each other; only the last of them can own what lands from then on
    w = Window.partitionBy(*keys).orderBy("s", "_side", *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_cast", F.last(F.when(F.col("_side") == 0, F.struct("s", *order)), ignorenulls=True).over(w))
    mine = F.col("_side") == 1
    near = placed.where((F.col("_side") == 0) | (F.col("s") < F.col("_cast.s") + seconds))
    return near.where("_cast is not null").groupBy(*keys, "_cast").agg(
        F.coalesce(F.sum(F.when(mine, F.col("amount"))), F.lit(0)).alias("amount"), F.count(F.when(mine, 1)).alias("landed")
    ).select(*keys, "_cast.*", "amount", "landed")


#: Names that are sent to every task; a larger dictionary is shuffled with the words.
BROADCAST_NAMES = 200_000


def mentions(texts: DataFrame, names: DataFrame, id_cols: list[str], text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(ids, name, at): dictionary names in texts, longest first, never overlapping, each once a text.

    Words are trimmed of punctuation.  Names of several words match in any case; a name of one word matches in its own
    case and not beside a capitalised word.  Words meet names by the names' first two words (or the only one, as it is
    written), two short rows a word whatever the names' lengths; a dictionary of ordinary size goes to the words, so they
    aren't shuffled.  The rest of a candidate is compared in its text, which the few candidates come back to.
    """
    words = F.filter(F.transform(F.split(F.col(text_col), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    parts = F.split(name_col, " ")
    probe = F.when(F.size(parts) > 1, F.concat_ws(" ", F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1))))).otherwise(F.col(name_col))
    known = names.select(F.col(name_col).alias("name"), F.size(parts).alias("n"), F.lower(name_col).alias("_key"), probe.alias("_probe")).where("name is not null").distinct()
    if known.count() <= BROADCAST_NAMES:
        known = F.broadcast(known)
    cut = texts.select(*id_cols, words.alias("_w")).where(F.size("_w") > 0)
    pairs = F.transform("_w", lambda w, i: F.array(w, F.concat(F.lower(w), F.lit(" "), F.lower(F.get("_w", i + 1)))))
    here = cut.select(*id_cols, F.posexplode(pairs).alias("_at", "_probes")).select(*id_cols, "_at", F.explode("_probes").alias("_probe"))
    met = here.join(known, "_probe")
    listed = met.groupBy(*id_cols).agg(F.collect_list(F.struct((-F.col("n")).alias("n"), (F.col("_at") + 1).alias("at"), "name", "_key")).alias("_met"))
    capital = lambda c: F.coalesce(c.rlike(r"^\p{Lu}"), F.lit(False))
    whole = lambda m: (m["at"] - m["n"] - 1 <= F.size("_w")) & (F.lower(F.array_join(F.slice("_w", m["at"], -m["n"]), " ")) == m["_key"])
    beside = lambda m: capital(F.get("_w", m["at"] - 2)) | capital(F.get("_w", m["at"]))
    real = F.filter("_met", lambda m: whole(m) & ((m["n"] < -1) | ~beside(m)))
    back = cut.join(listed, id_cols).select(*id_cols, F.sort_array(F.transform(real, lambda m: F.struct(m["n"].alias("n"), m["at"].alias("at"), m["name"].alias("name")))).alias("_found"))
    # greedy: keep a hit if its words are free; the accumulator holds hits kept so far, each name once
    free = lambda kept, hit: ~F.exists(kept, lambda k: ((hit["at"] < k["at"] - k["n"]) & (k["at"] < hit["at"] - hit["n"])) | (k["name"] == hit["name"]))
    empty = F.expr("cast(array() as array<struct<n: int, at: int, name: string>>)")
    kept = F.aggregate("_found", empty, lambda kept, hit: F.when(free(kept, hit), F.concat(kept, F.array(hit))).otherwise(kept))
    return back.select(*id_cols, F.explode(kept).alias("k")).select(*id_cols, "k.name", "k.at")


def item_feed(events: DataFrame, stretches: DataFrame, registry: DataFrame) -> DataFrame:
    """(line_no, nth, s, what, item, item_id, who, with_whom, text, quantity): items looted, traded and named in chat
    inside the segments (b, e).

    registry (name, id) is both the dictionary of chat and the source of ids, whatever a name's case.  nth tells the
    names of one chat line apart.  `newest_first` by line_no and nth makes it the feed.
    """
    from . import learned
    from .segments import within

    inside = within(events, stretches.select("b", "e"), [], [], 3600)
    kind, none = F.col("kind"), F.lit(None).cast("string")
    first = F.lit(0).alias("nth")
    loot = inside.where((kind == "Loot") & F.col("item").isNotNull()).select("line_no", first, "s", F.lit("Looted").alias("what"), learned.item_name(F.col("item")).alias("item"), F.col("actor").alias("who"), F.col("source").alias("with_whom"), none.alias("text"), "quantity")
    trade = inside.where(kind == "Merchant").select("line_no", first, "s", F.when(F.col("sold"), "Sold").otherwise("Bought").alias("what"), learned.item_name(F.col("item")).alias("item"), F.lit("You").alias("who"), F.col("target").alias("with_whom"), none.alias("text"), "quantity")
    said = inside.where(kind == "Chat")
    named = mentions(said.select("line_no", "text"), registry, ["line_no"])
    nth = F.row_number().over(Window.partitionBy("line_no").orderBy(F.desc(F.size(F.split("name", " "))), "at")) - 1
    place = F.coalesce("custom_channel", "channel")
    chat = named.withColumn("nth", nth).join(said.select("line_no", "s", "actor", place.alias("place"), "text"), "line_no")
    chat = chat.select("line_no", "nth", "s", F.lit("Chat").alias("what"), F.col("name").alias("item"), F.col("actor").alias("who"), F.col("place").alias("with_whom"), "text", F.lit(1).alias("quantity"))
    every = loot.unionByName(trade).unionByName(chat)
    ids = registry.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("item_id"))
    return every.withColumn("_key", F.lower("item")).join(ids, "_key", "left").select("line_no", "nth", "s", "what", "item", "item_id", "who", "with_whom", "text", "quantity")


def token_score(low: Column, token: str) -> Column:
    """Score of a token of lower-case letters in a lower-case name, null where its letters don't follow each other there.

    A token inside the name beats one whose letters merely follow each other; earlier and fuller matches score more.
    """
    at = F.locate(token, low) - 1
    ahead = F.substring(low, at, 1)
    inside = 100 - F.least(at, F.lit(50)) + F.when((at == 0) | ~ahead.rlike(r"[\p{L}\p{N}]"), 20).otherwise(0)
    # the shortest beginning of the name that has the letters in order
    reach = F.length(F.regexp_extract(low, "(?s)^(" + "".join(".*?" + re.escape(c) for c in token) + ")", 1))
    spread = F.when(reach > 0, F.greatest(F.lit(1), 30 + len(token) - reach))
    return F.when(at >= 0, inside).otherwise(spread)


def fuzzy(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds all of the query's tokens, in any order, with their score, best first."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    score = F.lit(0)
    for token in query.lower().split():
        score = score + token_score(low, token)
    return df.withColumn("score", score.cast("double")).where("score is not null").orderBy(F.desc("score"), column)
