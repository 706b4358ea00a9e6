"""The registry of queries over the test tables, each next to the SQL that must give the same rows.

Roles of the events table: actor = user_id, kind = event_type, amount = cents, s = second, k from props (target = k % 10,
flag bits = k).  Amounts are integers and derived doubles are rounded to 6 places, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeutil import bucket, ratio, seconds
from ..operators import feeds, intervals, learned, lookup, metrics, present, segments, spells
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: events by roles, for the SQL side.
E = """e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000000 AS s,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), seconds("ts").alias("s"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- the query operator -------------------------------------------------------------------------------------------


def active(e: DataFrame, keys: list[str]) -> DataFrame:
    """Active seconds: first-to-last of each session, merged."""
    units = segments.presence(e, keys, ["s", "event_id"])
    return intervals.merge(units.select(*keys, "b", "e"), keys).groupBy(*keys).agg(intervals.total().alias("active_seconds"))


SESSIONS = """, lagged AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM e),
  sess AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM lagged),
  units AS (SELECT user_id, session, min(s) AS b, max(s) AS e, count(*) AS n FROM sess GROUP BY 1, 2)"""


@query(f"""WITH {E}{SESSIONS}, act AS (SELECT user_id, sum(e - b + 1) AS active FROM units GROUP BY 1),
  tot AS (SELECT user_id, sum(cents) AS total, count(*) AS hits FROM e GROUP BY 1), root AS (SELECT sum(cents) AS root FROM e)
  SELECT user_id, CAST(total AS BIGINT) AS total, hits, round(total / hits, 6) AS avg_hit, round(100.0 * total / root, 6) AS percent_of_total,
    CAST(active AS BIGINT) AS active_seconds, round(total / active, 6) AS dps, row_number() OVER (ORDER BY total DESC, user_id) AS rank
  FROM tot JOIN act USING (user_id), root""")
def actor_summary(spark, d):
    e = events(spark, d)
    tot = e.groupBy("user_id").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("hits"))
    met = tot.join(active(e, ["user_id"]), "user_id").crossJoin(F.broadcast(e.agg(F.sum("cents").alias("root"))))
    rated = met.select(
        "user_id", "total", "hits", r6(F.col("total") / F.col("hits")).alias("avg_hit"), r6(100.0 * F.col("total") / F.col("root")).alias("percent_of_total"),
        "active_seconds", r6(F.col("total") / F.col("active_seconds")).alias("dps"),
    )
    return segments.ranked(rated, [(F.col("total"), True), (F.col("user_id"), False)])


@query(f"""WITH {E} SELECT event_type, user_id, CAST(2 - grouping(user_id) - grouping(event_type) AS BIGINT) AS level, CAST(sum(cents) AS BIGINT) AS total, count(*) AS hits,
  max(cents) AS max_hit, min(CASE WHEN cents > 0 THEN cents END) AS min_hit FROM e GROUP BY ROLLUP (event_type, user_id)""")
def drill_rollup(spark, d):
    e = events(spark, d)
    return e.rollup("event_type", "user_id").agg(
        (2 - F.grouping("user_id") - F.grouping("event_type")).cast("long").alias("level"), F.sum("cents").alias("total"), F.count(F.lit(1)).alias("hits"),
        F.max("cents").alias("max_hit"), F.min(F.when(F.col("cents") > 0, F.col("cents"))).alias("min_hit"),
    )


@query("""WITH o AS (SELECT n_name, c_custkey, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
  SELECT n_name AS owner, CASE WHEN count(*) > 1 THEN n_name || ' +Pets' ELSE n_name END AS label, count(*) AS actors, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(cents) AS BIGINT) AS total FROM o GROUP BY n_name""")
def owner_rollup(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    per = o.groupBy("n_name", "c_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return per.groupBy(F.col("n_name").alias("owner")).agg(
        F.when(F.count(F.lit(1)) > 1, F.concat(F.first("n_name"), F.lit(" +Pets"))).otherwise(F.first("n_name")).alias("label"), F.count(F.lit(1)).alias("actors"),
        F.sum("orders").alias("orders"), F.sum("cents").alias("total"),
    )


def _by_user(e: DataFrame) -> DataFrame:
    return e.groupBy("user_id").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("hits"))


_BY_USER = "SELECT user_id, CAST(sum(cents) AS BIGINT) AS total, count(*) AS hits FROM e WHERE {} GROUP BY user_id"


@query(f"WITH {E} " + _BY_USER.format("event_type IN ('click', 'purchase')"))
def dim_filter_in(spark, d):
    return _by_user(events(spark, d).where(F.col("event_type").isin("click", "purchase")))


@query(f"WITH {E} " + _BY_USER.format("event_type NOT IN ('click', 'purchase')"))
def dim_filter_not(spark, d):
    return _by_user(events(spark, d).where(~F.col("event_type").isin("click", "purchase")))


@query(f"WITH {E} " + _BY_USER.format("(k & 4) = 0"))
def flag_filter_exclude(spark, d):
    return _by_user(events(spark, d).where(F.col("k").bitwiseAND(F.lit(4)) == 0))


@query(f"""WITH {E}, c AS (SELECT user_id, count(*) AS hits, count(*) FILTER ((k & 1) <> 0) AS crits, count(*) FILTER ((k & 3) = 3) AS lucky,
    sum(cents) FILTER ((k & 1) <> 0) AS crit_total, sum(cents) FILTER ((k & 3) = 3) AS lucky_total FROM e GROUP BY 1)
  SELECT user_id, hits, crits, lucky, round(100.0 * crits / hits, 6) AS crit_rate, CASE WHEN crits > 0 THEN round(100.0 * lucky / crits, 6) ELSE 0 END AS lucky_rate,
    CASE WHEN crits > lucky THEN round((crit_total - coalesce(lucky_total, 0)) / (crits - lucky), 6) ELSE 0 END AS avg_crit FROM c""")
def crit_rates(spark, d):
    k = F.col("k")
    bits = F.when(k.bitwiseAND(F.lit(1)) != 0, metrics.MODIFIERS["Critical"]).otherwise(0) + F.when(k.bitwiseAND(F.lit(3)) == 3, metrics.MODIFIERS["Lucky"]).otherwise(0)
    hits = events(spark, d).select("user_id", F.lit("Damage").alias("kind"), F.lit("Melee").alias("damage_kind"), F.col("cents").alias("amount"), bits.alias("modifiers"))
    return _metrics(hits, {"hits": "hits", "crits": "critHits", "lucky": "luckyHits", "crit_rate": "critRate", "lucky_rate": "luckyRate", "avg_crit": "avgCrit"})


def _metrics(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """Metrics of the catalog for each user."""
    c = rows.groupBy("user_id").agg(*metrics.parts(metrics.needed(list(named.values()))))
    value = lambda m: metrics.metric(m, {n: F.col(n) for n in c.columns})
    return c.select("user_id", *[(value(m) if m[-4:].lower() != "rate" and not m.startswith("avg") and m not in ("meleeAccuracy",) else r6(value(m))).alias(n) for n, m in named.items()])


@query(f"""WITH {E}, c AS (SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS landed, count(*) FILTER (event_type = 'error') AS misses, count(*) FILTER (event_type = 'view') AS parries FROM e GROUP BY 1)
  SELECT user_id, attempts, landed, round(100.0 * landed / attempts, 6) AS hit_rate, CASE WHEN attempts > parries THEN round(100.0 * landed / (attempts - parries), 6) ELSE 0 END AS accuracy,
    round(100.0 * (attempts - misses - parries) / attempts, 6) AS undefended_rate FROM c""")
def accuracy_rates(spark, d):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    c = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), n("purchase").alias("landed"), n("error").alias("misses"), n("view").alias("parries"))
    a = F.col("attempts")
    return c.select(
        "user_id", "attempts", "landed", r6(ratio(F.col("landed"), a, 100.0)).alias("hit_rate"), r6(ratio(F.col("landed"), a - F.col("parries"), 100.0)).alias("accuracy"),
        r6(ratio(a - F.col("misses") - F.col("parries"), a, 100.0)).alias("undefended_rate"),
    )


@query(f"WITH {E}{SESSIONS} SELECT user_id, CAST(sum(e - b + 1) AS BIGINT) AS active_seconds FROM units GROUP BY user_id")
def active_seconds(spark, d):
    return active(events(spark, d), ["user_id"])


MERGED = """, marked AS (SELECT b, e, CASE WHEN b > max(e) OVER (ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM units),
  isl AS (SELECT b, e, sum(new) OVER (ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS i FROM marked), merged AS (SELECT min(b) AS b, max(e) AS e FROM isl GROUP BY i)"""


def merged_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Union of all users' sessions; _k is one key for the whole timeline, merged day by day first."""
    return intervals.merge(segments.presence(events(spark, d), ["user_id"], ["s", "event_id"]).select(F.lit(0).alias("_k"), "b", "e"), ["_k"])


@query(f"WITH {E}{SESSIONS}{MERGED} SELECT CAST(sum(e - b + 1) AS BIGINT) AS raid_seconds, count(*) AS stretches FROM merged")
def raid_seconds(spark, d):
    return merged_sessions(spark, d).agg(intervals.total().alias("raid_seconds"), F.count(F.lit(1)).alias("stretches"))


@query(f"""WITH {E}{SESSIONS}{MERGED}, run AS (SELECT *, coalesce(sum(e - b + 1) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM merged),
  cut AS (SELECT b + greatest(0, 600 - before) AS b, least(e, b + 4200 - before - 1) AS e FROM run) SELECT CAST(b AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM cut WHERE b <= e""")
def interval_trim(spark, d):
    return intervals.trim(merged_sessions(spark, d), ["_k"], 600, 3600).select("b", "e")


@query(f"""WITH {E}{SESSIONS}, days AS (SELECT DISTINCT s // 86400 AS day FROM e)
  SELECT user_id, CAST(greatest(b, day * 86400 + 28800) AS BIGINT) AS b, CAST(least(e, day * 86400 + 64799) AS BIGINT) AS e FROM units JOIN days ON b <= day * 86400 + 64799 AND e >= day * 86400 + 28800""")
def interval_intersect(spark, d):
    e = events(spark, d)
    units = segments.presence(e, ["user_id"], ["s", "event_id"]).select("user_id", "b", "e").withColumn("_k", F.lit(0))
    day = F.floor(F.col("s") / 86400) * 86400
    hours = e.select(day.alias("day")).distinct().select(F.lit(0).alias("_k"), (F.col("day") + 28800).alias("b"), (F.col("day") + 64799).alias("e"))
    return intervals.intersect(units, hours, ["_k"]).drop("_k")


SIGNUP = SESSIONS.replace("gap >= 600", "gap >= 600 OR event_type = 'signup'")


@query(f"WITH {E}{SIGNUP} SELECT user_id, CAST(session AS BIGINT) AS session, b, e, n FROM units")
def presence_sessions(spark, d):
    return segments.presence(events(spark, d), ["user_id"], ["s", "event_id"], marker=F.col("event_type") == "signup")


@query(f"""WITH {E}{SESSIONS}, t AS (SELECT user_id, sum(e - b + 1) AS secs FROM units GROUP BY 1), v AS (SELECT user_id, sum(cents) AS total FROM e GROUP BY 1)
  SELECT user_id, CAST(total AS BIGINT) AS total, CAST(secs AS BIGINT) AS secs, round(3600.0 * total / secs, 6) AS per_hour FROM t JOIN v USING (user_id)""")
def whole_log_per_session_rate(spark, d):
    e = events(spark, d)
    met = e.groupBy("user_id").agg(F.sum("cents").alias("total")).join(active(e, ["user_id"]), "user_id")
    return met.select("user_id", "total", F.col("active_seconds").alias("secs"), r6(ratio(F.col("total"), F.col("active_seconds"), 3600.0)).alias("per_hour"))


@query(f"""WITH {E}{SESSIONS}, lim AS (SELECT min(s) // 86400 * 86400 AS b FROM e), cut AS (SELECT user_id, greatest(units.b, lim.b) AS b, least(e, lim.b + 172799) AS e FROM units, lim WHERE units.b <= lim.b + 172799)
  SELECT user_id, CAST(sum(cut.e - cut.b + 1) AS BIGINT) AS played FROM cut GROUP BY user_id""")
def played_time_only(spark, d):
    e = events(spark, d)
    units = segments.presence(e, ["user_id"], ["s", "event_id"]).select("user_id", "b", "e").withColumn("_k", F.lit(0))
    first = F.floor(F.min("s") / 86400) * 86400
    clock = e.agg(first.alias("b")).select(F.lit(0).alias("_k"), "b", (F.col("b") + 172799).alias("e"))
    return intervals.intersect(units, clock, ["_k"]).groupBy("user_id").agg(intervals.total().alias("played"))


@query(f"WITH {E} SELECT event_type, CAST(sum(cents) AS BIGINT) AS total, count(*) AS hits FROM e WHERE s >= (SELECT max(s) FROM e) - 86399 GROUP BY event_type")
def last_seconds(spark, d):
    e = events(spark, d)
    last = F.broadcast(e.agg(F.max("s").alias("last")))
    return e.crossJoin(last).where(F.col("s") >= F.col("last") - 86399).groupBy("event_type").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("hits"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders),
  g AS (SELECT *, CASE WHEN day - max(day) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 120 THEN 0 ELSE 1 END AS new FROM o)
  SELECT o_custkey, o_orderkey, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM g""")
def pull_chains(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(seconds("o_orderdate") / 86400).alias("b"))
    return segments.chains(o.withColumn("e", F.col("b")), ["o_custkey"], ["b", "o_orderkey"]).select("o_custkey", "o_orderkey", "chain")


@query(f"""WITH {E}, l AS (SELECT *, s - lag(s) OVER w AS gap, lag(event_type) OVER w AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
  i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7200 OR was = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM l)
  SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS b, max(s) AS e, CAST(sum(cents) AS BIGINT) AS total, count(*) AS hits FROM i GROUP BY 1, 2""")
def engagement_islands(spark, d):
    i = segments.islands(events(spark, d), ["user_id"], ["s", "event_id"], 7200, F.col("event_type") == "error")
    return i.groupBy("user_id", "island").agg(F.min("s").alias("b"), F.max("s").alias("e"), F.sum("cents").alias("total"), F.count(F.lit(1)).alias("hits"))


def _series(spark, d, width):
    return events(spark, d).groupBy("event_type", bucket(F.col("s"), width).alias("at")).agg(F.sum("cents").alias("value"))


_SERIES = f'WITH {E} SELECT event_type, s - (s + 62135596800) % {{0}} AS "at", CAST(sum(cents) AS BIGINT) AS value FROM e GROUP BY 1, 2'


@query(_SERIES.format(7))
def bucket_series_7s(spark, d):
    return _series(spark, d, 7)


@query(_SERIES.format(60))
def bucket_series_60s(spark, d):
    return _series(spark, d, 60)


@query(f"""WITH {E}, b AS (SELECT event_type, s // 3600 * 3600 AS hour, sum(cents) AS value FROM e GROUP BY 1, 2),
  g AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), 3600)) AS hour FROM b GROUP BY event_type)
  SELECT event_type, g.hour AS "at", CAST(coalesce(value, 0) AS BIGINT) AS value, round(avg(coalesce(value, 0)) OVER (PARTITION BY event_type ORDER BY g.hour ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM g LEFT JOIN b USING (event_type, hour)""")
def rolling_mean(spark, d):
    series = events(spark, d).groupBy("event_type", (F.floor(F.col("s") / 3600) * 3600).alias("at")).agg(F.sum("cents").alias("value"))
    found = present.rolling_mean(present.filled(series, ["event_type"], 3600), ["event_type"], 10)
    return found.withColumn("mean", r6(F.col("mean")))


@query(f"""WITH {E}, t AS (SELECT user_id, sum(cents) AS total FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, user_id) AS n FROM t)
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(total AS BIGINT) AS cents FROM r WHERE n <= 8 UNION ALL SELECT 'Other (' || count(*) || ')', CAST(sum(total) AS BIGINT) FROM r WHERE n > 8 HAVING count(*) > 0""")
def topk_other(spark, d):
    return present.top_and_other(events(spark, d), "user_id", "cents")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5""")
def topn_per_group(spark, d):
    return learned.newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


# --- segments and state -------------------------------------------------------------------------------------------


def _asof_sql(tolerance: str) -> str:
    return f"""WITH {E}, m AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN s END) OVER (PARTITION BY user_id ORDER BY s, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM e)
  SELECT event_id, CASE WHEN {tolerance} THEN seen END AS as_of FROM m WHERE event_type <> 'signup'"""


def _asof(spark, d, tolerance=None):
    e = events(spark, d)
    left, right = e.where("event_type <> 'signup'"), e.where("event_type = 'signup'")
    return segments.as_of(left.select("user_id", "s", "event_id"), right.select("user_id", "s", "event_id", "cents"), ["user_id"], ["event_id"], ["cents"], tolerance).select("event_id", "as_of")


@query(_asof_sql("true"))
def asof_last_state(spark, d):
    return _asof(spark, d)


@query(_asof_sql("s - seen <= 300"))
def recent_within_300s(spark, d):
    return _asof(spark, d, 300)


SPANS = """, sw AS (SELECT user_id, s, k % 3 AS state, row_number() OVER (PARTITION BY user_id, s ORDER BY event_id DESC) AS n FROM e WHERE event_type = 'signup'),
  spans AS (SELECT user_id, state, s AS b, lead(s) OVER (PARTITION BY user_id ORDER BY s) - 1 AS e FROM sw WHERE n = 1)"""


def _spans(spark, d):
    e = events(spark, d).where("event_type = 'signup'").withColumn("state", F.col("k") % 3)
    return segments.steps(e, ["user_id"], ["event_id"], "state", keep_repeats=True)


@query(f"WITH {E}{SPANS} SELECT user_id, state, b, e FROM spans")
def state_spans(spark, d):
    return _spans(spark, d)


@query(f"""WITH {E}{SPANS}, ends AS (SELECT user_id, max(s) AS last FROM e GROUP BY 1), held AS (SELECT user_id, state, sum(coalesce(e, last) - b + 1) AS secs FROM spans JOIN ends USING (user_id) GROUP BY 1, 2)
  SELECT user_id, state, CAST(secs AS BIGINT) AS secs, round(100.0 * secs / sum(secs) OVER (PARTITION BY user_id), 6) AS uptime FROM held""")
def state_uptime(spark, d):
    last = events(spark, d).groupBy("user_id").agg(F.max("s").alias("last"))
    held = _spans(spark, d).join(last, "user_id").groupBy("user_id", "state").agg(F.sum(F.coalesce("e", "last") - F.col("b") + 1).alias("secs"))
    return held.withColumn("uptime", r6(100.0 * F.col("secs") / F.sum("secs").over(Window.partitionBy("user_id"))))


@query(f"""WITH {E}, one AS (SELECT user_id, s, event_type, row_number() OVER (PARTITION BY user_id, s ORDER BY event_id DESC) AS n FROM e),
  chg AS (SELECT user_id, s, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY s) AS was FROM one WHERE n = 1)
  SELECT user_id, event_type, s AS b, lead(s) OVER (PARTITION BY user_id ORDER BY s) - 1 AS e FROM chg WHERE was IS NULL OR was <> event_type""")
def step_context(spark, d):
    return segments.steps(events(spark, d), ["user_id"], ["event_id"], "event_type")


# --- feeds --------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, c AS (SELECT user_id, s, event_id, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nxt FROM e WHERE event_type = 'click')
  SELECT c.user_id, c.s, c.event_id, CAST(coalesce(sum(p.cents), 0) AS BIGINT) AS amount, count(p.cents) AS landed
  FROM c LEFT JOIN e p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.s >= c.s AND p.s < least(c.s + 3600, coalesce(c.nxt, c.s + 3600)) GROUP BY 1, 2, 3""")
def cast_attribution(spark, d):
    e = events(spark, d).withColumn("amount", F.col("cents"))
    return feeds.attribute(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], ["event_id"], 3600)


@query(f"""WITH {E}, m AS (SELECT user_id, s, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span
    FROM e WHERE event_type IN ('view', 'error'))
  SELECT user_id, coalesce(min(CASE WHEN event_type = 'view' THEN s END), max(CASE WHEN event_type = 'error' THEN s END)) AS b, max(CASE WHEN event_type = 'error' THEN s END) AS e,
    max(CASE WHEN event_type = 'error' THEN s END) IS NOT NULL AS faded FROM m GROUP BY user_id, span""")
def span_pairing(spark, d):
    return feeds.pair_spans(events(spark, d), ["user_id"], ["event_id"], F.col("event_type") == "view", F.col("event_type") == "error")


@query(f"WITH {E} SELECT event_id, user_id, s, cents, (SELECT count(*) FROM e WHERE event_type = 'purchase') AS total FROM e WHERE event_type = 'purchase' ORDER BY s DESC, event_id DESC LIMIT 200")
def tail_feed(spark, d):
    return feeds.tail(events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "s", "cents"), ["s", "event_id"])


@query(f"""WITH {E}, u AS (SELECT 'event' AS feed, event_id AS id, s, cents FROM e WHERE event_type = 'purchase' UNION ALL SELECT 'order', o_orderkey, epoch_us(o_orderdate) // 1000000, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders)
  SELECT * FROM u ORDER BY s DESC, feed, id LIMIT 200""")
def union_feed(spark, d):
    bought = events(spark, d).where("event_type = 'purchase'").select(F.lit("event").alias("feed"), F.col("event_id").alias("id"), "s", "cents")
    orders = table(spark, d, "orders").select(F.lit("order").alias("feed"), F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("s"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return feeds.newest_first([bought, orders], [F.desc("s"), F.asc("feed"), F.asc("id")])


@query(f"""WITH {E}, r AS (SELECT user_id AS session_id, event_id AS line, s, k, event_type AS t, 'Spell' || (k % 6) AS spell, CASE WHEN event_type = 'purchase' THEN cents % 60 + 1 END AS lv FROM e),
  v AS (SELECT *, last_value(lv IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line) AS level FROM r),
  o AS (SELECT *, coalesce(sum(CASE WHEN t = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, spell ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM v WHERE t IN ('view', 'click', 'error')),
  g AS (SELECT session_id, spell, span, bool_or(t = 'error') AS closed, arg_min(s, line) FILTER (t <> 'error') AS b, arg_min(CASE WHEN t = 'view' AND level IS NOT NULL THEN level ELSE -1 END, line) FILTER (t <> 'error') AS level FROM o GROUP BY ALL),
  p AS (SELECT session_id, spell, max(b) FILTER (NOT closed) AS b, arg_max(level, span) FILTER (level > 0) AS level FROM g GROUP BY ALL)
  SELECT session_id, spell, CAST(b AS BIGINT) AS b, CAST(b + 6 * CASE right(spell, 1) WHEN '1' THEN level // 2 WHEN '2' THEN least(level // 2 + 5, 20) WHEN '3' THEN least(level * 30, 300) WHEN '4' THEN 50 ELSE 2 END AS BIGINT) AS e
  FROM p WHERE b IS NOT NULL AND level IS NOT NULL AND right(spell, 1) <> '0' AND NOT (right(spell, 1) = '1' AND level < 2)""")
def buff_ends(spark, d):
    t, k = F.col("event_type"), F.col("k")
    kind = F.when(t == "view", "Cast").when(t == "click", "Landed").when(t == "error", "WearOff").when(t == "purchase", "Level")
    rows = events(spark, d).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("line_no"), "s", kind.alias("kind"), F.lit("me").alias("actor"), F.lit("Begin").alias("cast_kind"),
        F.concat(F.lit("Spell"), (k % 6).cast("string")).alias("spell"), (F.col("cents") % 60 + 1).alias("level"),
    )
    known = spark.createDataFrame([(f"spell{i}", 50 if i == 0 else i, cap) for i, cap in enumerate((0, 0, 20, 300, 0, 0))], "name string, formula int, cap int")
    return spells.predicted_ends(rows, known, "Me")


# --- learned indexes ----------------------------------------------------------------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), seconds("l_shipdate").alias("s"))


L = "l AS (SELECT l_partkey AS part, l_orderkey AS ord, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, epoch_us(l_shipdate) // 1000000 AS s FROM lineitem)"
_CLEAN = """, n AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS q FROM l WINDOW w AS (PARTITION BY part ORDER BY s, ord, line)),
  a AS (SELECT *, (p IS NULL OR s - p >= 432000) AND (q IS NULL OR q - s >= 432000) AS alone FROM n),
  c AS (SELECT *, alone OR sum(CASE WHEN alone THEN 1 ELSE 0 END) OVER (PARTITION BY part) < 4 AS clean FROM a)"""


def _clean(spark, d):
    return learned.uncrowded(lines(spark, d), ["part"], ["ord", "line"], within=432000)


@query(f"WITH {L}{_CLEAN} SELECT part, ord, line, clean FROM c")
def concurrency_filter(spark, d):
    return _clean(spark, d).select("part", "ord", "line", "clean")


_ESTIMATES = "percentile_disc({0}) WITHIN GROUP (ORDER BY cents) AS p{1}"
_EST = ", ".join(_ESTIMATES.format(p, n) for p, n in ((0.1, 10), (0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90)))


@query(f"WITH {L}{_CLEAN} SELECT part, count(*) AS n, {_EST} FROM c WHERE clean GROUP BY part")
def percentile_estimate(spark, d):
    return learned.estimates(_clean(spark, d).where("clean"), ["part"], "cents").drop("grade")


@query(f"""WITH {L}{_CLEAN}, s AS (SELECT part, count(*) AS n, {_EST} FROM c WHERE clean GROUP BY part)
  SELECT part, CASE WHEN n >= 10 AND (p75 - p25) / p50 <= 0.25 THEN 'High' WHEN n >= 4 AND (p75 - p25) / p50 <= 0.5 THEN 'Medium' ELSE 'Low' END AS grade FROM s""")
def confidence_grade(spark, d):
    return learned.estimates(_clean(spark, d).where("clean"), ["part"], "cents").select("part", "grade")


_HIST = f"WITH {L}, h AS (SELECT part % 16 AS part, CAST(least(greatest(floor(log2(cents) * 4), 0), 79) AS INTEGER) AS bucket, count(*) AS n FROM l WHERE cents > 0 GROUP BY 1, 2)"


@query(f"{_HIST} SELECT part, bucket, n FROM h")
def log_histogram(spark, d):
    return learned.histogram(lines(spark, d).withColumn("part", F.col("part") % 16), ["part"], "cents")


@query(f"""{_HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY part ORDER BY bucket) AS upto, ceil(0.9 * sum(n) OVER (PARTITION BY part)) AS want FROM h)
  SELECT part, CAST(round(pow(2.0, (min(bucket) + 0.5) / 4)) AS BIGINT) AS value FROM r WHERE upto >= want GROUP BY part""")
def histogram_quantile(spark, d):
    return learned.histogram_quantile(learned.histogram(lines(spark, d).withColumn("part", F.col("part") % 16), ["part"], "cents"), ["part"], 0.9)


@query(f"WITH {L} SELECT part, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT DISTINCT part, s, cents FROM l) GROUP BY part")
def learned_merge_dedupe(spark, d):
    li = lines(spark, d).select("part", "s", "cents")
    once = learned.merge_samples(li, li, ["part"], ["s", "cents"])
    return once.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"))


@query("""WITH g AS (SELECT lower(l_returnflag) AS source, l_linestatus AS item, sum(CAST(l_quantity AS BIGINT)) AS drops FROM lineitem GROUP BY 1, 2), k AS (SELECT lower(o_orderstatus) AS source, count(*) AS kills FROM orders GROUP BY 1)
  SELECT source, item, CAST(drops AS BIGINT) AS drops, coalesce(kills, 0) AS kills, CASE WHEN coalesce(kills, 0) > 0 THEN round(100.0 * drops / kills, 6) ELSE 0 END AS rate FROM g LEFT JOIN k USING (source)""")
def drop_rate_join(spark, d):
    drops = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("item"), F.col("l_quantity").cast("long").alias("quantity"))
    kills = table(spark, d, "orders").select(F.col("o_orderstatus").alias("victim"))
    return present.drop_rates(drops, kills).withColumn("rate", r6(F.col("rate")))


# --- lookups ------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT DISTINCT p_brand AS brand, p_size % 7 * 8 AS observed FROM part), v AS (SELECT p_brand AS brand, p_partkey AS id, p_size AS level FROM part),
  r AS (SELECT brand, observed, id AS variant, level, abs(level - observed) AS apart, row_number() OVER (PARTITION BY brand, observed ORDER BY abs(level - observed), id) AS n FROM o JOIN v USING (brand))
  SELECT brand, observed, variant, level, apart, apart <= 2 AS exact FROM r WHERE n = 1""")
def variant_resolve(spark, d):
    part = table(spark, d, "part")
    observed = part.select(F.col("p_brand").alias("brand"), (F.col("p_size") % 7 * 8).alias("observed")).distinct()
    return lookup.resolve_variant(observed, part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").alias("level")), ["brand"])


@query("""SELECT lower(p_name) AS key, p_partkey AS id, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 ELSE 2 END AS rank
  FROM part WHERE contains(lower(p_name), 'red') AND p_size BETWEEN 5 AND 40 ORDER BY rank, key, id LIMIT 50""")
def ranked_search(spark, d):
    part = table(spark, d, "part").select(F.lower("p_name").alias("key"), F.col("p_partkey").alias("id"), F.col("p_size").alias("level"))
    return lookup.ranked_search(part, "key", "red", 50, (5, 40)).select("key", "id", "rank")


@query("""SELECT CASE WHEN p_size BETWEEN 1 AND 10 THEN '1-10' WHEN p_size BETWEEN 11 AND 25 THEN '11-25' WHEN p_size BETWEEN 26 AND 40 THEN '26-40' ELSE '41+' END AS band, count(*) AS n FROM part GROUP BY 1""")
def level_bands(spark, d):
    bands = [(1, 10, "1-10"), (11, 25, "11-25"), (26, 40, "26-40")]
    return table(spark, d, "part").groupBy(lookup.band(F.col("p_size"), bands, "41+").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT p_brand, n, max(CASE WHEN i = n // 4 THEN p_size END) AS low, max(CASE WHEN i = 3 * n // 4 THEN p_size END) AS high FROM r WHERE n >= 5 GROUP BY p_brand, n""")
def quartile_band(spark, d):
    return lookup.quartile_band(table(spark, d, "part"), ["p_brand"], "p_size")


@query("""WITH RECURSIVE ed AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5),
  two AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), ok AS (SELECT a AS node FROM two WHERE a NOT LIKE 'AS%' UNION SELECT b FROM two WHERE b NOT LIKE 'AS%'),
  open AS (SELECT a, b FROM two SEMI JOIN ok ON a = ok.node SEMI JOIN ok k ON b = k.node), walk(node, hops) AS (SELECT (SELECT min(n_name) FROM nation), 0 UNION SELECT open.b, hops + 1 FROM walk JOIN open ON open.a = walk.node WHERE hops < 12),
  near AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node), way(node, hops, path) AS (SELECT node, hops, [node] FROM near WHERE hops = 0
    UNION ALL SELECT n.node, n.hops, list_append(way.path, n.node) FROM way JOIN open ON open.a = way.node JOIN near n ON n.node = open.b AND n.hops = way.hops + 1)
  SELECT node, CAST(hops AS INTEGER) AS hops, array_to_string(min(path), ' > ') AS path FROM way GROUP BY node, hops""")
def route_bfs(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    inside = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    nxt = nation.alias("x").join(nation.alias("y"), F.col("y.n_nationkey") == F.col("x.n_nationkey") + 5).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))
    start = nation.agg(F.min("n_name")).first()[0]
    edges = inside.unionByName(nxt)
    allowed = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node not like 'AS%'")
    return lookup.routes(edges, start, allowed).select("node", "hops", F.array_join("path", " > ").alias("path"))


@query("""WITH maps AS (SELECT s_name AS short, s_suppkey AS nth, CASE WHEN s_nationkey % 4 <> 0 THEN n_name END AS display FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  places AS (SELECT display, arg_min(short, nth) AS place, count(*) AS maps FROM maps WHERE display IS NOT NULL GROUP BY display),
  labels AS (SELECT s_name AS short, n_name AS destination FROM supplier JOIN nation ON n_nationkey = (s_suppkey * 7) % 25),
  way AS (SELECT p.place AS a, q.place AS b FROM labels JOIN maps USING (short) JOIN places p ON p.display = maps.display JOIN places q ON q.display = labels.destination WHERE p.place <> q.place),
  edges AS (SELECT a, b FROM way UNION SELECT b, a FROM way)
  SELECT place, display, maps, (SELECT count(*) FROM edges WHERE a = place) AS degree FROM places""")
def place_degrees(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    maps = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("short"), F.col("s_suppkey").alias("nth"), F.when(F.col("s_nationkey") % 4 != 0, F.col("n_name")).alias("display")
    )
    labels = supplier.join(nation, F.col("n_nationkey") == F.col("s_suppkey") * 7 % 25).select(F.col("s_name").alias("short"), F.lower("n_name").alias("destination"))
    return lookup.place_graph(maps, labels)[0]


@query(f"""WITH {E}, o AS (SELECT *, cents % 60 AS level, k % 2 = 0 AS stated FROM e WHERE k % 5 = 0 AND cents % 60 > 0),
  first AS (SELECT user_id, level AS early, stated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM o) WHERE i = 1),
  seen AS (SELECT e.event_id, arg_max(o.level, (o.s, o.event_id)) AS level FROM e JOIN o ON o.user_id = e.user_id AND o.s <= e.s WHERE e.k % 5 <> 0 GROUP BY e.event_id)
  SELECT event_id, user_id, coalesce(seen.level, CASE WHEN stated THEN early END) AS level
  FROM e LEFT JOIN seen USING (event_id) LEFT JOIN first USING (user_id) WHERE k % 5 <> 0""")
def level_as_of(spark, d):
    e = events(spark, d)
    observed = e.where("k % 5 = 0").select("user_id", "s", "event_id", (F.col("cents") % 60).alias("level"), (F.col("k") % 2 == 0).alias("stated"))
    return segments.level_as_of(e.where("k % 5 <> 0").select("event_id", "user_id", "s"), observed, ["user_id"], ["event_id"]).select("event_id", "user_id", "level")


@query(f"""WITH {E}, n AS (SELECT *, CASE WHEN k % 2 = 0 THEN upper(event_type) ELSE event_type END || k AS name FROM e),
  once AS (SELECT user_id, lower(name) AS low, arg_min(name, (s, event_id)) AS name, min((s, event_id)) AS came FROM n GROUP BY user_id, low),
  nth AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY came) AS i FROM once)
  SELECT user_id, string_agg(name, ',' ORDER BY i) AS names FROM nth WHERE i <= 8 GROUP BY user_id""")
def first_names(spark, d):
    e = events(spark, d).withColumn("name", F.concat(F.when(F.col("k") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.col("k")))
    return learned.first_names(e, ["user_id"], "name", ["s", "event_id"]).select("user_id", F.array_join("names", ",").alias("names"))


@query(f"WITH {E} SELECT event_type AS target, string_agg(DISTINCT k, ',' ORDER BY k) AS levels FROM e GROUP BY event_type")
def observed_levels(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("target"), F.col("k").alias("level"))
    return learned.observed_levels(e).select("target", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"))


@query("""SELECT * FROM (SELECT arg_min(c_name, c_custkey) AS name, min(c_nationkey) FILTER (c_nationkey > 2) AS min_level, max(c_nationkey) FILTER (c_nationkey > 2) AS max_level, count(*) AS variants
  FROM customer GROUP BY c_custkey // 7)""")
def browse_levels(spark, d):
    npcs = table(spark, d, "customer").select(
        F.concat(F.lit("npc "), F.floor(F.col("c_custkey") / 7)).alias("key"), "c_name", F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("level")
    )
    names = npcs.groupBy(F.col("key").alias("name")).agg(F.min_by("c_name", "id").alias("shown"))
    rows = lookup.browse_rows(lookup.build_index(npcs.select(F.col("key").alias("name"), "id", "level")))
    return rows.join(names, "name").select(F.col("shown").alias("name"), "min_level", "max_level", "variants")


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '^(an|a|the)\\s+', '')) AS name_key, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS type_key FROM part""")
def name_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", lookup.npc_key(F.col("p_name")).alias("name_key"), lookup.zone_key(F.col("p_type")).alias("type_key"))


@query(f"WITH {E} SELECT event_id, k, k % 10 AS target FROM e")
def json_extract(spark, d):
    return events(spark, d).select("event_id", "k", (F.col("k") % 10).alias("target"))


def _token(token: str) -> str:
    lazy = "".join(".*?" + c for c in token)
    return f"""CASE WHEN strpos(low, '{token}') > 0 THEN 100 - least(strpos(low, '{token}') - 1, 50) + CASE WHEN strpos(low, '{token}') = 1 OR NOT regexp_matches(substr(low, strpos(low, '{token}') - 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 20 ELSE 0 END
      WHEN regexp_extract(low, '^({lazy})', 1) <> '' THEN greatest(1, 30 + {len(token)} - length(regexp_extract(low, '^({lazy})', 1))) END"""


@query(f"""WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS low FROM part), sc AS (SELECT p_partkey, p_name, CAST({_token('rd')} + {_token('wdg')} AS DOUBLE) AS score FROM n)
  SELECT * FROM sc WHERE score IS NOT NULL""")
def fuzzy_filter(spark, d):
    return feeds.fuzzy(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "rd wdg")


@query()
def mention_scan(spark, d):
    return feeds.mentions(table(spark, d, "conversations").select("conv_id", "turn", "text"), mention_names(spark, d), ["conv_id", "turn"])


def mention_names(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary: every fifth word pair of the benchmark texts, a role that item names have in chat, and as often a
    name of one word and one of eight."""
    words = table(spark, d, "benchmark").select(F.split("text", r"\s+").alias("w"))
    at = words.select("w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(5))).alias("i")).select("w", "i", F.explode(F.array(*map(F.lit, (1, 2, 8)))).alias("n")).where("i + n - 1 <= size(w)")
    return at.select(F.trim(F.regexp_replace(F.array_join(F.slice("w", F.col("i"), F.col("n")), " "), r"[^\p{L}\p{N} ]", "")).alias("name")).where("name <> ''").distinct()


#: Parts as NPCs, whose id's thousands name a zone; nations as zones, some under their region's name.
_NPCS = """n AS (SELECT lower(p_brand) AS name, p_partkey % 25 * 1000 + p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN p_size END AS level FROM part),
  z AS (SELECT n_nationkey AS nth, n_name AS short, CASE WHEN n_nationkey % 4 = 0 THEN r_name ELSE n_name END AS display, r_name AS era, [n_nationkey, n_nationkey + 1] AS ids FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _npcs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    npcs = table(spark, d, "part").select(F.lower("p_brand").alias("name"), (F.col("p_partkey") % 25 * 1000 + F.col("p_partkey")).alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).cast("int").alias("level"))
    key = F.col("n_nationkey").cast("long")
    zones = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("nth"), F.col("n_name").alias("short"), F.when(key % 4 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("display"), F.col("r_name").alias("era"), F.array(key, key + 1).alias("ids"))
    return npcs, zones


@query(f"""WITH {_NPCS}, site AS (SELECT n_name AS short, 'The ' || n_name AS long FROM nation WHERE n_nationkey % 3 = 0), byid AS (SELECT unnest(ids) AS zone_id, z.* FROM z),
  ent AS (SELECT zone_id, arg_min(display, nth) AS display, arg_min(era, nth) AS era, list(lower(short) ORDER BY nth) AS maps FROM byid GROUP BY zone_id),
  st AS (SELECT zone_id, arg_min(site.short, nth) AS sshort, arg_min(site.long, nth) AS slong FROM byid JOIN site ON lower(site.short) = lower(byid.short) GROUP BY zone_id),
  g AS (SELECT name, id // 1000 AS zone_id, count(*) AS ids, list_sort(list(DISTINCT level) FILTER (level IS NOT NULL)) AS levels FROM n GROUP BY ALL)
  SELECT name, zone_id, coalesce(display, slong) AS place, coalesce(sshort, maps[1]) AS short, array_to_string(coalesce(maps, []), ' ') AS maps, era, coalesce(array_to_string(levels, ' '), '') AS levels, ids FROM g LEFT JOIN ent USING (zone_id) LEFT JOIN st USING (zone_id)""")
def mob_places(spark, d):
    npcs, zones = _npcs(spark, d)
    sites = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("short"), F.concat(F.lit("The "), "n_name").alias("long"))
    found = lookup.mob_places(npcs, zones, sites)
    return found.select("name", "zone_id", "place", "short", F.array_join("maps", " ").alias("maps"), "era", F.array_join("levels", " ").alias("levels"), F.size("ids").cast("long").alias("ids"))


@query(f"""WITH c(ceiling, green, light) AS (VALUES {', '.join(f"({a if a else 2**30}, {g}, {b if b else -2**30})" for a, g, b in lookup.CON_COLOURS)}), p AS (SELECT p_partkey, p_size + p_partkey % 40 AS player, (p_partkey * 7) % 90 + 1 AS mob FROM part),
  t AS (SELECT p_partkey, player, mob, arg_min(green, ceiling) AS green, arg_min(light, ceiling) AS light FROM p JOIN c ON player <= ceiling GROUP BY ALL)
  SELECT p_partkey, CASE WHEN mob = player THEN 'white' WHEN mob - player >= 3 THEN 'red' WHEN mob > player THEN 'yellow' WHEN mob - player <= green THEN 'green' WHEN mob - player <= light THEN 'lightblue' ELSE 'blue' END AS colour FROM t""")
def con_colours(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 40).alias("player"), (F.col("p_partkey") * 7 % 90 + 1).alias("mob"))
    return p.select("p_partkey", lookup.con_colour(F.col("player"), F.col("mob")).alias("colour"))


@query(f"""WITH {_NPCS}, w AS (SELECT short, display, unnest(ids) AS zone_id, generate_subscripts(ids, 1) AS place FROM z),
  met AS (SELECT w.short, place, id, name, level FROM w JOIN n ON id // 1000 = zone_id WHERE id % 3 <> 0 AND (id // 1000 % 2 = 0 OR w.short = (SELECT short FROM z z2 WHERE z2.nth = id // 1000))),
  one AS (SELECT * FROM met SEMI JOIN (SELECT short, min(place) AS place FROM met GROUP BY short) f ON met.short = f.short AND met.place = f.place)
  SELECT short, id, name, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY short ORDER BY level NULLS LAST, name, id) AS INTEGER) AS rank FROM one""")
def zone_roster(spark, d):
    """NPCs of even zones are listed in both zones that share an id, of odd ones in their own; every third is listed nowhere."""
    npcs, zones = _npcs(spark, d)
    home, own = lookup.shard_of(F.col("id")), zones.select("nth", F.col("short").alias("own"))
    both = zones.select(F.explode("ids").alias("_zone"), "short").groupBy("_zone").agg(F.collect_list("short").alias("shorts"))
    listed = npcs.withColumn("_home", home).join(own, F.col("_home") == F.col("nth")).join(both, F.col("_home") == F.col("_zone"))
    shorts = F.when(F.col("id") % 3 == 0, F.expr("cast(array() as array<string>)")).when(F.col("_home") % 2 == 0, F.col("shorts")).otherwise(F.array("own"))
    details = listed.select("id", "name", "level", F.transform(shorts, lambda x: F.struct(F.upper(x).alias("short"), F.lit("elsewhere").alias("long"))).alias("places"))
    return lookup.zone_roster(details, zones)


@query(f'WITH {E} SELECT event_type, s // 3600 * 3600 AS "at", count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY 1, 2')
def stream_equals_batch(spark, d):
    return live.bucketed_totals(spark, f"{d}/events.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import combat  # noqa: F401  registers its queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import combat  # noqa: F401

    return dict(ORACLES)
