"""Small reference files and documents: spell, item, map, zone and NPC files as tables; JSON documents and index tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_KEYS = ("dashboards", "settings", "pins", "recents", "triggers")


def loot_filter(spark: SparkSession, path: str) -> DataFrame:
    """id^filter^icon^name lines; comments and ids below 1 are left out."""
    raw = spark.read.csv(path, sep="^", comment="#", schema="id int, filter string, icon int, name string")
    return raw.where("id > 0 and name is not null")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True, schema="location string, name string, id int, count int, slots int")
    return raw.where("name <> 'Empty' and id > 0")


def spells(spark: SparkSession, path: str) -> DataFrame:
    """(row, id, name, formula, cap) of spell files of 109 columns or more."""
    cut = spark.read.text(path).select(F.split("value", r"\^").alias("c"), F.monotonically_increasing_id().alias("row")).where("size(c) >= 109")
    return cut.select("row", F.col("c")[0].try_cast("int").alias("id"), F.col("c")[1].alias("name"), F.col("c")[107].try_cast("int").alias("formula"), F.col("c")[108].try_cast("int").alias("cap"))


def spell_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="^", comment="#", schema="id int, caster_me string, caster_other string, landed_me string, landed_other string, gone string")


def map_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of map files, also where several stand on one line: kind L or P and its comma-separated fields."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    parts = rows.select("path", "line", F.posexplode(F.split("value", r"(?<=\d)(?=[LP] )")).alias("part", "record")).where("length(record) <= 512")
    return parts.select("path", "line", "part", F.substring("record", 1, 1).alias("kind"), F.split(F.substring("record", 3, 512), r"\s*,\s*", -1).alias("f")).where("kind in ('L', 'P')")


def map_lines(records: DataFrame) -> DataFrame:
    f = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    names = ("x1", "y1", "z1", "x2", "y2", "z2")
    found = records.where("kind = 'L' and size(f) = 9").select("path", "line", *[f(i, "float").alias(n) for i, n in enumerate(names)], *[f(6 + i, "smallint").alias(n) for i, n in enumerate("rgb")])
    return found.dropna()


def map_labels(records: DataFrame) -> DataFrame:
    f = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    label = F.replace(F.array_join(F.slice("f", 8, 512), ","), F.lit("_"), F.lit(" "))
    found = records.where("kind = 'P' and size(f) >= 8").select("path", "line", *[f(i, "float").alias(n) for i, n in enumerate("xyz")], *[f(3 + i, "smallint").alias(n) for i, n in enumerate("rgb")], f(6, "int").alias("size"), F.trim(label).alias("label"))
    return found.dropna(subset=["x", "y", "z"])


def zones(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", comment="#", schema="short string, display string, source string, era string, era_source string, ids string")
    return raw.where("short <> 'short'").withColumn("ids", F.transform(F.split(F.coalesce("ids", F.lit("")), r"[ ,;]+"), lambda x: x.try_cast("int")))


def npc_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, level, id) of a JSON array of [name (level), type, id] triples of type n."""
    from ..operators.lookup import split_level

    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("t")).where("size(t) = 3 and t[1] = 'n'")
    return rows.select(split_level(F.col("t")[0]).alias("n"), F.col("t")[2].try_cast("int").alias("id")).select("n.name", "n.level", "id").where("id is not null")


DETAIL = "name: string, level: int, hp: bigint, loot: array<struct<id: int, name: string, rate: double>>, zones: array<struct<short: string, name: string>>, locations: array<array<double>>"


def npc_details(spark: SparkSession, path: str) -> DataFrame:
    """One row for each id of JSON objects id -> detail."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.explode(F.from_json("value", f"map<string, struct<{DETAIL}>>")).alias("id", "d"))
    return found.select(F.col("id").try_cast("int").alias("id"), "d.*")


def write_document(spark: SparkSession, folder: str, key: str, text: str) -> None:
    """A JSON document under a known key, replaced as a whole."""
    if key not in DOCUMENT_KEYS:
        raise KeyError(key)
    json.loads(text)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{key}")


def read_document(spark: SparkSession, folder: str, key: str) -> str | None:
    if key not in DOCUMENT_KEYS:
        raise KeyError(key)
    row = spark.read.text(f"{folder}/{key}", wholetext=True).first()
    return row[0].strip() if row else None


def write_index(index: DataFrame, path: str) -> None:
    """A learned index, a partition for each server; only servers in the table are replaced."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("server").parquet(path)


def write_events(events: DataFrame, path: str, parser_version: int = 1) -> None:
    """Parsed events by session and day, with the parser's version, sorted so that time filters skip row groups."""
    dated = events.withColumn("day", F.to_date("ts")).withColumn("parser_version", F.lit(parser_version))
    dated.repartition("session_id", "day").sortWithinPartitions("session_id", "day", "ts", "line_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "day").parquet(path)


def read_events(spark: SparkSession, path: str, parser_version: int = 1) -> DataFrame:
    """Events that this parser's version wrote; others have to be parsed again."""
    return spark.read.parquet(path).where(F.col("parser_version") == parser_version).drop("day", "parser_version")


def stale(tables: DataFrame, days: int = 60, build: str | None = None) -> DataFrame:
    """Cached sessions to sweep: the log is gone, nothing was read for so many days, or another build than this one's wrote
    it and a newer cache of its log by another build is there (tables: log, log_exists, last_used and, with build, build)."""
    old = ~F.col("log_exists") | (F.col("last_used") < F.current_timestamp() - F.expr(f"INTERVAL {days} DAYS"))
    if build is None:
        return tables.where(old)
    foreign = (F.col("build") != build) & ~old
    newest = Window.partitionBy("log", foreign).orderBy(F.desc("last_used"), "build")
    return tables.withColumn("_nth", F.row_number().over(newest)).where(old | (foreign & (F.col("_nth") > 1))).drop("_nth")
