"""Map folders: the catalogue of drawings, and labels that are read again only where a file has changed.

Files are listed with their length and modification time by Spark's file reader, which opens none of them for that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import zone_key
from . import files

#: Fixed value: only these name endings are layers of a drawing; other digits belong to the zone's name.
LAYER = r"^(.+)_([1-3])$"


def layer_of(path: Column) -> tuple[Column, Column]:
    """The zone and the layer (0 for the drawing itself) of a map file's name."""
    stem = F.lower(F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1))
    inner = F.regexp_extract(stem, LAYER, 1)
    return F.when(inner != "", inner).otherwise(stem), F.when(inner != "", F.regexp_extract(stem, LAYER, 2).cast("int")).otherwise(0)


def listing(spark: SparkSession, sets: dict[str, str]) -> DataFrame:
    """(path, length, modified, set, short, layer) of the map files of each set's folder."""
    out = None
    for name, folder in sets.items():
        # no column of the content: files are listed, not read
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(name).alias("set"))
        out = rows if out is None else out.unionByName(rows)
    short, layer = layer_of(F.col("path"))
    return out.select("*", short.alias("short"), layer.alias("layer"))


def catalogue(listed: DataFrame, zones: DataFrame, preference: list[str]) -> DataFrame:
    """(short, display, era, sets, nth): a row for each drawing, those of a known zone first, by name and then short name.

    sets are those that draw it, in the order of preference; zones has short, display and era.
    """
    order = F.create_map(*[x for i, s in enumerate(preference) for x in (F.lit(s), F.lit(i))])
    drawn = listed.where(F.col("set").isin(*preference)).groupBy("short").agg(F.sort_array(F.collect_set(F.struct(order[F.col("set")].alias("i"), "set"))).alias("_sets"))
    known = zones.groupBy(F.lower("short").alias("short")).agg(F.first("display").alias("display"), F.first("era").alias("era"))
    rows = drawn.join(known, "short", "left").select("short", "display", "era", F.transform("_sets", lambda s: s["set"]).alias("sets"))
    from pyspark.sql import Window

    # the catalogue is as long as the list of zones
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("display").isNull(), F.lower(F.coalesce("display", "short")), "short")
    return rows.withColumn("nth", F.row_number().over(place))


def available(names: DataFrame, drawn: DataFrame) -> DataFrame:
    """names (zone, as a log writes it) with the drawings there are of it, in catalogue order."""
    from ..functions.grammar import instance_zone

    by_name = drawn.where("display is not null").groupBy(zone_key(F.col("display")).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("nth", "short"))).alias("_m"))
    keyed = names.withColumn("_key", zone_key(instance_zone(F.col("zone"))["base"]))
    return keyed.join(by_name, "_key").select(*names.columns, F.transform("_m", lambda m: m["short"]).alias("maps"))


class LabelCache:
    """Labels of map files by (path, length, modification time), in a table that changes with the files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.parsed = 0  # files that the last reading had to open

    def _versions(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not self.fs.exists(path):
            return []
        whole = lambda n: self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/files/_SUCCESS"))
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(path)]
        return [n for _, n in sorted(found) if whole(n)]

    def labels(self, listed: DataFrame) -> DataFrame:
        """(path, line, x, y, z, r, g, b, size, label) of the listed files: kept ones as they are, changed and new ones read now."""
        versions = self._versions()
        key = ["path", "length", "modified"]
        now = listed.select(*key).distinct()
        if versions:
            held = self.spark.read.parquet(f"{self.folder}/{versions[-1]}/files")
            fresh = [r["path"] for r in now.join(held, key, "left_anti").select("path").collect()]
            if not fresh and held.join(now, key, "left_anti").isEmpty():
                self.parsed = 0
                return self.spark.read.parquet(f"{self.folder}/{versions[-1]}/labels")
        else:
            fresh = [r["path"] for r in now.select("path").collect()]
        self.parsed = len(fresh)
        parts = []
        if fresh:
            parts.append(files.map_labels(files.map_records(self.spark, fresh)))
        if versions:
            same = now.join(held, key, "left_semi").select("path")
            parts.append(self.spark.read.parquet(f"{self.folder}/{versions[-1]}/labels").join(same, "path", "left_semi"))
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        name = uuid.uuid4().hex
        whole.write.parquet(f"{self.folder}/{name}/labels")
        now.write.parquet(f"{self.folder}/{name}/files")  # last: without it the version doesn't count
        for old in versions[:-1]:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)
        return self.spark.read.parquet(f"{self.folder}/{name}/labels")
