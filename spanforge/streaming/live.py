"""Structured Streaming: files that land in a folder become events, bucketed totals, open fights and pushed deltas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import seconds

#: How late a row may come, and how many files a trigger takes.
LATE = "1 day"
FILES_PER_TRIGGER = 64


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stream of the Parquet files of path, a folder or one file."""
    schema = spark.read.parquet(path).schema
    if path.endswith(".parquet") and not _is_folder(spark, path):
        folder, _, name = path.rpartition("/")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def root_of(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spanforge-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def folder_of(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{root_of(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """The complete result of everything that is there now, through the stream into a table; a replayed batch writes the same."""
    folder = folder_of(df.sparkSession, name)
    q = df.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def stored(stream: DataFrame, name: str, drain: bool = False) -> DataFrame:
    """Every row that a stream emits for what is there now, as a table; a batch that runs again replaces what it wrote.

    drain: for sources that end a trigger early; the query runs until nothing is left.  Otherwise it ends by itself.
    """
    folder = folder_of(stream.sparkSession, name)
    mode = stream.writeStream.outputMode("append" if drain else "update")
    made = mode.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint")
    if drain:
        q = made.start()
        q.processAllAvailable()
        q.stop()
    else:
        made.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def bucketed_totals(spark: SparkSession, path: str) -> DataFrame:
    """Hourly counts and sums of each event type, by a stateful stream over the files."""
    rows = parquet_stream(spark, path).select("event_type", seconds("ts").alias("s"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    totals = rows.groupBy("event_type", (F.floor(F.col("s") / 3600) * 3600).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"))
    return run_to_end(totals, "totals")


def windowed(events: DataFrame, every: str, late: str = LATE) -> DataFrame:
    """Append-mode totals of tumbling windows; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


def push_changes(stream: DataFrame, key: str, version: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch's newest version of every key, to the sink; a replayed batch sends the same rows again."""

    def one(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("row")).select("row.*")
        sink(newest, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def open_fights(events: DataFrame, idle: int = 30) -> DataFrame:
    """Engagements of each target as session windows over a stream of damage events."""
    return (
        events.withWatermark("ts", LATE)
        .groupBy(F.session_window("ts", f"{idle + 1} seconds"), "target")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum("amount").alias("total"), F.min("ts").alias("begin"), F.max("ts").alias("last_damage"))
    )
