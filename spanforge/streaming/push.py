"""Pushes of a changing table: what changed since the last push, or everything where a change can't say enough.

Each micro-batch of versioned rows is merged into the table of what has been pushed, which is stored by batch in the
shared folder.  A push is full if it is the first, if a row was taken back since the last one, or if the side table that
all rows depend on (estimates, say) has another version; otherwise it has the changed rows alone.  A batch that runs
again starts from the table of the batch before it and sends the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Push:
    """rows: the rows to send; full: whether they replace what was sent; base: the batch that they build on, -1 for none."""

    rows: DataFrame
    number: int
    base: int
    full: bool


class Pushed:
    """The table of what has been pushed, a Parquet folder for each batch that changed it; two are kept."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], version: str = "version", removed: str | None = "removed"):
        self.spark, self.folder, self.keys, self.version, self.removed = spark, folder.rstrip("/"), keys, version, removed
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The batches that are whole: Spark's writer leaves _SUCCESS at its end."""
        if not self.fs.exists(self.path):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path)]
        whole = lambda n: self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith("pushed-") and whole(n))

    def table(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pushed-{number}")

    def merge(self, batch: DataFrame, number: int, depends: str = "") -> Push | None:
        """The push of a batch, or None if it changes nothing; depends is the version of the side table."""
        base = max((n for n in self.batches() if n < number), default=-1)
        columns = batch.columns
        gone = F.col(self.removed) if self.removed else F.lit(False)
        change = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), self.version).alias("_row")).select("_row.*")
        if base >= 0:
            old = self.table(base).select(*self.keys, F.col(self.version).alias("_old"))
            newer = change.join(old, self.keys, "left").where((F.col("_old").isNull() & ~gone) | (F.col(self.version) > F.col("_old"))).select(*columns)
        else:
            newer = change.where(~gone)
        other = base >= 0 and self.table(base).select("_depends").first()[0] != depends
        # silence, late versions and removals of what was never pushed say nothing new
        if not other and newer.isEmpty():
            return None
        marked = newer.withColumn("_changed", F.lit(number).cast("long"))
        if base >= 0:
            rest = self.table(base).join(newer.select(*self.keys), self.keys, "left_anti")
            marked = marked.unionByName(rest.select(*columns, "_changed"))
        whole = marked.withColumn("_depends", F.lit(depends))
        path = f"{self.folder}/pushed-{number}"
        whole.write.mode("overwrite").parquet(path)
        now = self.table(number)
        taken_back = not now.where((F.col("_changed") == number) & gone).isEmpty()
        for n in self.batches():
            if n < base:
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pushed-{n}"), True)
        full = base < 0 or taken_back or other
        rows = now.where(~gone) if full else now.where(F.col("_changed") == number)
        return Push(rows.select(*columns), number, base, full)


def push(stream: DataFrame, folder: str, keys: list[str], sink: Callable[[Push], None], version: str = "version", removed: str | None = "removed", depends: Callable[[], str] = lambda: "", every: str = "1 second") -> StreamingQuery:
    """A query that sends each batch's push to sink; folder, in the shared storage, has its table and its checkpoint."""
    pushed = Pushed(stream.sparkSession, f"{folder}/table", keys, version, removed)

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()  # what it came from runs once
        try:
            if (found := pushed.merge(batch, number, depends())) is not None:
                sink(found)
        finally:
            batch.unpersist()

    return stream.writeStream.outputMode("update").foreachBatch(one).trigger(processingTime=every).option("checkpointLocation", f"{folder}/checkpoint").start()
