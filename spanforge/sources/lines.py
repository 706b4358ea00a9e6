"""Log files as lines: batch and stream readers, timestamps, several entries on one physical line, file-name dimensions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAMP = r"\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d\d \d\d:\d\d:\d\d \d{4}\] "
PREFIX = 27
LONGEST = 65536
FILE_NAME = r"eqlog_([^_/]+)_([^/]+?)\.txt(?:\.gz)?$"


MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def timestamp(prefix: Column) -> Column:
    """The moment of a 27-character prefix, null if there is none; the day's name isn't held against the date."""
    number = lambda at, n: F.substring(prefix, at, n).try_cast("int")
    month = F.floor((F.call_function("locate", F.substring(prefix, 6, 3), F.lit(MONTHS)) + 2) / 3).cast("int")
    when = F.try_make_timestamp_ntz(number(22, 4), month, number(10, 2), number(13, 2), number(16, 2), number(19, 2))
    return F.when(prefix.rlike("^" + STAMP) & number(22, 4).between(1999, 2200), when)


def entries(raw: DataFrame, text: str = "value") -> DataFrame:
    """raw with ts and action instead of its text: one row for each timestamped entry, in order (column part).

    The bytes are Latin-1.  Lines beyond 64 KiB and entries without a valid timestamp give no row.
    """
    decoded = F.rtrim(F.decode(F.col(text).cast("binary"), "ISO-8859-1"), F.lit("\r"))
    kept = raw.where(F.octet_length(text) <= LONGEST).withColumn("_line", decoded)
    # few lines have a second bracket, and only those can have a second timestamp
    pieces = F.when(F.call_function("locate", F.lit("["), F.col("_line"), F.lit(2)) == 0, F.array("_line")).otherwise(F.split("_line", f"(?={STAMP})"))
    # timestamps are made inside the generator: a filter on a plain column would be evaluated once more below it
    entry = lambda p: F.struct(timestamp(F.substring(p, 1, PREFIX)).alias("ts"), F.substring(p, PREFIX + 1, LONGEST).alias("action"))
    others = [c for c in raw.columns if c != text]
    parts = kept.select(*others, F.posexplode(F.transform(pieces, entry)).alias("part", "_entry"))
    return parts.select(*others, "part", "_entry.ts", "_entry.action").where("ts is not null and action <> ''")


def moments(prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seconds since 1970 of rows of 27 prefix bytes, and which of them are real dates."""
    digit = prefixes.astype(np.int64) - 48
    number = lambda *at: sum(digit[:, i] * 10 ** (len(at) - 1 - k) for k, i in enumerate(at))
    names = np.frombuffer(MONTHS.encode(), np.uint8).reshape(12, 3).astype(np.int64)
    code = lambda x: x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]
    order = np.argsort(code(names))
    month = order[np.searchsorted(code(names)[order], code(prefixes[:, 5:8].astype(np.int64))) % 12]
    year, day, hour, minute, second = number(21, 22, 23, 24), number(9, 10), number(12, 13), number(15, 16), number(18, 19)
    first = ((year - 1970) * 12 + month).astype("datetime64[M]")
    days = (first + 1).astype("datetime64[D]").astype(np.int64) - first.astype("datetime64[D]").astype(np.int64)
    real = (year >= 1999) & (year <= 2200) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)
    return ((first.astype("datetime64[D]").astype(np.int64) + day - 1) * 86400 + hour * 3600 + minute * 60 + second), real


def scanned(value: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """What `entries` finds in a column of bytes: row, part, ts and action of each entry, in order."""
    raw = np.frombuffer(value.buffers()[2], np.uint8) if value.buffers()[2] is not None else np.zeros(0, np.uint8)
    plain = not len(raw) or raw.max() < 128
    line = value.cast(pa.string()) if plain else pa.array([None if x is None else x.decode("latin-1") for x in value.to_pylist()], pa.string())
    rows = pc.indices_nonzero(pc.and_(pc.less_equal(pc.binary_length(value), LONGEST).fill_null(False), pc.match_substring(line, "[").fill_null(False)))
    line = pc.utf8_rtrim(line.take(rows), "\r")
    many = pc.match_substring_regex(line, "." + STAMP)
    part = pa.repeat(pa.scalar(0, pa.int32()), len(rows))
    if pc.any(many).as_py():
        cut = [(r, i, x) for r, text in zip(rows.filter(many).to_pylist(), line.filter(many).to_pylist()) for i, x in enumerate(re.split(f"(?={STAMP})", text)[0 if not re.match(STAMP, text) else 1 :])]
        one = pc.invert(many)
        rows = pa.concat_arrays([rows.filter(one), pa.array([r for r, _, _ in cut], rows.type)])
        part = pa.concat_arrays([part.filter(one), pa.array([i for _, i, _ in cut], pa.int32())])
        line = pa.concat_arrays([line.filter(one), pa.array([x for _, _, x in cut], pa.string())])
        order = pc.sort_indices(pa.table({"row": rows, "part": part}), [("row", "ascending"), ("part", "ascending")])
        rows, part, line = rows.take(order), part.take(order), line.take(order)
    stamped = pc.match_substring_regex(line, f"^{STAMP}.")
    rows, part, line = rows.filter(stamped), part.filter(stamped), line.filter(stamped)
    prefix = pc.utf8_slice_codeunits(line, 0, PREFIX)
    data = b"".join(x.encode() for x in prefix.to_pylist()) if not len(prefix) or prefix.buffers()[2] is None else bytes(prefix.buffers()[2])[: PREFIX * len(prefix)]
    seconds, real = moments(np.frombuffer(data, np.uint8).reshape(-1, PREFIX))
    ts = pa.array(seconds * 1_000_000).cast(pa.timestamp("us"))
    real = pa.array(real)
    return rows.filter(real), part.filter(real), ts.filter(real), pc.utf8_slice_codeunits(line, PREFIX).filter(real)


def named(raw: DataFrame) -> DataFrame:
    """raw with session_id, owner_name and server from the name of each row's file."""
    path = F.col("_metadata.file_path")
    return raw.select("value", path.alias("session_id"), F.regexp_extract(path, FILE_NAME, 1).alias("owner_name"), F.regexp_extract(path, FILE_NAME, 2).alias("server"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, owner_name, server, line_no, ts, action) of log files, plain or gzipped.

    line_no orders a file's entries and is dense after `dense`: 23 bits number the task (a file's splits go to tasks in
    order), 28 the line in it and 12 the entry in the line, of which 64 KiB hold 2340 at most.
    """
    rows = named(spark.read.text(path)).withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    found = entries(rows)
    row = F.col("_row").bitwiseAND(F.lit((1 << 28) - 1))
    return found.withColumn("line_no", F.shiftleft(F.col("_task").cast("long"), 40) + F.shiftleft(row, 12) + F.col("part")).drop("_task", "_row", "part")


def dense(lines: DataFrame) -> DataFrame:
    """Line numbers from 1 without gaps.  A window by file: sessions run in parallel, one file is one ordered stream."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("session_id").orderBy("line_no")).cast("long"))


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The same columns but line_no for files as they land in a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return entries(named(raw))


def since(lines: DataFrame, moment: str) -> DataFrame:
    """Entries from a moment on; over Parquet the filter reaches the row groups' statistics."""
    return lines.where(F.col("ts") >= F.lit(moment).cast("timestamp_ntz"))
