"""WARC archives and their capture index (operator 5).

Pages become WARC records: the one of smallest id among equal payloads is a response, the others revisit it.  Each
record is a gzip member of its own (a record of 16 MiB or more is several), and Spark's text sink writes them one after
another: a member's last byte is the highest of its 32-bit length and so 0 below 16 MiB, and that 0 is the sink's line
separator.  So every file is a plain .warc.gz whose records can be fetched by the compressed offset and length that the
index gives.  Pages above LARGE_BYTES are a file each; the others share files of about FILE_BYTES.  Reading inflates a
file member by member into a run of captures, sorted by URL key, timestamp and id.  The index is an external merge: runs are dealt over ranges of the sort key (the range bounds include timestamp and
id, so one very common URL or host spreads over many ranges), and each range merges its slice of all runs with a loser
tree.  Ranges in order, and positions in a range, give the global capture history.

Defined cases: null html is an empty payload; a null url has no target header and an empty key; control characters in
urls are percent-coded; a null page id sorts last; repeated rows of the smallest id with one payload are all
responses; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, real_id, shared_path, sort_id, text_slices, utf8, written

BREAK = "\r\n"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Payload bytes of an average file, most records of a file, and payloads that are a file each.
FILE_BYTES, RECORDS_PER_FILE, LARGE_BYTES = 1 << 26, 2000, 1 << 22
#: Uncompressed bytes of a gzip member; the highest byte of the length stays 0.
MEMBER_BYTES = (1 << 24) - 1
SLICE_BYTES = 1_000_000
CAPTURES_PER_RANGE = 100_000


def capture_time(page_id: int, seconds: int = 1) -> str:
    """Fetch time of a page that carries none: a second for each id from the first capture on (ids modulo 2**31)."""
    return (FIRST_CAPTURE + timedelta(seconds=seconds * (page_id % 2**31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the last to the first without www, then path and query in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    path = re.sub(r"/+$", "", parts.path) or "/"
    return ",".join(reversed(host.split("."))) + port + ")" + (path + ("?" + "&".join(sorted(parts.query.split("&"))) if parts.query else "")).lower()


def record(page_id: int, url: str | None, html: str, refers_to: int | None) -> str:
    """One WARC/1.1 record without its trailing CRLF CRLF; a revisit keeps the HTTP head only."""
    payload = html.encode()
    head = BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""])
    block = head if refers_to is not None else head + html
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {capture_time(page_id)}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    size = len(head.encode()) + (0 if refers_to is not None else len(payload))
    return BREAK.join([*fields, "Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", block])


def members(data: bytes) -> bytes:
    """data as gzip members, without the last byte, which is 0."""
    out = []
    for at in range(0, len(data), MEMBER_BYTES):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(press.compress(data[at : at + MEMBER_BYTES]) + press.flush())
    return b"".join(out)[:-1]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Archives of all pages under path, a folder that Spark can write to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = pages.select(sort_id(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"), F.octet_length(html).alias("size"))
    first = page.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"))
    named = page.join(first, ["digest", "size"], "left").select("id", "url", "html", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"), "size")
    seen = page.agg(F.avg("size"), F.max("size")).first()
    mean, most = (seen[0] or 0.0), (seen[1] or 0)

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for a, b in text_slices(offsets, SLICE_BYTES):
                rows = zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(4)))
                yield pa.RecordBatch.from_arrays([pa.array([members((record(*row) + BREAK * 2).encode()) for row in rows], pa.binary())], ["value"])

    def write(part: DataFrame, records_per_file: int) -> None:
        packed = part.select("id", "url", "html", "refers_to").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        packed.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)

    write(named.where(F.col("size") < LARGE_BYTES), max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / max(1.0, mean)))))
    if most >= LARGE_BYTES:
        write(named.where(F.col("size") >= LARGE_BYTES), 1)


def inflated(data: memoryview) -> Iterator[tuple[bytes, int, int]]:
    """Uncompressed bytes, offset and length of each gzip member."""
    at = 0
    while at < len(data):
        member, start, out = zlib.decompressobj(31), at, []
        while not member.eof:
            out.append(member.decompress(data[at : at + 65536]))
            at = min(at + 65536, len(data))
            if at == len(data) and not member.eof:
                out.append(member.flush())
                if not member.eof:
                    raise ValueError("the archive ends inside a member")
        at -= len(member.unused_data)
        yield b"".join(out), start, at - start


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, compressed offset and length of each record of a WARC file."""
    parts = inflated(memoryview(data))
    for raw, at, size in parts:
        end = raw.index(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in raw[:end].decode().split(BREAK)[1:])
        start, length = end + 4, int(fields["Content-Length"])
        while len(raw) < start + length + 4:  # a large record goes on in the next member
            more, _, extra = next(parts)
            raw, size = raw + more, size + extra
        yield fields, raw[start : start + length], at, size


CAPTURE = "run string, url_key string, captured string, id long, record_type string, refers_to long, payload_bytes long, payload_digest string, record_offset long, record_length long"


def page_of(urn: str) -> int:
    return int(urn[len("<urn:page:") : -1])


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive file, read back from its bytes: a locally sorted run for each file."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for fields, block, offset, length in records(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in head.decode().split(BREAK)[1:])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((name.rpartition("/")[2], url_key(fields.get("WARC-Target-URI", "")), fields["WARC-Date"], page_of(fields["WARC-Record-ID"]), kind, refers, int(http["Content-Length"]), digest, offset, length))
                yield pd.DataFrame(sorted(rows, key=lambda r: r[1:4]), columns=[c.split()[0] for c in CAPTURE.split(", ")]).astype({"refers_to": "Int64"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInPandas(run, CAPTURE)


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so each next item costs one path of log2(k) matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        self.top = self._play(1) if len(runs) > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        ra, rb = self.runs[a], self.runs[b]
        if self.at[a] >= len(ra):
            return False
        return self.at[b] >= len(rb) or (ra[self.at[a]], a) < (rb[self.at[b]], b)

    def _play(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position in it) of every item in merged order."""
        k = len(self.runs)
        for _ in range(sum(map(len, self.runs))):
            best = self.top
            yield best, self.at[best]
            self.at[best] += 1
            node = (best + k) // 2
            while node:
                if self._less(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.top = best


def merged_index(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """The captures in global order: shard numbers the ranges in order, position counts from 0 in each."""
    spark = runs.sparkSession
    n = max(partitions(spark), -(-runs.count() // captures_per_range))
    order = ["url_key", "captured", "id", "run", "record_offset"]

    def merge(frames):
        # a range holds a bounded number of captures; they arrive run by run
        pdf = pd.concat(list(frames) or [pd.DataFrame()], ignore_index=True)
        if not len(pdf):
            return
        cuts = np.flatnonzero(pdf["run"].to_numpy()[1:] != pdf["run"].to_numpy()[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        keys = list(zip(pdf["url_key"], pdf["captured"], pdf["id"]))
        tree = LoserTree([keys[a:b] for a, b in zip(bounds, bounds[1:])])
        out = pdf.iloc[[bounds[run] + at for run, at in tree]].reset_index(drop=True)
        out["shard"], out["position"] = TaskContext.get().partitionId(), np.arange(len(out))
        yield out

    dealt = runs.repartitionByRange(n, *order).sortWithinPartitions("run", *order[:3], "record_offset")
    return dealt.mapInPandas(merge, CAPTURE + ", shard int, position long")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Archive all pages, read the archives back and return the merged capture index."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, min_revisit_bytes)
    index = merged_index(written(capture_runs(spark, path), "capture-runs"))
    return index.select(
        real_id("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", real_id("refers_to").alias("refers_to"),
        "url_key", "captured", "shard", "position", F.col("run").alias("archive"), "record_offset", "record_length",
    )
