"""Logs as byte ranges: a batch and stream source that reads files to their last line end and follows them as they grow.

`spark.read.format("log_tail").load(path)` and `spark.readStream.format("log_tail").load(path)` read one file or the
files of a folder that match `glob`.  Rows are (file, generation, line_no, value): line_no is generation * 2^40 + the
byte where the line starts, so it grows through a file's life; value is the line's bytes without its end.

- A line without its end is held back until the end is there.
- A file that is shorter than what was read of it, or that begins with other bytes, is a new generation and read from its
  start.  What the old one had left is read first if a file of the folder is the old one under another name (rotation).
- A file that is gone is waited for.
- Ranges are cut into splits of `splitBytes`; a split has the lines that start in it.
- `begin` starts a batch of one file at that byte, the start of a line.
- `maxBytes` bounds what a trigger takes of each file; `since` (2024-03-09T20:00:00) starts at the first line stamped
  then or later, found by bisection.

An offset says for each file how far its generations go.  What a generation is (its first bytes, where it is now, how
long it got) stands in a journal in the folder `journal`, written before an offset that depends on it is handed out; so a
query that starts again from its checkpoint reads what it had been promised, and nothing twice.  Without that option
the journal lives as long as the query.

Paths are opened through Arrow's filesystems, so that driver and executors need nothing but the path.  The number of
files is the size of an offset: a source is meant for the logs of a service's hosts, not for a lake of small files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, generation long, line_no long, value binary"
GENERATION = 1 << 40
#: Bytes at a file's start that tell it from another; bytes read at once.
HEAD, BLOCK = 1024, 1 << 22
#: Fixed value: how a line's stamp is written.
STAMP, STAMP_LENGTH = "[%a %b %d %H:%M:%S %Y]", 26


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def size_of(fs: pafs.FileSystem, path: str) -> int | None:
    info = fs.get_file_info(path)
    return info.size if info.type == pafs.FileType.File else None


def read_at(fs: pafs.FileSystem, path: str, at: int, n: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(at)
        return f.read(n)


def fingerprint(fs: pafs.FileSystem, path: str, n: int) -> str:
    return hashlib.sha256(read_at(fs, path, 0, n)).hexdigest()[:32]


def last_line_end(fs: pafs.FileSystem, path: str, low: int, high: int) -> int:
    """The end of the last whole line within [low, high); low if there is none."""
    with fs.open_input_file(path) as f:
        while high > low:
            a = max(low, high - BLOCK)
            f.seek(a)
            at = f.read(high - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            high = a
    return low


def next_line_end(fs: pafs.FileSystem, path: str, at: int, size: int) -> int:
    """The end of the first line that ends at or after at; size if none does."""
    with fs.open_input_file(path) as f:
        while at < size:
            f.seek(at)
            data = f.read(min(BLOCK, size - at))
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
    return size


def stamp_of(line: bytes) -> datetime | None:
    try:
        return datetime.strptime(line[:STAMP_LENGTH].decode("latin-1"), STAMP)
    except ValueError:
        return None


def seek_time(fs: pafs.FileSystem, path: str, size: int, since: datetime) -> int:
    """Where the first line stamped since or later starts, by bisection over the bytes; stamps don't go back."""
    low, high = 0, size
    while low < high:
        middle = (low + high) // 2
        at = next_line_end(fs, path, middle - 1, size) if middle else 0
        stamp = None
        while at < high and stamp is None:  # lines without a stamp belong to the one before
            end = next_line_end(fs, path, at, size)
            stamp = stamp_of(read_at(fs, path, at, STAMP_LENGTH))
            start, at = at, end
        if stamp is None or stamp >= since:
            high = middle
        else:
            low = max(middle + 1, start + 1)
    return next_line_end(fs, path, low - 1, size) if low else 0


@dataclass
class Split(InputPartition):
    file: str
    path: str
    generation: int
    begin: int
    end: int
    after: int  # where the range that the split is cut from begins: always the start of a line


class Files:
    """The files of a source, and the journal of their generations."""

    def __init__(self, options: dict):
        self.fs, self.path = opened(options["path"])
        self.glob = options.get("glob", "*")
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.most = int(options.get("maxbytes", options.get("maxBytes", 0)))
        self.begin = int(options.get("begin", 0))
        self.since = datetime.fromisoformat(options["since"]) if options.get("since") else None
        self.journal_fs, self.journal_path = opened(options["journal"]) if options.get("journal") else (None, None)
        self.journal: dict[str, list[dict]] = self._loaded()

    def _loaded(self) -> dict:
        if self.journal_path is None:
            return {}
        infos = self.journal_fs.get_file_info(pafs.FileSelector(self.journal_path, allow_not_found=True))
        names = sorted(i.path for i in infos if i.base_name.endswith(".json"))
        return json.loads(read_at(self.journal_fs, names[-1], 0, size_of(self.journal_fs, names[-1]))) if names else {}

    def store(self) -> None:
        """A new numbered version under a temporary name first; the newest whole one counts and one older stays."""
        if self.journal_path is None:
            return
        self.journal_fs.create_dir(self.journal_path, recursive=True)
        infos = self.journal_fs.get_file_info(pafs.FileSelector(self.journal_path))
        old = sorted(i.path for i in infos if i.base_name.endswith(".json"))
        number = int(old[-1].rpartition("/")[2][:-5]) + 1 if old else 0
        name = f"{self.journal_path}/{number:012d}.json"
        with self.journal_fs.open_output_stream(name + ".new") as out:
            out.write(json.dumps(self.journal).encode())
        self.journal_fs.move(name + ".new", name)
        for path in old[:-1]:
            self.journal_fs.delete_file(path)

    def listed(self) -> list[str]:
        info = self.fs.get_file_info(self.path)
        if info.type != pafs.FileType.Directory:
            return [self.path]
        here = self.fs.get_file_info(pafs.FileSelector(self.path))
        return sorted(i.path for i in here if i.type == pafs.FileType.File and fnmatch(i.base_name, self.glob) and not i.base_name.startswith(("_", ".")))

    def renamed_from(self, path: str) -> bool:
        """Whether path is what a file of another name used to be."""
        return any(g["path"] == path for name, gens in self.journal.items() if name != path for g in gens)

    def _same(self, generation: dict, path: str, size: int | None) -> bool:
        """Whether the file at path is this generation, as far as its first bytes tell."""
        return size is not None and size >= generation["seen"] and (generation["head_bytes"] == 0 or fingerprint(self.fs, path, generation["head_bytes"]) == generation["head"])

    def _renamed(self, generation: dict, name: str) -> tuple[str, int] | None:
        """Where a generation that its name has left is now."""
        folder = name.rpartition("/")[0]
        if generation["head_bytes"] == 0:
            return None
        for i in self.fs.get_file_info(pafs.FileSelector(folder or ".")):
            if i.type == pafs.FileType.File and i.path != name and self._same(generation, i.path, i.size):
                return i.path, i.size
        return None

    def latest(self) -> dict:
        """The offset of what is there now: {file: {generation, byte}}."""
        changed = False
        listed = self.listed()
        # known files first: what one of them has been renamed to is no file of its own
        for name in [*sorted(self.journal), *(x for x in listed if x not in self.journal)]:
            if self.renamed_from(name):
                continue
            size = size_of(self.fs, name)
            gens = self.journal.setdefault(name, [])
            if not gens:
                if size is None:
                    del self.journal[name]
                    continue
                start = seek_time(self.fs, name, size, self.since) if self.since else min(self.begin, size)
                gens.append({"path": name, "head": "", "head_bytes": 0, "start": start, "seen": start, "end": None})
                changed = True
            now = gens[-1]
            if size is None or not self._same(now, name, size):
                left = self._renamed(now, name)
                if size is None and not left and now["path"] == name:
                    continue  # gone: wait for it
                if left:
                    end = last_line_end(self.fs, left[0], now["seen"], left[1])
                    changed |= (now["path"], now["seen"]) != (left[0], end)
                    now["path"], now["seen"] = left[0], end
                elif now["path"] == name:
                    now["path"] = ""  # cut off where it stood: what wasn't read is lost
                if size is None:
                    continue
                now["end"] = now["seen"]
                now = {"path": name, "head": "", "head_bytes": 0, "start": 0, "seen": 0, "end": None}
                gens.append(now)
                changed = True
            limit = min(size, now["seen"] + self.most) if self.most else size
            end = last_line_end(self.fs, name, now["seen"], limit)
            if end == now["seen"] and limit < size:  # a line longer than a trigger's share
                end = last_line_end(self.fs, name, end, next_line_end(self.fs, name, limit, size))
            if end != now["seen"]:
                now["seen"], changed = end, True
            if now["head_bytes"] < HEAD and now["seen"] > now["head_bytes"]:
                now["head_bytes"] = min(HEAD, now["seen"])
                now["head"] = fingerprint(self.fs, name, now["head_bytes"])
                changed = True
        if changed:
            self.store()
        return {name: {"generation": len(gens) - 1, "byte": gens[-1]["seen"]} for name, gens in self.journal.items()}

    def splits(self, start: dict, end: dict) -> list[Split]:
        out = []
        for name, to in end.items():
            gens = self.journal.get(name, [])
            since = start.get(name)
            for g in range(since["generation"] if since else 0, to["generation"] + 1):
                begin = since["byte"] if since and g == since["generation"] else gens[g]["start"]
                stop = to["byte"] if g == to["generation"] else gens[g]["end"]
                path = gens[g]["path"]
                if path == name and not self._same(gens[g] | {"seen": stop}, name, size_of(self.fs, name)):
                    found = self._renamed(gens[g] | {"seen": stop}, name)
                    path = found[0] if found else ""
                if path:
                    out += [Split(name, path, g, a, min(a + self.split, stop), begin) for a in range(begin, stop, self.split)]
        return out

    def rows(self, s: Split) -> Iterator[pa.RecordBatch]:
        """The lines that start within the split; its range ends with a line end."""
        name = s.file.rpartition("/")[2]
        size = size_of(self.fs, s.path) or 0
        at = s.begin if s.begin == s.after else next_line_end(self.fs, s.path, s.begin - 1, size)
        with self.fs.open_input_file(s.path) as f:
            f.seek(at)
            held = b""
            while at < s.end:
                data = f.read(BLOCK)
                if not data:
                    break
                held += data
                cut = held.rfind(b"\n") + 1
                if cut == 0:
                    continue
                lines = held[: cut - 1].split(b"\n")
                starts, place = [], at
                for line in lines:
                    starts.append(place)
                    place += len(line) + 1
                keep = next((i for i, x in enumerate(starts) if x >= s.end), len(starts)) if place > s.end else len(starts)
                values = [x[:-1] if x.endswith(b"\r") else x for x in lines[:keep]]
                numbers = [s.generation * GENERATION + x for x in starts[:keep]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * keep), pa.array([s.generation] * keep, pa.int64()), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], ["file", "generation", "line_no", "value"])
                held, at = held[cut:], place


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.latest()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return self.files.splits(start, end)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class WholeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = Files({k: v for k, v in options.items() if k.lower() not in ("journal", "maxbytes")})

    def partitions(self) -> list[Split]:
        return self.files.splits({}, self.files.latest())

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition) if partition is not None else iter(())  # Spark makes up a split where there is none


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))

    def reader(self, schema) -> WholeReader:
        return WholeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
