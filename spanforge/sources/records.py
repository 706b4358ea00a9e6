"""The record cache: parsed events of a log on disk, which the next reading continues instead of starting again.

A cache is a folder of Parquet parts and a manifest for each state.  A manifest names the log, the parser that wrote it,
how far the log was parsed (the end of a line), hashes of the log's first bytes and of those before that point, and its
parts with their lengths.  It is written last, under its number: a part without a manifest, or a manifest that isn't
whole, doesn't count, and of two that are the newer one does.

Reading a log whose cache holds parses the bytes after that point alone and adds a part.  The cache holds if parser and
mode are the same, the log is at least as long, both hashes agree and every part has its length; otherwise the log is
parsed from its start and the older parts go.  Bytes after the last line end belong to the next reading.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar
from . import tail

#: Changes when the parser would make other events of the same lines.
PARSER = 3
#: Bytes before the parsed point that a cache answers for.
TAIL = 4096


@dataclass(frozen=True)
class Manifest:
    path: str
    parser: int
    emu: bool
    parsed: int
    head: str
    tail: str
    parts: dict[str, int]  # folder of a part: bytes of its files


class RecordCache:
    def __init__(self, spark: SparkSession, folder: str, log: str, session_id: str, owner: Column | None = None, emu: bool = False):
        self.spark, self.folder, self.log, self.session_id, self.owner, self.emu = spark, folder.rstrip("/"), log, session_id, owner, emu
        self.fs, self.root = tail.opened(self.folder)
        self.log_fs, self.log_path = tail.opened(log)
        self.parsed = 0  # bytes that the last reading had to parse

    def _hash(self, at: int, n: int) -> str:
        return hashlib.sha256(tail.read_at(self.log_fs, self.log_path, at, n)).hexdigest()

    def _hashes(self, parsed: int) -> tuple[str, str]:
        return self._hash(0, min(parsed, tail.HEAD)), self._hash(max(0, parsed - TAIL), min(parsed, TAIL))

    def _numbers(self) -> list[int]:
        infos = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(i.base_name[9:-5]) for i in infos if i.base_name.startswith("manifest-") and i.base_name.endswith(".json"))

    def manifest(self) -> Manifest | None:
        """The newest whole manifest."""
        for n in reversed(self._numbers()):
            name = f"{self.root}/manifest-{n:09d}.json"
            try:
                return Manifest(**json.loads(tail.read_at(self.fs, name, 0, tail.size_of(self.fs, name) or 0)))
            except (ValueError, TypeError):
                continue
        return None

    def _bytes(self, part: str) -> int:
        infos = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{part}", allow_not_found=True))
        return sum(i.size for i in infos if i.type == pafs.FileType.File and i.base_name.endswith(".parquet"))

    def holds(self, m: Manifest | None, size: int) -> bool:
        if m is None or (m.path, m.parser, m.emu) != (self.log, PARSER, self.emu) or size < m.parsed:
            return False
        return (m.head, m.tail) == self._hashes(m.parsed) and all(self._bytes(p) == n for p, n in m.parts.items())

    def _parse(self, begin: int) -> DataFrame:
        tail.register(self.spark)
        lines = self.spark.read.format("log_tail").option("begin", begin).load(self.log)
        return grammar.parse_text(lines.withColumn("session_id", F.lit(self.session_id)), self.owner, self.emu)

    def events(self) -> DataFrame:
        """All events up to the log's last line end, of which only those after the parsed point are parsed now."""
        size = tail.size_of(self.log_fs, self.log_path)
        if size is None:
            raise FileNotFoundError(self.log)
        m = self.manifest()
        held = self.holds(m, size)
        begin = m.parsed if held else 0
        end = tail.last_line_end(self.log_fs, self.log_path, begin, size)
        parts = dict(m.parts) if held else {}
        self.parsed = end - begin
        if not held or end > begin:
            if end > begin or not parts:
                part = f"part-{uuid.uuid4().hex}"
                # the log may have grown meanwhile; what lies beyond the end is for the next reading
                number = F.shiftright("line_no", 12)
                self._parse(begin).where(number < end).write.parquet(f"{self.folder}/{part}")
                parts[part] = self._bytes(part)
            head, before = self._hashes(end)
            self._commit(Manifest(self.log, PARSER, self.emu, end, head, before, parts))
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])

    def _commit(self, m: Manifest) -> None:
        numbers = self._numbers()
        name = f"{self.root}/manifest-{(numbers[-1] + 1 if numbers else 0):09d}.json"
        with self.fs.open_output_stream(name + ".new") as out:
            out.write(json.dumps(asdict(m)).encode())
        self.fs.move(name + ".new", name)
        for n in numbers:
            self.fs.delete_file(f"{self.root}/manifest-{n:09d}.json")
        for i in self.fs.get_file_info(pafs.FileSelector(self.root)):
            if i.base_name.startswith("part-") and i.base_name not in m.parts:
                self.fs.delete_dir(i.path)
