"""Results and tables that are kept in the shared folder until what they were made of changes.

A version names the files that something was made of: their paths, lengths and modification times.  What is stored
under a name and a version is read back while the version is the same; a new version replaces it.  Tables are written
whole under a name of their own before they count (Spark's _SUCCESS), so a torn write is never read, and two writers of
one version do no harm.  Past `most` names the ones unused for longest go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming.live import root_of
from .query import Compiled, QuerySpec

#: Changes when stored tables of the same files would come out different.
CODE = "3"
MOST = 128


class Store:
    def __init__(self, spark: SparkSession, folder: str | None = None, most: int = MOST):
        self.spark, self.most = spark, most
        self.folder = (folder or f"{root_of(spark)}/kept").rstrip("/")
        self.made = 0  # what had to be computed

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list:
        fs = self._fs(path)
        return list(fs.listStatus(self._path(path))) if fs.exists(self._path(path)) else []

    def version_of(self, *paths: str) -> str:
        """What the files at paths, or below them, are now."""
        found, todo = [], list(paths)
        while todo:
            path = todo.pop()
            status = self._fs(path).getFileStatus(self._path(path))
            if status.isDirectory():
                todo += [s.getPath().toString() for s in self._listed(path) if not s.getPath().getName().startswith(("_", "."))]
            else:
                found.append(f"{status.getPath().toString()} {status.getLen()} {status.getModificationTime()}")
        return hashlib.sha256("\n".join([CODE, *sorted(found)]).encode()).hexdigest()[:32]

    def table(self, name: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name and version: as stored, or made and stored now."""
        home = f"{self.folder}/{hashlib.sha256(name.encode()).hexdigest()[:32]}"
        fs = self._fs(home)
        parts = {s.getPath().getName(): s for s in self._listed(home)}
        whole = sorted(n for n in parts if n.startswith(f"{version}-") and fs.exists(self._path(f"{home}/{n}/_SUCCESS")))
        if not whole:
            whole = [f"{version}-{uuid.uuid4().hex}"]
            make().write.parquet(f"{home}/{whole[0]}")
            self.made += 1
            for old in parts:  # of other versions, or torn
                fs.delete(self._path(f"{home}/{old}"), True)
        fs.setTimes(self._path(f"{home}/{whole[0]}/_SUCCESS"), self._now(), -1)
        self.sweep()
        return self.spark.read.parquet(f"{home}/{whole[0]}")

    def _now(self) -> int:
        return self.spark._jvm.System.currentTimeMillis()

    def _used(self, home: str) -> int:
        times = [f.getModificationTime() for p in self._listed(home) for f in self._listed(p.getPath().toString()) if f.getPath().getName() == "_SUCCESS"]
        return max(times, default=0)

    def names(self) -> list[str]:
        return [s.getPath().toString() for s in self._listed(self.folder)]

    def sweep(self) -> int:
        """How many names went because there are more than `most`."""
        names = self.names()
        if len(names) <= self.most:
            return 0
        gone = sorted(names, key=self._used)[: len(names) - self.most]
        for home in gone:
            self._fs(home).delete(self._path(home), True)
        return len(gone)


def cached(store: Store, spec: QuerySpec, version: str, compute: Callable[[QuerySpec], Compiled]) -> Compiled:
    """The result of a query over data of that version; equal specs have one entry."""
    held: list[Compiled] = []

    def made() -> Compiled:
        if not held:
            held.append(compute(spec))
        return held[0]

    text = spec.to_json()
    rows = store.table(f"rows {text}", version, lambda: made().rows)
    series = None
    if spec.bucketSeconds and (spec.source in ("damage", "tanking", "healing", "experience", "faction", "loot")):
        series = store.table(f"series {text}", version, lambda: made().series)
    return Compiled(rows, series)
