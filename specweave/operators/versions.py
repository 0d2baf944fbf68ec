"""A table of versioned records that several writers may append to: commits are claimed, not just written.

The folder holds data files, which Spark writes, and a log of numbered commits, each naming the data of one append.
A writer numbers its records by what it has read, writes them, and claims the commit after the one it
read by creating that file, which fails if another writer was first. Then it drops its data and begins again from the
new state. Readers see what commits name and nothing else, so a failed or lost write leaves the table as it was.
"""

from __future__ import annotations

import json
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from .publish import append_version


class CommitConflict(Exception):
    """Another writer was first, as often as was tried."""


class VersionTable:
    """Records with a version from 1 within each key, in a folder that all writers share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._folder = self._path(root)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def commits(self) -> list[int]:
        """Numbers of the commits there are, in order."""
        log = self._path(self.root, "_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json") and s.getLen() > 0)

    def _read_commit(self, number: int) -> dict:
        stream = self._fs.open(self._path(self.root, "_log", f"{number:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _claim(self, number: int, what: dict) -> bool:
        """Create a commit, whole, unless it is there: a file under a name of its own that is put in place only where none is."""
        target, own = self._path(self.root, "_log", f"{number:020d}.json"), self._path(self.root, "_log", f".{uuid4().hex}.tmp")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":  # a rename replaces what is there, a link does not
            try:
                Path(target.toUri().getPath()).hardlink_to(own.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
            self._fs.delete(own, False)
            return won
        won = self._fs.rename(own, target)  # shared stores refuse to rename onto a file
        if not won:
            self._fs.delete(own, False)
        return won

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The records of all commits, or of those up to a number; None without any."""
        numbers = [n for n in self.commits() if upto is None or n <= upto]
        folders = [f"{self.root}/{self._read_commit(n)['data']}" for n in numbers]
        return self.spark.read.parquet(*folders) if folders else None

    def append(self, content: DataFrame, by: list[str], attempts: int = 20) -> int:
        """Append ``content``, each row as the next version of its key; the number of the commit.

        A key that ``content`` has more than once is an error, as its rows have no order.
        """
        if not content.groupBy(*by).count().filter("count > 1").isEmpty():
            raise ValueError("a key has several rows in one append")
        for _ in range(attempts):
            last = max(self.commits(), default=0)
            before = self.read(last)
            if before is None:
                before = content.selectExpr("*", "0 as version").limit(0)
            data = f"data/{uuid4().hex}"
            append_version(before, by, content).write.mode("errorifexists").parquet(f"{self.root}/{data}")
            if self._claim(last + 1, {"data": data}):
                return last + 1
            self._fs.delete(self._path(self.root, data), True)
        raise CommitConflict(f"{self.root}: {attempts} attempts")
