"""Folders in versions with one atomic pointer: readers see the old or the new version, never a part of one.

A version is written into a folder of its own under ``data``; it becomes current when its name is put under the next number in
``commits``, by a rename that does not overwrite.  A writer that fails leaves the pointer alone; of two writers that began
with the same version one gets an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made a version since this one began."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self._numbers())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _named(self, number: int) -> str:
        """The folder that a commit points to."""
        stream = self._fs.open(self._path(f"{self.root}/commits/{number:012d}"))
        try:
            return f"{self.root}/data/{self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
        finally:
            stream.close()

    def current(self) -> tuple[int, str | None]:
        """(number, folder) of the current version; (0, None) where there is none."""
        numbers = self._numbers()
        return (numbers[-1], self._named(numbers[-1])) if numbers else (0, None)

    def write(self, save: Callable[[str], None], base: int | None = None) -> int:
        """Makes the version that ``save`` writes into a folder; ``base`` is the version it was made from (None: whichever is current)."""
        if base is None:
            base = self.current()[0]
        name = f"v-{uuid.uuid4().hex}"
        save(f"{self.root}/data/{name}")
        return self._commit(name, base)

    def _commit(self, name: str, base: int) -> int:
        if self.current()[0] != base:
            raise Conflict(f"{self.root} has moved on from version {base}")
        part = self._path(f"{self.root}/commits/.{name}")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        where = self._path(f"{self.root}/commits/{base + 1:012d}")
        if self._fs.exists(where) or not self._fs.rename(part, where):
            self._fs.delete(part, False)
            raise Conflict(f"{self.root} has moved on from version {base}")
        return base + 1

    def update(self, change: Callable[[str | None], Callable[[str], None]]) -> int:
        """``change`` gets the current folder and gives what saves the next version; a conflict is an error."""
        base, folder = self.current()
        return self.write(change(folder), base)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last ``keep`` versions, and what failed writers left; the number of folders removed."""
        numbers = self._numbers()
        kept = {self._named(n).rsplit("/", 1)[1] for n in numbers[-max(1, keep) :]}
        gone = 0
        for n in numbers[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.root}/commits/{n:012d}"), False)
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def write_table(table: DataFrame, root: str, base: int | None = None) -> int:
    """A Parquet table as the next version."""
    return Versions(table.sparkSession, root).write(lambda folder: table.write.parquet(folder), base)


def read_table(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    """The current version of a table, or None."""
    folder = Versions(spark, root).current()[1]
    return spark.read.schema(schema).parquet(folder) if folder else None
