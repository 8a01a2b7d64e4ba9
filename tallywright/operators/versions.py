"""Stored tables by name: each write is a new version beside the old ones, and readers take the newest whole one.

A version is a Parquet folder that Spark marks when all of it is there, so a write that
fails leaves the version before it in place, and a reader that has begun goes on with
what it began with.  Two writers of one version cannot both succeed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DONE = "_SUCCESS"


class Store:
    """Tables under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, version: int | None = None):  # noqa: ANN202
        below = f"/v{version:08d}" if version is not None else ""
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}{below}")

    def _files(self):  # noqa: ANN202
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        files, path = self._files(), self._path(name)
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit())

    def versions(self, name: str) -> list[int]:
        """Whole versions, the newest last."""
        files = self._files()
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return [v for v in self._numbers(name) if files.exists(mark(self._path(name, v), DONE))]

    def names(self) -> list[str]:
        files, path = self._files(), self._path("")
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if self.versions(n))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        known = self.versions(name)
        if not known or version not in (None, *known):
            raise KeyError(f"no table {name}" if not known else f"no version {version} of {name}")
        return self.spark.read.parquet(self._path(name, known[-1] if version is None else version).toString())

    def lookup(self, name: str, **key: object) -> DataFrame:
        """Rows whose columns have these values; the conditions reach the scan."""
        rows = self.table(name)
        for column, value in key.items():
            rows = rows.where(F.col(column) == value)
        return rows

    def write(self, name: str, rows: DataFrame) -> int:
        """A new version of the table; ``rows`` may come from the one before."""
        version = max(self._numbers(name), default=0) + 1
        rows.write.mode("errorifexists").parquet(self._path(name, version).toString())
        return version

    def create(self, name: str, schema: T.StructType | str) -> int:
        """An empty table if there is none, else what there is with columns that it lacks, null in all rows.

        Columns of another type than asked for are an error, columns not asked for stay; where
        nothing is lacking, nothing is written.
        """
        wanted = self.spark.createDataFrame([], schema)
        if not self.versions(name):
            return self.write(name, wanted)
        held = self.table(name)
        types = {f.name: f.dataType for f in held.schema}
        wrong = [f.name for f in wanted.schema if f.name in types and types[f.name] != f.dataType]
        if wrong:
            raise ValueError(f"columns of another type: {', '.join(wrong)}")
        lacking = [f for f in wanted.schema if f.name not in types]
        if not lacking:
            return self.versions(name)[-1]
        return self.write(name, held.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking]))

    def keep(self, name: str, newest: int) -> None:
        """Removes all but the newest whole versions, and what failed writes before them left."""
        stay = self.versions(name)[-newest:]
        for version in self._numbers(name):
            if stay and version < stay[-1] and version not in stay:
                self._files().delete(self._path(name, version), True)

    def reset(self, *names: str) -> list[str]:
        """Removes tables, all of them if none is named; what was removed."""
        gone = [n for n in (names or self.names()) if self._numbers(n)]
        for name in gone:
            self._files().delete(self._path(name), True)
        return gone
