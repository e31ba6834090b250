"""A library of stored tables: a folder a table, with parquet parts that are added to or replaced as a whole."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession

from .schema import TABLES


class Catalog:
    """Parts live in <root>/<table>/<version>; a small pointer file names those that make up the current snapshot, so readers of
    an old snapshot are not disturbed and a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, table: str) -> list[str] | None:
        p = self._path(f"{self.root}/{table}/_current")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def initialise(self) -> None:
        """Creates the tables that are not there."""
        for t in TABLES:
            if self._current(t) is None:
                self.save(t, self.spark.createDataFrame([], TABLES[t][0]))

    def reset(self) -> None:
        """Empties all tables."""
        for t in TABLES:
            self.save(t, self.spark.createDataFrame([], TABLES[t][0]))

    def load(self, table: str) -> DataFrame:
        at = self._current(table)
        return self.spark.createDataFrame([], TABLES[table][0]) if at is None else self.spark.read.schema(TABLES[table][0]).parquet(*[f"{self.root}/{table}/{x}" for x in at])

    def save(self, table: str, df: DataFrame) -> None:
        """Stores a snapshot and makes it the current one; columns it lacks are null."""
        self._point(table, [self._write(table, df)])

    def append(self, table: str, df: DataFrame) -> None:
        """Adds rows to the current snapshot; what is stored is not written again."""
        self._point(table, [*(self._current(table) or []), self._write(table, df)])

    def _write(self, table: str, df: DataFrame) -> str:
        at = uuid.uuid4().hex
        empty = self.spark.createDataFrame([], TABLES[table][0])
        empty.unionByName(df.select(*[c for c in df.columns if c in empty.columns]), allowMissingColumns=True).write.parquet(f"{self.root}/{table}/{at}")
        return at

    def _point(self, table: str, parts: list[str]) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{table}/_current"), True)
        try:
            stream.write(bytearray("\n".join(parts).encode()))
        finally:
            stream.close()

    def views(self) -> None:
        """Temporary views of all tables, for spark.sql."""
        for t in TABLES:
            self.load(t).createOrReplaceTempView(t)

    def ledger(self, source_file: str, status: str, imported: int, skipped: int, error: str | None, started: datetime) -> None:
        """Adds an entry to the table of imports."""
        old = self.load("imports")
        top = old.agg({"id": "max"}).first()[0] or 0
        row = Row(id=top + 1, source_file=source_file, status=status, rows_imported=imported, rows_skipped=skipped, error_log=error, started_at=started, completed_at=datetime.now())
        self.append("imports", self.spark.createDataFrame([row], TABLES["imports"][0]))
