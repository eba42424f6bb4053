"""SQLite files as a Python data source: ``spark.read.format("sqlite_files").option("query", ...).schema(...).load(glob)``.

One partition a file. The file is opened read only; WAL and journal beside it are honoured. A file that isn't a database or lacks the table
gives no row, as a missing table gives an empty result everywhere in this engine.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.pattern, self.query, self.schema = options["path"], options["query"], schema

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.pattern, recursive=True))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        own = self.schema.names[0] == "path"
        try:
            with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
                for row in db.execute(self.query):
                    yield (partition.value, *row) if own else tuple(row)
        except sqlite3.DatabaseError:
            return


class SqliteFiles(DataSource):
    """Options: path (a glob), query. A schema must be given; if its first column is ``path``, the file's path comes in front."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteFiles)
