"""A data source for tables of SQLite files: spark.read.format("sqlitefile").option("path", glob).option("table", name)."""

from __future__ import annotations

import glob
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.table, self.glob = options["table"], options["path"]
        if not re.fullmatch(r"\w+", self.table):
            raise ValueError("a table has a plain name")

    def partitions(self) -> list[_File]:
        return [_File(p) for p in sorted(glob.glob(self.glob))]

    def read(self, partition: _File) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            there = {r[1] for r in con.execute(f"PRAGMA table_info({self.table})")}
            if not there:
                return
            columns = ", ".join(f'"{n}"' if n in there else "NULL" for n in self.names if n != "db_file")  # older files lack newer columns
            for row in con.execute(f"SELECT {columns} FROM {self.table}"):
                it = iter(row)
                yield tuple(partition.path if n == "db_file" else next(it) for n in self.names)
        finally:
            con.close()


class SqliteFiles(DataSource):
    """Files of the glob are read side by side, one task each; a column db_file, if in the schema, names the file."""

    @classmethod
    def name(cls) -> str:
        return "sqlitefile"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteFiles)
