"""Tables of SQLite files as a data source: read only, in ranges of rowids, by one snapshot a range.

``register(spark)`` once, then
``spark.read.format("sqlite_table").option("path", file).option("table", name).load()``.
The file must be readable by every executor.  Columns have their declared kind:
integers as long, reals as double, blobs as binary, the rest as text.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

from marlinspike.plans.shipping import ship

#: Rows of one range, about.
RANGE_ROWS = 50_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _kind(declared: str) -> DataType:
    """The column affinity rules of the format."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d or not d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str):
        self.schema, self.path, self.table = schema, path, table

    def partitions(self) -> list[Range]:
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        finally:
            con.close()
        if low is None:
            return [Range(0, -1)]
        return [Range(a, min(a + RANGE_ROWS - 1, high)) for a in range(low, high + 1, RANGE_ROWS)]

    def read(self, partition: Range) -> Iterator[tuple]:
        con = _open(self.path)
        try:
            fields = ", ".join(_name(f.name) for f in self.schema.fields)
            for row in con.execute(f"SELECT {fields} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(_cast(v, f.dataType) for v, f in zip(row, self.schema.fields))
        finally:
            con.close()


def _cast(value: object, kind: DataType) -> object:
    """A value as its column's kind; what does not fit a number is null."""
    if value is None:
        return None
    if isinstance(kind, BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    if isinstance(kind, StringType):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    try:
        return int(value) if isinstance(kind, LongType) else float(value)
    except (TypeError, ValueError):
        return None


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        con = _open(self.options["path"])
        try:
            columns = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(c[1], _kind(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options["path"], self.options["table"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SqliteTable)
