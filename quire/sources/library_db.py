"""A library kept in SQLite files, read-only: a Python data source and the Library over it."""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quire.plans.library import SCHEMAS, Library

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def connect(path: str) -> sqlite3.Connection:
    out = sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True, timeout=10)
    out.execute("PRAGMA query_only=1")
    return out


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.name, self.parts = schema, options["path"], options["table"], int(options.get("partitions", "1"))
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"bad table name {self.name!r}")

    def partitions(self) -> list[_Rows]:
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.name}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        kinds = [f.dataType.typeName() for f in self.schema.fields]
        make = {"boolean": bool, "double": float, "integer": int, "long": int, "string": str}
        with connect(self.path) as db:
            columns = ", ".join(f'"{f.name}"' for f in self.schema.fields)
            for row in db.execute(f"SELECT {columns} FROM {self.name} WHERE rowid BETWEEN ? AND ?", (part.low, part.high)):
                yield tuple(None if v is None else make.get(k, lambda x: x)(v) for v, k in zip(row, kinds, strict=True))


class LibraryDb(DataSource):
    """spark.read.format("librarydb").schema(...).option("path", file).option("table", name)"""

    @classmethod
    def name(cls) -> str:
        return "librarydb"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def _present(path: str) -> dict[str, list[str]]:
    with connect(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")]
        return {n: [r[1] for r in db.execute(f'PRAGMA table_info("{n}")')] for n in names if _NAME.fullmatch(n)}


def open_library(spark: SparkSession, path: str, name: str = "library", notes_path: str | None = None, text_path: str | None = None, partitions: int = 1) -> Library:
    """Tables that a file lacks read as empty; so do optional files that don't exist."""
    spark.dataSource.register(LibraryDb)
    read = lambda file, table, schema: spark.read.format("librarydb").schema(schema).option("path", file).option("table", table).option("partitions", str(partitions)).load()
    tables, found = {}, {f: _present(f) for f in (path, notes_path, text_path) if f and os.path.exists(f)}
    for file, names in found.items():
        for table, schema in SCHEMAS.items():
            if table in names and set(names[table]) >= {c.split()[0] for c in schema.split(", ")}:
                tables[table] = read(file, table, schema)
            elif table in names:
                kept = [c for c in schema.split(", ") if c.split()[0] in names[table]]
                part = read(file, table, ", ".join(kept))
                from pyspark.sql import functions as F

                tables[table] = part.select(*[c.split()[0] if c in kept else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    out = Library(spark, tables, name)
    kinds = {"int": "long", "float": "double", "rating": "long", "bool": "long"}
    for row in out.table("custom_columns").collect():
        values, link, here = f"custom_column_{row['id']}", f"books_custom_column_{row['id']}_link", found[path]
        if values in here:
            kind = kinds.get(row["datatype"], "string")
            extra = ", extra double" if link in here and "extra" in here[link] else ""
            linked = read(path, link, "id long, book long, value long" + extra) if link in here else None
            out.custom = {**out.custom, row["id"]: (read(path, values, f"id long, value {kind}" if linked is not None else f"id long, book long, value {kind}"), linked)}
    return out
