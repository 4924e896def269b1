"""SQLite files: their declared tables and keys, and scans by ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import TYPES, Table

#: Rows of a range: one query of one task.
RANGE_ROWS = 50_000


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """A column's type by the word that it is declared with; SQLite's own affinities for the words that TYPES lacks."""
    word = declared.lower().partition("(")[0].strip()
    if word in TYPES:
        return TYPES[word]
    affinities = (("int", T.LongType()), ("char", T.StringType()), ("clob", T.StringType()), ("real", T.DoubleType()), ("floa", T.DoubleType()), ("doub", T.DoubleType()), ("bool", T.BooleanType()), ("date", T.StringType()), ("time", T.StringType()), ("dec", T.DoubleType()), ("num", T.DoubleType()))
    return next((t for part, t in affinities if part in word), T.StringType())


def discover(path: str) -> list[Table]:
    """The tables of a file with declared columns, nullability and keys. Nothing is guessed: a column called id isn't a key,
    and an index proves uniqueness only if it is unique, whole and over columns."""
    with _opened(path) as db:
        rows = lambda pragma, of: db.execute(f"select * from pragma_{pragma}(?)", (of,)).fetchall()
        tables = []
        for (name,) in db.execute("select name from sqlite_schema where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by name").fetchall():
            columns = rows("table_info", name)  # (place, name, type, not null, default, place in the primary key)
            unique = []
            for _, index, is_unique, _, partial in rows("index_list", name):
                parts = [part[2] for part in rows("index_info", index)]
                if is_unique and not partial and parts and None not in parts:
                    unique.append(parts)
            foreign: dict[int, dict] = {}
            for number, _, other, ours, theirs, *_ in rows("foreign_key_list", name):
                link = foreign.setdefault(number, {"columns": [], "table": other, "target": []})
                link["columns"].append(ours)
                link["target"].append(theirs)
            schema = T.StructType([T.StructField(c[1], spark_type(c[2])) for c in columns])
            primary = [c[1] for c in sorted(columns, key=lambda c: c[5]) if c[5]]
            tables.append(Table(name, path, schema, primary, unique, list(foreign.values()), {c[1]: not c[3] for c in columns}, "sqlite"))
    return tables


def scan(spark: SparkSession, table: Table, fields: list[str] | None = None) -> DataFrame:
    """The table's rows: each task reads ranges of row ids, and only the fields asked for.

    The file must be readable under one path by all executors. A table without row ids is read by one task.
    """
    fields = fields or table.schema.fieldNames()
    schema = T.StructType([table.schema[f] for f in fields])
    with _opened(table.path) as db:
        try:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_name(table.name)}").fetchone()
        except sqlite3.OperationalError:
            low = high = None
            whole = True
        else:
            whole = False
    if low is None and not whole:
        return spark.createDataFrame([], schema)
    wanted = f"select {', '.join(map(_name, fields))} from {_name(table.name)}"
    path, times = table.path, {f.name for f in schema if isinstance(f.dataType, (T.DateType, T.TimestampNTZType))}
    read_as = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in schema])
    kinds = {f.name: "Int64" if isinstance(f.dataType, T.LongType) else "boolean" if isinstance(f.dataType, T.BooleanType) else None for f in read_as}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _opened(path) as db:
            for batch in batches:
                for start in batch["id"]:
                    query = wanted if whole else f"{wanted} where rowid >= {start} and rowid < {start + RANGE_ROWS}"
                    frame = pd.DataFrame(db.execute(query).fetchall(), columns=fields)
                    yield frame.astype({f: k for f, k in kinds.items() if k})

    starts = spark.range(0, 1) if whole else spark.range(low, high + 1, RANGE_ROWS)
    rows = starts.mapInPandas(read, read_as)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
