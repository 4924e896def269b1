"""Tables by name: Parquet folders, YAML table documents, declared keys, health and profiles."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.values import PlanError, quoted

#: Declared type -> Spark type. Decimals are doubles unless a catalog asks for exact ones.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "text": T.StringType(),
    "hllsketch": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "integer": T.LongType(),
    "int": T.LongType(),
    "decimal": T.DoubleType(),
    "numeric": T.DoubleType(),
    "number": T.DoubleType(),
    "float": T.DoubleType(),
    "real": T.DoubleType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


@dataclass
class Table:
    name: str
    path: str | None = None
    schema: T.StructType | None = None
    primary: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign: list[dict] = field(default_factory=list)
    nullable: dict[str, bool] = field(default_factory=dict)
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, tables: list[Table] | None = None):
        self.spark = spark
        self.tables = {t.name: t for t in tables or []}

    @classmethod
    def folder(cls, spark: SparkSession, path: str, names: list[str]) -> Catalog:
        return cls(spark, [Table(n, f"{path}/{n}.parquet") for n in names])

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise PlanError(f"unknown table: {name}")
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        t = self.table(name)
        if t.format == "table":
            return self.spark.table(t.path)
        if t.format == "sqlite":
            from .sqlite import scan

            return scan(self.spark, t)
        reader = self.spark.read.format(t.format).options(**t.options)
        return (reader.schema(t.schema) if t.schema else reader).load(t.path)

    def fields(self, name: str) -> list[str]:
        t = self.table(name)
        return t.schema.fieldNames() if t.schema else self.read(name).columns

    def health(self, names: list[str] | None = None) -> DataFrame:
        """Rows (source, healthy, instances) of these tables; a source that doesn't open has no count."""
        counted: list[DataFrame] = []
        for name in names or list(self.tables):
            ok = self.healthy(name)
            rows = self.read(name).agg(F.count(F.lit(1)).alias("n")) if ok else self.spark.range(1).select(F.lit(None).cast("long").alias("n"))
            counted.append(rows.select(F.lit(name).alias("source"), F.lit(ok).alias("healthy"), F.col("n").alias("instances")))
        return reduce(DataFrame.unionByName, counted)

    def healthy(self, name: str) -> bool:
        """The source opens and yields a row or an empty result."""
        try:
            self.read(name).limit(1).count()
            return True
        except Exception:  # any failure of the source is the answer
            return False


def discover(spark: SparkSession, folder: str, format: str = "parquet") -> list[Table]:
    """The tables of a folder on any file system that Spark reads: each file or folder name.<format>, with its own schema.

    Files of this kind declare no keys, and none are guessed; `is_key` checks a candidate.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    found = []
    for name in sorted(s.getPath().getName() for s in listed):
        if name.endswith("." + format):
            path = f"{folder.rstrip('/')}/{name}"
            schema = spark.read.format(format).load(path).schema
            found.append(Table(name.removesuffix("." + format), path, schema, nullable={f.name: f.nullable for f in schema}, format=format))
    return found


def registered(spark: SparkSession, database: str | None = None) -> list[Table]:
    """The tables that the session's catalog knows."""
    found = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        found.append(Table(t.name, name, spark.table(name).schema, format="table"))
    return found


def is_key(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row (rows, is_unique): whether the fields name each row once and are never null. One grouped count."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & quoted(f).isNotNull()
    n = df.groupBy(*[quoted(f) for f in fields]).agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("whole"))
    once = (F.coalesce(F.max("n"), F.lit(0)) <= 1) & F.coalesce(F.min("whole"), F.lit(True))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), once.alias("is_unique"))


def load_yaml(folder: str) -> list[Table]:
    """Table documents: identity.id, attributes, and keys only where declared. Context documents are no tables unless
    schema.physical says so. Nullability that isn't declared stays unknown."""
    import yaml

    found: dict[str, Table] = {}
    for name in sorted(n for n in os.listdir(folder) if n.endswith((".yaml", ".yml"))):
        with open(os.path.join(folder, name), encoding="utf-8-sig") as f:
            doc = yaml.safe_load(f)
        identity = doc.get("identity") if isinstance(doc, dict) else None
        if not isinstance(identity, dict) or not isinstance(identity.get("id"), str):
            raise PlanError(f"{name}: identity.id is required")
        if identity["id"] in found:
            raise PlanError(f"{name}: duplicate table: {identity['id']}")
        physical = (doc.get("schema") or {}).get("physical", str(identity.get("subtype", "")).lower() != "context")
        if physical:
            found[identity["id"]] = _document(name, doc, identity["id"])
    return list(found.values())


def _document(name: str, doc: dict[str, Any], table: str) -> Table:
    fields, nullable = [], {}
    for a in doc.get("attributes") or []:
        column, kind = a.get("name"), str(a.get("type", "")).lower()
        if not column or kind not in TYPES or column in [f.name for f in fields]:
            raise PlanError(f"{name}: bad or repeated attribute: {column} {kind}")
        fields.append(T.StructField(column, TYPES[kind], True))
        if isinstance(a.get("nullable"), bool):
            nullable[column] = a["nullable"]
    if not fields:
        raise PlanError(f"{name}: a table requires attributes")
    names = [f.name for f in fields]
    keys = [doc.get("primary_keys") or [], *(doc.get("unique_keys") or [])]
    if any(k not in names for key in keys for k in key):
        raise PlanError(f"{name}: a key names an unknown column")
    return Table(table, None, T.StructType(fields), keys[0], keys[1:], doc.get("foreign_keys") or [], nullable)


def profile(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Per field: rows, nulls, distinct values, the largest number of rows that share one value. One pass of unpivoted counts."""
    fields = fields or df.columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), quoted(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    none = F.col("value").isNull()
    return counts.groupBy("field").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"), F.max(F.when(~none, F.col("n"))).alias("most"))
