"""Sinks and question lists: CSV, JSON lines, Parquet; a folder appears whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.values import PlanError

FORMATS = ("csv", "json", "parquet", "orc")


def write(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    """Write aside, then rename into place; an existing folder is an error."""
    if format not in FORMATS:
        raise PlanError(f"unsupported sink: {format}")
    spark, aside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to_path(path)):
        raise PlanError(f"the sink exists: {path}")
    if format == "csv":
        options = {"header": True, **options}
    df.write.format(format).options(**options).save(aside)
    if not fs.rename(to_path(aside), to_path(path)):
        raise PlanError(f"the sink can't be renamed to {path}")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question list (CSV with a header, or JSON lines)."""
    return spark.read.csv(path, header=True) if path.lower().endswith(".csv") else spark.read.json(path)


def alias_map(ids: DataFrame, id: str = "id") -> DataFrame:
    """Spellings of compact ids (letters, an optional hyphen, up to four digits) -> the id; spellings of two ids are left out.

    A spelling varies the letters' case, the hyphen and the zero padding.
    """
    real = ids.select(F.col(id).cast("string").alias("id")).where("id is not null").distinct()
    form = r"^([A-Za-z]+)-?(\d{1,4})$"
    prefix, digits = F.regexp_extract("id", form, 1), F.regexp_extract("id", form, 2)
    plain = F.array(F.col("id"), F.lower("id"), F.upper("id"))
    cases = F.array_distinct(F.array(prefix, F.lower(prefix), F.upper(prefix)))
    value = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(3), F.length(digits))), lambda w: F.when(F.length(value) >= w, value).otherwise(F.lpad(value, 4, "0").substr(5 - w, w)))
    made = F.flatten(F.transform(cases, lambda p: F.flatten(F.transform(padded, lambda n: F.array(F.concat(p, n), F.concat(p, F.lit("-"), n))))))
    spelt = real.select("id", F.explode(F.array_distinct(F.when(digits == "", plain).otherwise(F.array_union(plain, made)))).alias("alias"))
    return spelt.groupBy("alias").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("alias", "id")
