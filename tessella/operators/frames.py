"""RANGE frames: aggregates over the rows whose order value lies within a distance of the row's own, by partition or over all rows.

By partition it is Spark's window. Over all rows the rows are range-partitioned by the order value and numbered in blocks; a
row also goes to each other block in whose frames it stands, which the blocks' least and greatest values tell, so a task holds a
block and its halo. Rows without an order value are one another's frame: one aggregate, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.values import INTEGER, PlanError, Value, kind_of, number, quoted

from .ordered_joins import _blocks, _in_blocks, _ranges
from .relation import Relation
from .windows import checkpointed

OPERATIONS = ("sum", "avg", "count", "min", "max")
#: What SQL calls EXCLUDE NO OTHERS, CURRENT ROW and GROUP.
EXCLUDES = ("none", "current", "group")

#: A bound of doubles lies within this share of its terms of the exact one; a row too many in a block is left out by its frames.
ROUNDING = 2.0**-50


def _key(df: DataFrame, order: str) -> tuple[Column, int]:
    """The order value as a number, and its units: microseconds in a second of a timestamp, days of a date, else 1."""
    kind = df.schema[order].dataType
    c = quoted(order)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long"), 1
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")), 1_000_000
    value = number(Value(c, kind_of(kind)), "RANGE order")
    return (c.cast("long"), 1) if value.kind == INTEGER else (value.column.cast("double"), 1)


def _aggregates(operation: str, over: str, exclude: str) -> Column:
    """The frame's aggregate of `x`; sums and counts leave rows out by subtracting them."""
    if operation in ("min", "max"):
        return F.expr(f"{operation}(x) over ({over})")
    total, n = F.expr(f"sum(x) over ({over})"), F.expr(f"count(x) over ({over})")
    if exclude != "none":
        peers = over[: over.index(" range ")] + " range between current row and current row"
        less, fewer = (F.expr(f"sum(x) over ({peers})"), F.expr(f"count(x) over ({peers})")) if exclude == "group" else (F.col("x"), F.col("x").isNotNull().cast("long"))
        total, n = F.coalesce(total, F.lit(0)) - F.coalesce(less, F.lit(0)), n - fewer
    if operation == "count":
        return n
    return F.when(n > 0, total if operation == "sum" else total.cast("double") / n)


def range_frame(r: Relation, operation: str, source: str, order: str, before: float, after: float, output: str, partition: list[str], exclude: str = "none") -> Relation:
    """r with the aggregate of `source` over the rows from `before` below to `after` above the row's own order value.

    Distances are numbers, of timestamps in seconds and of dates in days. Null values don't count; an empty frame gives null, or a
    count of 0. A row without an order value has the rows without one for its frame.
    """
    if operation not in OPERATIONS or exclude not in EXCLUDES or (exclude != "none" and operation in ("min", "max")):
        raise PlanError(f"unsupported RANGE aggregate: {operation} excluding {exclude}")
    if min(before, after) < 0:
        raise PlanError("RANGE distances can't be negative")
    fields = r.fields
    key, units = _key(r.df, order)
    x = Value(quoted(source), r.kinds[source])
    x = number(x, operation) if operation in ("sum", "avg") else x
    rows = r.df.select(*[quoted(f).alias(f"c{i}") for i, f in enumerate(fields)], key.alias("key"), x.column.alias("x"))
    whole = rows.schema["key"].dataType == T.LongType()
    far = [int(d * units) if whole else float(d) for d in (before, after)]
    frame = f"order by key range between {far[0]}{'L' if whole else 'D'} preceding and {far[1]}{'L' if whole else 'D'} following"
    if partition:
        over = f"partition by {', '.join(f'c{fields.index(p)}' for p in partition)} {frame}"
        done = rows.withColumn("out", _aggregates(operation, over, exclude))
    else:
        done = _over_all(rows, frame, far, operation, exclude)
    kept = [f for f in fields if f != output]
    shape = [*fields] if output in fields else [*fields, output]
    named = done.select(*[F.col(f"c{fields.index(f)}").alias(f) for f in kept], F.col("out").alias(output))
    return r.with_df(named.select(*[quoted(f) for f in shape]))


def _over_all(rows: DataFrame, frame: str, far: list, operation: str, exclude: str) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("key", "x")]
    placed = checkpointed(_in_blocks(rows.where("key is not null"), ["key"]))
    blocks = checkpointed(_blocks(placed, [], "key"))
    # whose frames a row stands in is told from their side (key + after), which may round otherwise than key - after does
    slack = F.lit(0) if isinstance(far[0], int) else F.when(F.abs("key") < float("inf"), (F.abs("key") + max(far)) * ROUNDING).otherwise(0.0)
    reach = placed.withColumnRenamed("block", "home").withColumns({"from": F.col("key") - F.lit(far[1]) - slack, "to": F.col("key") + F.lit(far[0]) + slack})
    spread = _ranges(reach, [], blocks, "from", "to")
    done = spread.withColumn("out", _aggregates(operation, f"partition by block {frame}", exclude)).where("block = home").select(*columns, "out")
    null = rows.where("key is null")
    total = null.agg(F.sum("x").alias("s") if operation in ("sum", "avg") else F.lit(None).alias("s"), F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    n = F.col("n") - (F.lit(0) if exclude == "none" else F.col("x").isNotNull().cast("long") if exclude == "current" else F.col("n"))
    s = F.col("s") - F.coalesce(F.col("x"), F.lit(0)) if exclude == "current" and operation in ("sum", "avg") else F.col("s")
    value = {"count": n, "sum": F.when(n > 0, s), "avg": F.when(n > 0, s.cast("double") / n), "min": F.col("least"), "max": F.col("most")}[operation]
    return done.unionByName(null.join(F.broadcast(total)).select(*columns, value.alias("out")))  # one row
