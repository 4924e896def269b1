"""Window functions over a relation's order, by partition or over all rows.

With window_partition_by each function is a Spark window. Without it, one window would hold all rows in one task, so the rows
are numbered first: they are range-partitioned by the whole order and written once, and a row's number is its place in its
part and the sizes of the parts before. Blocks of BLOCK numbers are the windows then: what a frame of fixed length needs from
the neighbouring blocks is copied to them, and running values start from the blocks before, a row for each block.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.expressions import compile_expression
from tessella.functions.values import INTEGER, NUMBER, PlanError, Value, number, quoted

from .relation import Relation

BLOCK = 100_000
RUNNING = {"cumsum": F.sum, "cummax": F.max, "cummin": F.min}
ROLLING = {"rolling_mean": F.avg, "rolling_sum": F.sum, "rolling_max": F.max, "rolling_min": F.min}


def _whole(v: Value, name: str, least: int) -> int:
    if not v.is_literal or isinstance(v.literal, bool) or not isinstance(v.literal, int) or v.literal < least:
        raise PlanError(f"{name} takes whole numbers from {least} as literals")
    return v.literal


def _arity(name: str, args: list[Value], least: int, most: int) -> None:
    if not least <= len(args) <= most:
        raise PlanError(f"{name} takes {least} to {most} arguments, not {len(args)}")


def shifted(name: str, args: list[Value]) -> tuple[int, object]:
    """Offset and default of lag or lead."""
    _arity(name, args, 1, 3)
    if any(not a.is_literal for a in args[1:]):
        raise PlanError(f"{name} takes a value and literals")
    return _whole(args[1], name, 0) if len(args) > 1 else 1, args[2].literal if len(args) > 2 else None


def rolled(name: str, args: list[Value]) -> tuple[Value, int, int]:
    """Value, rows and least number of values of a rolling aggregate."""
    _arity(name, args, 2, 3)
    rows = _whole(args[1], name, 1)
    least = _whole(args[2], name, 1) if len(args) > 2 else rows
    if least > rows:
        raise PlanError(f"{name} takes a number of rows and of values needed, at most as many")
    return number(args[0], name), rows, least


def rolling(name: str, x: Value, rows: int, least: int, w) -> Value:
    frame = w.rowsBetween(-(rows - 1), 0)
    found = ROLLING[name](x.column.cast("double")).over(frame)
    return Value(F.when(F.count(x.column).over(frame) >= least, found), NUMBER)


def partitioned(r: Relation, partition: list[str]) -> Callable[[str, list[Value]], Value]:
    """The functions as windows over the partition's rows."""
    by = Window.partitionBy(*[quoted(p) for p in partition])
    w, peers = by.orderBy(*r.total_order()), by.orderBy(*[k.column() for k in r.order])

    def over(name: str, args: list[Value]) -> Value:
        if name in ("row_number", "rank", "dense_rank", "percent_rank"):
            _arity(name, args, 0, 0)
            c = getattr(F, name)().over(w if name == "row_number" else peers)
            return Value(c, NUMBER) if name == "percent_rank" else Value(c.cast("long"), INTEGER)
        if name == "ntile":
            _arity(name, args, 1, 1)
            return Value(F.ntile(_whole(args[0], name, 1)).over(w).cast("long"), INTEGER)
        if name in ("lag", "lead"):
            offset, default = shifted(name, args)
            return Value(getattr(F, name)(args[0].column, offset, default).over(w), args[0].kind)
        if name in ("first_value", "last_value"):
            _arity(name, args, 1, 1)
            frame = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return Value((F.first if name == "first_value" else F.last)(args[0].column).over(frame), args[0].kind)
        if name in RUNNING:
            _arity(name, args, 1, 1)
            x = number(args[0], name)
            total = RUNNING[name](x.column).over(w.rowsBetween(Window.unboundedPreceding, 0))
            return Value(F.when(x.column.isNotNull(), total), x.kind)
        return rolling(name, *rolled(name, args), w)

    return over


#: Folders that `checkpointed` has written in this process and `release` hasn't deleted.
_WRITTEN: list[str] = []


def _root(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; only in local mode a temporary one serves where it names none."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tessella-rows")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the session's folder for checkpoints, and read back; `release` deletes it.

    Types that Parquet lacks are checkpointed by Spark itself.
    """
    spark = df.sparkSession
    if any(isinstance(f.dataType, (T.NullType, T.VariantType, T.CalendarIntervalType)) for f in df.schema):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(_root(spark))
        return df.checkpoint()
    path = f"{_root(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark: how many folders have been written so far."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders written after a mark, once the results that read them are stored elsewhere."""
    for path in _WRITTEN[since:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's number from 0 in the given order, a column of this name. No task holds all rows."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a part
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "__part").withColumn(name, place + F.col("__before")).drop("__part", "__before")


def _with_neighbours(df: DataFrame, reach: int, block: int) -> DataFrame:
    """Each row in its block (`__block`), and again, marked `__copy`, in a neighbouring one that it is within `reach` rows of."""
    home, inside = F.floor(F.col("__row") / block), F.col("__row") % block
    where = lambda b, copy: F.struct(b.alias("b"), F.lit(copy).alias("c"))
    if not reach:
        return df.withColumns({"__block": home, "__copy": F.lit(False)})
    spots = F.array(where(home, False), F.when(inside >= block - reach, where(home + 1, True)), F.when(inside < reach, where(home - 1, True)))
    return df.withColumn("__spot", F.explode(F.filter(spots, lambda s: s.isNotNull()))).withColumns({"__block": F.col("__spot.b"), "__copy": F.col("__spot.c")}).drop("__spot")


def over_all_rows(r: Relation, expression: str, output: str) -> Relation:
    """r with the expression's value, where window functions see all rows in r's order.

    The rows keep their numbers for a next window in the same order.
    """
    w = Window.partitionBy("__block").orderBy("__row")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    starts: list[tuple[str, Column]] = []  # a running aggregate's name and argument: its value over the blocks before
    reach, peers, ends, counted = 0, False, [], False

    def running(aggregate: str, x: Column) -> Column:
        """The aggregate over all rows up to this one: of this block without its copies, and of the blocks before."""
        starts.append((aggregate, x))
        earlier, own = F.col(f"__start{len(starts) - 1}"), RUNNING[aggregate](F.when(~F.col("__copy"), x)).over(upto)
        if aggregate == "cumsum":
            return F.when(own.isNull(), earlier).otherwise(own + F.coalesce(earlier, F.lit(0)))
        return (F.greatest if aggregate == "cummax" else F.least)(own, earlier)

    def over(name: str, args: list[Value]) -> Value:
        nonlocal reach, peers, counted
        row, rows = F.col("__row"), F.col("__rows")
        counted = counted or name in ("percent_rank", "ntile")
        if name == "row_number":
            _arity(name, args, 0, 0)
            return Value((row + 1).cast("long"), INTEGER)
        if name in ("rank", "dense_rank", "percent_rank"):
            _arity(name, args, 0, 0)
            peers = True
            if name == "dense_rank":
                return Value(running("cumsum", F.col("__first").cast("long")), INTEGER)
            rank = running("cummax", F.when(F.col("__first"), row + 1))
            return Value(rank.cast("long"), INTEGER) if name == "rank" else Value(F.when(rows > 1, (rank - 1) / (rows - 1)).otherwise(0.0), NUMBER)
        if name == "ntile":
            _arity(name, args, 1, 1)
            n = _whole(args[0], name, 1)
            width, wide = F.floor(rows / n), rows % n  # the first `wide` tiles have a row more
            at = F.when(row < wide * (width + 1), F.floor(row / (width + 1))).otherwise(wide + F.floor((row - wide * (width + 1)) / F.greatest(width, F.lit(1))))
            return Value((at + 1).cast("long"), INTEGER)
        if name in ("lag", "lead"):
            offset, default = shifted(name, args)
            reach = max(reach, offset)
            return Value(getattr(F, name)(args[0].column, offset, default).over(w), args[0].kind)
        if name in ("first_value", "last_value"):
            _arity(name, args, 1, 1)
            ends.append((F.min_by if name == "first_value" else F.max_by)(F.struct(args[0].column.alias("v")), "__row").alias(f"__end{len(ends)}"))
            return Value(F.col(f"__end{len(ends) - 1}.v"), args[0].kind)
        if name in RUNNING:
            _arity(name, args, 1, 1)
            x = number(args[0], name)
            return Value(F.when(x.column.isNotNull(), running(name, x.column)), x.kind)
        x, n, least = rolled(name, args)
        reach = max(reach, n - 1)
        return rolling(name, x, n, least, w)

    value = compile_expression(expression, r.kinds, over)
    block = max(BLOCK, reach)
    rows = r.placed if r.placed is not None else numbered(r.df, r.total_order(), "__row")
    if peers:
        same = reduce(Column.__and__, [quoted(k.field).eqNullSafe(F.lag(quoted(k.field)).over(w)) for k in r.order])
        rows = _with_neighbours(rows, 1, block).withColumn("__first", (F.col("__row") == 0) | ~same).where("not __copy").drop("__block", "__copy")
    if r.placed is not None and (starts or ends or counted):
        rows = checkpointed(rows)  # read twice below
    spread = _with_neighbours(rows, reach, block)
    if starts:
        sums = rows.groupBy(F.floor(F.col("__row") / block).alias("__block")).agg(*[RUNNING[a](x).alias(f"__part{i}") for i, (a, x) in enumerate(starts)])
        blocks = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        before = sums.select("__block", *[RUNNING[a](f"__part{i}").over(blocks).alias(f"__start{i}") for i, (a, _) in enumerate(starts)])
        spread = spread.join(F.broadcast(before), "__block", "left")
    if ends or counted:
        spread = spread.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__rows"), *ends)))
    fields = [quoted(f) for f in r.fields if f != output]
    done = spread.select(*fields, value.column.alias(output), "__row", "__copy").where("not __copy")
    shape = [quoted(f) for f in ([*r.fields] if output in r.fields else [*r.fields, output])]
    kept = r.order if all(k.field != output for k in r.order) else ()
    return Relation(done.select(*shape), kept, done.select(*shape, "__row") if kept else None)
