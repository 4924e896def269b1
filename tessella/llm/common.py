"""Shared pieces of the training-data operators: scratch tables, Arrow batch limits, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task of the local contraction takes at most on average.
EDGES_PER_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting (tests in local mode) a local temp folder serves.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessella-scratch")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Scratch folders of this process that haven't been deleted.
_MADE: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def made() -> int:
    """A mark: how many scratch folders there are now."""
    return len(_MADE)


def drop_tables(*tables: DataFrame) -> None:
    """Delete the scratch folders of materialised tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            delete(df.sparkSession, path)
            _MADE.remove(path)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch folders made after a mark, but those of `keep`: for when a result has been written elsewhere."""
    kept = {getattr(df, "_scratch", None) for df in keep}
    for path in [p for p in _MADE[since:] if p not in kept]:
        delete(spark, path)
        _MADE.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows and bytes, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


#: Rows of a lookup table that may be broadcast (up to some hundred bytes each); a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks: extra input columns may clash with ours."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def clear_prefix(df: DataFrame, *names: str) -> str:
    """A prefix with which none of these names clashes with a column of df."""
    prefix = "__"
    while any(fresh(df, prefix + n) != prefix + n for n in names):
        prefix += "_"
    return prefix


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: one row (child, parent) for each node that isn't its tree's least."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                up.setdefault(min(ra, rb), min(ra, rb))
    pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["child", "parent"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, root), root being the least node reached.

    Nodes without an edge have no row, and the least node of a component has none either. Rounds of local contraction
    (union-find within each hash partition of the children) and pointer jumping, each written to the shared folder;
    the depth halves each round. No link or component is brought to the driver, only two counts a round.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a <> b")
    shape = "child long, parent long"
    before = current = materialise(pairs.mapInArrow(_forest, shape), name)
    while True:
        tasks = max(1, -(-current.count() // EDGES_PER_TASK))
        merged = materialise(current.repartition(tasks, "child").mapInArrow(_forest, shape), name)
        drop_tables(before)
        up = merged.select(F.col("child").alias("node"), F.col("parent").alias("above"))
        jumped = materialise(merged.join(up, merged.parent == up.node, "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), name)
        state = jumped.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("child").alias("children"), F.max(F.col("moved").cast("int")).alias("moved")).first()
        drop_tables(merged)
        before, current = jumped, jumped.select("child", "parent")
        if not state.moved and state.n == state.children:
            return current.select(F.col("child").alias("node"), F.col("parent").alias("root"))
