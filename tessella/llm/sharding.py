"""Sharding: size-tiered compaction under a versioned manifest, with DataFrame operations only.

An arrival is appended as small immutable shards without a shuffle. A file's size is its compressed bytes, or its raw bytes
over RAW_FACTOR if that is more; sizes fall into tiers, one for each power of FAN above BASE_BYTES. Compaction cuts each tier
into runs of about the target size and merges a run once it has FAN files (or fills half a target); fewer files wait for
later arrivals, and files of half the target or more are never touched again. So a row is rewritten at most once a tier.

A version is a manifest, a table of live files, written aside under a name of its own; one commit file, put in place only
if there is none, makes it current. Appends and merges that lose this race are based anew on the winner's version; a merge
whose inputs are gone fails. Readers read the files that their version names, so they see all of a version or none of it,
and stray files never. Old versions stay readable until `vacuum`.

Defined cases: an empty arrival adds a version with no files; rows are kept as they are, repeated ones and nulls
included; a row larger than the target is a file of its own kind of size; columns pass through, clashing names avoided.
"""

from __future__ import annotations

import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, fresh, scratch, table

TARGET_BYTES, FAN, BASE_BYTES = 64 << 20, 4, 1 << 20
#: A merged file holds at most about this many times the target in raw bytes, which bounds the task that writes it.
RAW_FACTOR = 3
#: Rows of an arrival's shard at most.
ARRIVAL_ROWS = 20_000
#: Files are planned in groups of about this many, so that no plan is one task's work.
PLAN_FILES = 10_000
BROADCAST_FILES = 50_000
#: Losses of the race for a version after which a writer gives up.
TRIES = 20
MANIFEST = "folder string, file string, tier int, size long, bytes long, raw long, rows long"
_FIELDS = [c.split()[0] for c in MANIFEST.split(", ")]


class Conflict(RuntimeError):
    """Another writer has committed this version, or has merged the files that were to be merged."""


def raw_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row: texts by their length, other fields by eight."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum(wide, F.lit(8 * (len(schema) - len(wide)))).cast("long")


def tier(size: Column) -> Column:
    """0 below BASE_BYTES * FAN, then one more for each power of FAN."""
    return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / BASE_BYTES) / math.log(FAN))).cast("int")


def planned(live: DataFrame, target: int) -> DataFrame:
    """Rows (file, part, tier, run): the files to merge, those of one run of a tier into one file."""
    small = live.where(F.col("size") < target / 2)
    parts = max(1, -(-small.count() // PLAN_FILES))
    group = ["part", "tier"]
    upto = Window.partitionBy(*group).orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    cut = small.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(parts))).withColumn("run", F.floor((F.sum("size").over(upto) - F.col("size")) / target))
    whole = Window.partitionBy(*group, "run")
    judged = cut.withColumns({"files": F.count(F.lit(1)).over(whole), "weight": F.sum("size").over(whole)})
    return judged.where((F.col("files") >= FAN) | ((F.col("files") > 1) & (F.col("weight") >= target / 2))).select("file", *group, "run")


def numbered(plan: DataFrame) -> tuple[DataFrame, int]:
    """plan with `number`, dense over all runs, and how many there are: ranks within a part and the parts' sums before it."""
    ranked = plan.withColumn("rank", F.dense_rank().over(Window.partitionBy("part").orderBy("tier", "run")))
    parts = ranked.groupBy("part").agg(F.max("rank").alias("runs"))
    before = parts.withColumn("before", F.sum("runs").over(Window.orderBy("part")) - F.col("runs"))  # a row for each PLAN_FILES files
    runs = parts.agg(F.sum("runs").alias("n")).first().n or 0
    return ranked.join(F.broadcast(before), "part").select("file", (F.col("before") + F.col("rank") - 1).cast("int").alias("number")), runs


class Store:
    """A folder with data/<folder>/, manifest/<folder>/ and commit/<version>, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self.path = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, names)]))
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    # -- versions -----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        at = self.path("commit")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(at) if s.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def current(self) -> int:
        """The newest version; 0 before the first."""
        return (self.versions() or [0])[-1]

    def named(self, version: int) -> str:
        """The manifest folder that a version's commit file names."""
        stream = self.fs.open(self.path("commit", version))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live files of a version, the current one by default."""
        version = self.current() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self.named(version)}")

    def commit(self, entries: DataFrame, version: int) -> int:
        """Make these entries the given version, or raise Conflict if it exists.

        The commit file is written aside whole, then renamed without overwriting, which HDFS does in one step; on a local
        file system a hard link does.
        """
        name = uuid.uuid4().hex
        files = 1 + entries.limit(BROADCAST_FILES).count() // PLAN_FILES
        entries.select(*_FIELDS).coalesce(files).write.parquet(f"{self.root}/manifest/{name}")
        aside, final = self.path("commit", f".{name}"), self.path("commit", version)
        stream = self.fs.create(aside, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        jvm = self.spark._jvm
        try:
            if self.fs.getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(self.fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(local(final), local(aside))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(aside, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            delete(self.spark, f"{self.root}/manifest/{name}")
            raise Conflict(f"version {version} has been committed by another writer") from e
        finally:
            self.fs.delete(aside, False)
        return version

    def change(self, added: DataFrame, removed: DataFrame | None = None) -> int:
        """Commit the newest version's files without `removed`(file) and with `added`; anew while others win the race."""
        path = f"{self.root}/plan/{uuid.uuid4().hex}"
        added.select(*_FIELDS).write.parquet(path)
        added = self.spark.read.schema(MANIFEST).parquet(path)
        for _ in range(TRIES):
            version = self.current()
            live = self.manifest(version)
            if removed is not None:
                if removed.join(live, "file", "left_anti").limit(1).count():
                    raise Conflict("another writer has merged the same files")
                live = live.join(removed, "file", "left_anti")
            try:
                version = self.commit(live.select(*_FIELDS).unionByName(added), version + 1)
            except Conflict:
                continue
            delete(self.spark, path)
            return version
        raise Conflict(f"lost the race for a version {TRIES} times")

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the newest versions, and delete the data folders of which they name no file."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return
        folders = lambda some: {r.folder for v in some for r in self.manifest(v).select("folder").distinct().collect()}
        for folder in folders(old) - folders(kept):  # one for each arrival or merge since the last vacuum
            delete(self.spark, f"{self.root}/data/{folder}")
        for v in old:
            delete(self.spark, f"{self.root}/manifest/{self.named(v)}")
            self.fs.delete(self.path("commit", v), False)

    # -- data ---------------------------------------------------------------------------------------------------------

    def files(self, folder: str, schema: T.StructType) -> DataFrame:
        """Manifest rows of a folder's files, from the files themselves."""
        read = self.spark.read.schema(schema).parquet(f"{self.root}/data/{folder}")
        found = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), raw_bytes(schema).alias("raw"))
        sums = found.groupBy("file").agg(F.max("bytes").alias("bytes"), F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("rows"))
        sized = sums.withColumn("size", F.greatest(F.col("bytes"), F.ceil(F.col("raw") / RAW_FACTOR)))
        return sized.withColumns({"folder": F.lit(folder), "tier": tier(F.col("size"))}).select(*_FIELDS)

    def put(self, rows: DataFrame) -> str:
        """Write rows as files of a new folder; its name."""
        folder = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return folder

    def append(self, rows: DataFrame) -> int:
        """Add an arrival; the new version."""
        folder = uuid.uuid4().hex
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", ARRIVAL_ROWS).parquet(f"{self.root}/data/{folder}")
        return self.change(self.files(folder, rows.schema))

    def compact(self, schema: T.StructType) -> int:
        """Merge until no tier has a run to merge; the version then current."""
        while self.merge(schema):
            pass
        return self.current()

    def merge(self, schema: T.StructType) -> bool:
        """One pass over all tiers; whether anything was merged. Each merged file is one task's partition."""
        path = f"{self.root}/plan/{uuid.uuid4().hex}"
        plan, runs = numbered(planned(self.manifest(), self.target))
        if not runs:
            return False
        plan.write.parquet(path)
        plan = self.spark.read.schema("file string, number int").parquet(path)
        rows = self.spark.read.schema(schema).parquet(*[r.file for r in plan.select("file").toLocalIterator()])
        file, number = fresh(rows, "file"), fresh(rows, "number")
        to = plan.select(F.col("file").alias(file), F.col("number").alias(number))
        few = plan.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
        dealt = rows.select("*", F.col("_metadata.file_path").alias(file)).join(F.broadcast(to) if few else to, file)
        folder = self.put(dealt.repartitionById(runs, F.col(f"`{number}`")).select(*[F.col(f"`{f.name}`") for f in schema]))
        self.change(self.files(folder, schema), plan.select("file"))
        delete(self.spark, path)
        return True

    def read(self, schema: T.StructType, version: int | None = None) -> tuple[DataFrame, str, str]:
        """A version's rows with a column of their file's name and one of the version; and these columns' names.

        The list of files goes through the driver, as Spark's own index of any table's files does.
        """
        version = self.current() if version is None else version
        names = [r.file for r in self.manifest(version).select("file").toLocalIterator()]
        rows = self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        file, at = fresh(rows, "shard"), fresh(rows, "version")
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)", 1) if names else F.lit(None).cast("string")
        return rows.select(*[F.col(f"`{f.name}`") for f in schema], name.alias(file), F.lit(version).cast("long").alias(at)), file, at


def shard(docs: DataFrame, root: str, target: int = TARGET_BYTES) -> tuple[DataFrame, str, str]:
    store = Store(docs.sparkSession, root, target)
    store.append(docs)
    store.compact(docs.schema)
    return store.read(docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: all rows, with the shard and the manifest version that hold them."""
    return shard(docs, scratch(spark, "shards"))[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are read back through the newest manifest after compaction."""
    docs = table(spark, sf_dir, "documents")
    return shard(docs, scratch(spark, "shards"))[0].select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = "select * from documents"
