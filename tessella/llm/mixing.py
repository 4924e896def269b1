"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Sources in code-point order, null last, weigh WEIGHTS in turn and share BUDGET times the words of all documents. A target
stops at CAP times its source's words; the excess is shared again by weight until no target is above. Within a source
every document expects target / source_size copies; the running sum of expected copies, moved by one offset of the
source, emits a copy for each integer boundary that it crosses.

Equal rows are one group with a multiplicity, counted before any shuffle, so a group of copies of any size is one entry of
the running sum. Groups are ordered by a digest of the whole row: the digest's range is cut into blocks of about BLOCK
groups, a block's start is the sum of the blocks before it, summed by stretches of BLOCK blocks first, and within a block
the order is by size, so that neighbours that share a copy are alike. A hot doc_id or source is thus many blocks. Offsets
come from a digest of seed and source, so reruns agree.

Defined cases: a null text has no words; a null source is a source of its own; null and repeated doc_ids are like any
other; of equal rows some take a copy more than others; a source without words has target 0 and is not emitted; an empty
table gives no rows; columns pass through and clashing names are avoided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.expressions import compile_expression
from tessella.operators.relation import Relation, SortKey
from tessella.operators.rows import compute
from tessella.operators.windows import partitioned

from .common import BROADCAST_ROWS, bounded, clear_prefix, fresh, materialise, table

WEIGHTS, BUDGET, CAP = (5, 2, 1), 1.5, 2
BLOCK = 1000
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def digits(hexadecimal: Column, count: int) -> Column:
    """The first hex digits as a number."""
    return F.conv(F.substring(hexadecimal, 1, count), 16, 10).cast("long")


def row_digest(docs: DataFrame) -> Column:
    """SHA-256 of a row, each field with its length in bytes before it, or n where it is null."""
    texts = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("n")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def running(df: DataFrame, order: list[SortKey], expression: str, output: str, few: bool) -> DataFrame:
    """df with a window expression over all its rows in this order: one window where they are counted as few, else no task
    holds all of them."""
    r = Relation(df, tuple(order))
    if few:
        return df.withColumn(output, compile_expression(expression, r.kinds, partitioned(r, [])).column)
    return compute(r, expression, output).df


def targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sources(key, source, words) with weight and target."""
    few = sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = [SortKey("source"), SortKey("key")]
    ranked = running(sources, named, "row_number()", "rank", few)
    every = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(every, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).drop("rank")
    capped = weighed.withColumn("cap", F.col("words") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = [SortKey("ratio"), SortKey("key")]
    filled = running(running(capped, filling, "cumsum(cap)", "caps", few), filling, "cumsum(weight)", "weights", few)
    total = sources.agg((F.sum("words") * F.lit(float(budget))).alias("total"))
    all_weights = weighed.agg(F.sum("weight").alias("all_weights"))
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weights") - F.col("weights") + F.col("weight"))
    levels = materialise(filled.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_weights)).withColumn("level", level), "mix-levels")
    # the level of the first source that isn't capped; the levels after it are lower
    flat = levels.agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).alias("flat"))
    reached = levels.crossJoin(F.broadcast(flat))
    return reached.select("key", "source", "words", "weight", F.least(F.col("flat") * F.col("weight"), F.col("cap")).alias("target"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """Rows (digest, doc_id, size, source_size, target, n, place, rate, shift): one for each group of equal rows.

    The i-th of n equal rows (from 0) takes floor(shift + (place + i + 1) * rate) - floor(shift + (place + i) * rate) copies.
    """
    light = docs.select(
        row_digest(docs).alias("digest"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source).cast("string").alias("source"),
    )
    groups = light.groupBy("digest", "doc_id", "size", "source").agg(F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-groups")
    sums = groups.groupBy("key").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("size") * F.col("n")).alias("words"))
    sums = materialise(sums, "mix-sources")
    aims = targets(sums.select("key", "source", "words"), weights, budget, cap)
    rate = F.when(F.col("words") > 0, F.least(F.col("target") / F.col("words"), F.lit(float(cap)))).otherwise(0.0)
    shift = digits(F.md5(F.concat(F.lit(seed), "key")), 8) / F.lit(float(1 << 32))
    known = sums.select("key", F.ceil(F.col("groups") / BLOCK).alias("blocks")).join(aims, "key")
    known = materialise(known.select("key", "blocks", F.col("words").alias("source_size"), "target", rate.alias("rate"), shift.alias("shift")), "mix-targets")
    block = F.floor(digits(F.col("digest"), 8) * F.col("blocks") / float(1 << 32)).cast("long")
    dealt = groups.join(bounded(known), "key").withColumn("block", block).withColumn("stretch", F.floor(F.col("block") / BLOCK))
    blocks = materialise(dealt.groupBy("key", "stretch", "block").agg(F.sum("n").alias("rows")), "mix-blocks")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    stretches = blocks.groupBy("key", "stretch").agg(F.sum("rows").alias("rows"))
    stretches = stretches.select("key", "stretch", F.coalesce(F.sum("rows").over(before("key", "stretch")), F.lit(0)).alias("start"))  # a row for BLOCK squared groups
    inner = F.coalesce(F.sum("rows").over(before("key", "stretch", "block")), F.lit(0))
    begins = blocks.withColumn("inner", inner).join(bounded(stretches), ["key", "stretch"]).select("key", "block", (F.col("start") + F.col("inner")).alias("begin"))
    placed = dealt.join(bounded(materialise(begins, "mix-begins")), ["key", "block"])
    earlier = Window.partitionBy("key", "block").orderBy("size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("begin") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return placed.select("digest", "doc_id", "size", "source_size", "target", "n", place.alias("place"), "rate", "shift")


def passed(at: Column) -> Column:
    """Integer boundaries that the running sum of expected copies has crossed after so many rows."""
    return F.floor(F.col("shift") + at * F.col("rate")).cast("long")


def repeated(df: DataFrame, times: Column, index: str) -> DataFrame:
    """Each row as often as it says, numbered from 0 in a column; a row of many repeats is first cut and dealt anew."""
    piece, count = clear_prefix(df, "piece", "times") + "piece", clear_prefix(df, "piece", "times") + "times"
    counted = df.withColumn(count, times.cast("long")).where(F.col(count) > 0)
    few = counted.where(F.col(count) <= BLOCK).withColumn(piece, F.lit(0).cast("long"))
    many = counted.where(F.col(count) > BLOCK).withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / BLOCK)))).repartition(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], piece))
    end = F.least(F.col(count), (F.col(piece) + 1) * BLOCK) - 1
    return few.unionByName(many).withColumn(index, F.explode(F.sequence(F.col(piece) * BLOCK, end))).drop(piece, count)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, size, source_size, target, copies): one for each row of docs."""
    rows = repeated(plan(docs, **options), F.col("n"), "i")
    return rows.select("doc_id", "size", "source_size", "target", (passed(F.col("place") + F.col("i") + 1) - passed(F.col("place") + F.col("i"))).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it.

    One row of each group of equal rows travels, found before the shuffle, and is repeated as often as the group takes.
    """
    digest, row, times, index = (fresh(docs, c) for c in ("digest", "row", "times", "index"))
    taken = plan(docs, **options).select(F.col("digest").alias(digest), (passed(F.col("place") + F.col("n")) - passed(F.col("place"))).alias(times), "n")
    taken = materialise(taken.where(F.col(times) > 0), "mix-taken")
    marked = docs.withColumn(digest, row_digest(docs))
    once = marked.join(taken.where("n = 1").select(digest, times).hint("shuffle_hash"), digest).drop(digest)
    copies = marked.join(bounded(taken.where("n > 1").select(digest, times)), digest)
    first = copies.groupBy(digest, times).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row)).select(f"{row}.*", times)
    return repeated(once.unionByName(first), F.col(times), index).select(*[F.col(f"`{c}`") for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with its columns."""
    return mixed(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _field(c: str) -> str:
    return f"case when {c} is null then 'n' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"


SQL = rf"""
with docs as (
  select doc_id, source, coalesce('=' || source, '') as key, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size,
    sha256({_field('doc_id')} || {_field('text')} || {_field('source')}) as digest
  from documents),
sources as (select key, source, count(distinct digest) as groups, cast(sum(size) as bigint) as words from docs group by key, source),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight, words * 2.0::double as cap, sum(words) over () * 1.5::double as total from sources),
ratios as (select *, cap / weight as ratio from weighed),
levels as (select *, (total - coalesce(sum(cap) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, key rows between current row and unbounded following) as level from ratios),
flats as (select *, max(case when level <= ratio then level end) over () as flat from levels),
plan as (select key, ceil(groups / 1000.0) as blocks, words as source_size, least(flat * weight, cap) as target,
  case when words > 0 then least(least(flat * weight, cap) / words, 2.0) else 0 end as rate,
  cast('0x' || substr(md5('{SEED}' || key), 1, 8) as bigint) / 4294967296.0::double as shift from flats),
dealt as (select d.*, p.source_size, p.target, p.rate, p.shift, cast(floor(cast('0x' || substr(digest, 1, 8) as bigint) * p.blocks / 4294967296.0::double) as bigint) as block from docs d join plan p using (key)),
placed as (select *, row_number() over (partition by key order by block, size, digest) as place from dealt)
select doc_id, size, source_size, target, cast((floor(shift + place * rate) - floor(shift + (place - 1) * rate)) * size as bigint) as taken from placed
"""
