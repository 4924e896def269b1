"""Joins by order: as-of (latest, earliest or nearest) and joins on inequalities.

Both work on rows that are range-partitioned by what they are ordered by, so a key, a value or a range may span any number of
tasks; what a part needs from the parts before it is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.values import PlanError, quoted

from .joins import joined_names
from .relation import Relation
from .windows import checkpointed, numbered

DIRECTIONS = ("backward", "forward", "nearest")
#: Left rows of a block, the unit that a range is matched with.
BLOCK = 2048
OPERATORS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


# -- as-of ------------------------------------------------------------------------------------------------------------


def _all(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def _distance(a: Column, b: Column, kind: T.DataType) -> Column:
    """How far apart two times are: days of dates, seconds of timestamps, else the numbers' difference."""
    if isinstance(kind, T.DateType):
        return F.abs(F.datediff(a, b)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        return F.abs(micros(a) - micros(b)) / 1e6
    return F.abs(a.cast("double") - b.cast("double"))


def _carried(rows: DataFrame, keys: list[str], forward: bool, name: str) -> DataFrame:
    """rows(keys, t, side, hit, part, ...) with the last `hit` at or before each row in its key, or the first at or after.

    Within a part a window by (part, key) finds it. A key's first rows in a part take what the parts before end with: a row for
    each part and key that spans parts, of which a key has no more than there are parts.
    """
    own = ["part", *keys]
    sort = [F.desc("t"), F.desc("side")] if forward else [F.asc("t"), F.asc("side")]
    here = F.last("hit", ignorenulls=True).over(Window.partitionBy(*own).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    edge = (F.min_by if forward else F.max_by)("hit", F.when(F.col("hit").isNotNull(), F.col("t")))
    ends = rows.groupBy(*own).agg(edge.alias("edge"))
    w = Window.partitionBy(*keys).orderBy(F.desc("part") if forward else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*own, F.last("edge", ignorenulls=True).over(w).alias("carry")).where("carry is not null")
    carry = carry.select(F.col("part").alias("__part"), *[F.col(k).alias(f"__{k}") for k in keys], "carry")
    same = _all([F.col("part") == F.col("__part"), *[F.col(k) == F.col(f"__{k}") for k in keys]])
    both = rows.withColumn("__here", here).join(F.broadcast(carry), same, "left")  # at most a row a part: the one key that begins before it
    return both.withColumn(name, F.coalesce("__here", "carry")).drop("__here", "carry", "__part", *[f"__{k}" for k in keys])


def as_of(left: Relation, right: Relation, left_on: list[str], right_on: list[str], left_time: str, right_time: str, suffixes=("", "_right"), direction: str = "backward", tolerance: float | None = None) -> Relation:
    """Each left row with the right row of its key that is latest at or before its time (backward), earliest at or after it
    (forward) or nearest (of two as near the earlier one); null fields where there is none within the tolerance.

    Of right rows of one key and time one counts: the greatest by the other fields, looking forward the least. Null keys and
    null times match nothing and are set aside. The tolerance is in days of dates, seconds of timestamps, else a number.
    Both sides are stacked and range-partitioned by key and time, so no pairs are made and no task holds a key's rows.
    """
    if direction not in DIRECTIONS:
        raise PlanError(f"unsupported direction: {direction}")
    names_l, names_r, fields = joined_names(left.fields, right.fields, left_on, right_on, suffixes)
    rest = [f for f in right.fields if f not in {a for a, b in zip(left_on, right_on, strict=True) if a == b}]
    keys = [f"k{i}" for i in range(len(left_on))]
    l_row = F.struct(*[quoted(f).alias(f"l{i}") for i, f in enumerate(left.fields)])
    r_row = F.struct(*[quoted(f).alias(f"r{i}") for i, f in enumerate(rest)]) if rest else F.struct(F.lit(0).alias("r"))
    key_columns = lambda on: [quoted(k).alias(a) for k, a in zip(on, keys, strict=True)]
    known = _all([F.col(k).isNotNull() for k in (*keys, "t")])
    a = left.df.select(*key_columns(left_on), quoted(left_time).alias("t"), l_row.alias("l"))
    b = right.df.select(*key_columns(right_on), quoted(right_time).alias("t"), r_row.alias("r")).where(known)
    ways = ["backward", "forward"] if direction == "nearest" else [direction]
    # at one time right rows stand before the left rows that look back and after those that look forward
    stacked = a.where(known).select(*keys, "t", F.lit(1).alias("side"), "l")
    for w in ways:
        best = b.groupBy(*keys, "t").agg((F.max if w == "backward" else F.min)("r").alias("r"))
        hits = best.select(*keys, "t", F.lit(0 if w == "backward" else 2).alias("side"), F.struct("t", "r").alias(w))
        stacked = stacked.unionByName(hits, allowMissingColumns=True)
    ranged = stacked.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "t", "side", "salt")
    rows = checkpointed(ranged.drop("salt").withColumn("part", F.spark_partition_id()))
    for w in ways:
        rows = _carried(rows.withColumn("hit", F.col(w)), keys, w == "forward", f"found_{w}").drop("hit")
    kind = left.df.schema[left_time].dataType
    far = {w: _distance(F.col("t"), F.col(f"found_{w}.t"), kind) for w in ways}
    within = {w: F.when(far[w] <= tolerance if tolerance is not None else F.lit(True), F.col(f"found_{w}")) for w in ways}
    if direction == "nearest":
        chosen = F.when(F.col("found_backward").isNull() | (far["forward"] < far["backward"]), within["forward"]).otherwise(within["backward"])
    else:
        chosen = within[direction]
    found = rows.where("side = 1").select("l", chosen.alias("hit"))
    found = found.unionByName(a.where(~F.coalesce(known, F.lit(False))).select("l", F.lit(None).cast(found.schema["hit"].dataType).alias("hit")))
    out = [F.col(f"l.l{i}").alias(names_l[f]) for i, f in enumerate(left.fields)]
    out += [F.col(f"hit.r.r{i}").alias(names_r[f]) for i, f in enumerate(rest)]
    return Relation(found.select(*out).select(*[quoted(f) for f in fields]))


# -- inequalities -----------------------------------------------------------------------------------------------------


def _found(rows: DataFrame, keys: list[str], value: str, blocks: DataFrame, edge: str, forward: bool, name: str) -> DataFrame:
    """rows with the number of the first block of its keys whose greatest value isn't less than `value` (forward), or of the
    last one whose least value isn't greater; null where there is none."""
    other = blocks.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col(edge).alias("edge_b"), F.col("block").alias("block_b"))
    hit = as_of(Relation(rows), Relation(other), keys, [f"{k}_b" for k in keys], value, "edge_b", direction="forward" if forward else "backward").df
    return hit.withColumn(name, F.col("block_b")).drop("edge_b", "block_b", *[f"{k}_b" for k in keys])


def _ranges(rows: DataFrame, keys: list[str], blocks: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """rows with `block`, one row for each block of its keys that may hold values from `low` to `high`.

    A block that the range covers gives BLOCK pairs, so there are no more rows here than pairs, but for two blocks a row.
    """
    ends = blocks.groupBy(*keys).agg(F.min("block").alias("lowest"), F.max("block").alias("highest")) if keys else blocks.agg(F.min("block").alias("lowest"), F.max("block").alias("highest"))
    if keys:
        named = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], "lowest", "highest")
        rows = rows.join(named, _all([F.col(k) == F.col(f"__{k}") for k in keys])).drop(*[f"__{k}" for k in keys])
    else:
        rows = rows.join(F.broadcast(ends))  # one row
    first, last = F.col("lowest"), F.col("highest")
    if low:
        rows, first = _found(rows, keys, low, blocks, "most", True, "first"), F.col("first")
    if high:
        rows, last = _found(rows, keys, high, blocks, "least", False, "last"), F.col("last")
    spread = rows.where(first <= last).withColumn("block", F.explode(F.sequence(first, last)))
    return spread.drop("lowest", "highest", "first", "last")


def _in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in this order with the number of their block; equal rows fill several ranges and blocks where they are many."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    return numbered(salted, [F.col(c) for c in (*order, "salt")], "row").withColumn("block", F.floor(F.col("row") / BLOCK)).drop("row", "salt")


def _blocks(placed: DataFrame, keys: list[str], value: str) -> DataFrame:
    return placed.groupBy(*keys, "block").agg(F.min(value).alias("least"), F.max(value).alias("most"))


def theta(left: Relation, right: Relation, conditions: list[tuple[str, str, str]], suffixes=("", "_right")) -> Relation:
    """Pairs of rows for which one or two inequalities (left field, < <= > or >=, right field) hold; nulls match nothing.

    The left rows are sorted by range and numbered, BLOCK of them are a block, and a right row is entered in the blocks that
    its bounds reach: two bounds on one field make a range, one makes a half-line. For two fields the blocks of the first one
    are the leaves of a binary tree; a left row is entered in the nodes above its block (as many as the tree has levels), each
    node has its rows in blocks by the second field, and a right row looks into the few nodes that make up its half-line.
    An equi-join by block then tests the conditions themselves. All work but the tree's levels is in proportion to the rows
    and the pairs that come out, however wide the ranges, and a value that many rows have fills as many blocks as it needs.
    """
    if not 1 <= len(conditions) <= 2 or any(o not in OPERATORS for _, o, _ in conditions):
        raise PlanError("an inequality join takes one or two conditions with < <= > or >=")
    names_l, names_r, fields = joined_names(left.fields, right.fields, [], [], suffixes)
    on = [(f"l{left.fields.index(a)}", o, f"r{right.fields.index(b)}") for a, o, b in conditions]
    usable = lambda names: _all([F.col(n).isNotNull() & ~(F.isnan(n) if t in ("double", "float") else F.lit(False)) for n, t in names])
    l, r = (rel.df.select(*[quoted(f).alias(f"{s}{i}") for i, f in enumerate(rel.fields)]) for rel, s in ((left, "l"), (right, "r")))
    kinds = dict(l.dtypes) | dict(r.dtypes)
    l = l.where(usable([(a, kinds[a]) for a, _, _ in on]))
    r = r.where(usable([(b, kinds[b]) for _, _, b in on]))
    upper = [o in ("<", "<=") for _, o, _ in on]
    x = on[0][0]
    placed = _in_blocks(l, [x])
    one_field = len(on) == 1 or on[0][0] == on[1][0]
    if one_field and not (len(on) == 2 and upper[0] == upper[1]):
        bounds = {u: b for u, (_, _, b) in zip(upper, on, strict=True)}
        keys = ["block"]
        met = _ranges(r, [], checkpointed(_blocks(placed, [], x)), bounds.get(False), bounds.get(True))
    else:
        keys = ["level", "node", "block"]
        placed, met = _tree(placed, r, on, upper)
    named = met.select(*[F.col(k).alias(f"__{k}") for k in keys], *r.columns)
    test = _all([OPERATORS[o](F.col(a), F.col(b)) for a, o, b in on])
    pairs = placed.join(named, _all([F.col(k) == F.col(f"__{k}") for k in keys]) & test)
    out = [F.col(f"l{i}").alias(names_l[f]) for i, f in enumerate(left.fields)] + [F.col(f"r{i}").alias(names_r[f]) for i, f in enumerate(right.fields)]
    return Relation(pairs.select(*out).select(*[quoted(f) for f in fields]))


def _tree(placed: DataFrame, r: DataFrame, on: list[tuple[str, str, str]], upper: list[bool]) -> tuple[DataFrame, DataFrame]:
    """Left rows in the nodes above their block, in blocks by the second field; right rows in the blocks of their nodes."""
    (x, _, bx), (y, _, by) = on
    leaves = checkpointed(_blocks(placed, [], x))
    count = (leaves.agg(F.max("block")).first()[0] or 0) + 1
    levels = (count - 1).bit_length() + 1
    nodes = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("node", F.expr("shiftright(block, level)")).drop("block")
    inner = checkpointed(_in_blocks(nodes, ["level", "node", y]))
    # the leaf where a right row's half-line ends: all up to it, or all from it on
    at = _found(r, [], bx, leaves, "least" if upper[0] else "most", not upper[0], "leaf").where("leaf is not null")
    size = 1 << (levels - 1)
    reach = F.col("leaf") + 1 if upper[0] else F.lit(size) - F.col("leaf")
    parts = at.withColumn("reach", reach).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).where(F.expr("shiftright(reach, level) % 2 = 1"))
    node = F.expr("shiftright(reach, level) - 1") if upper[0] else F.lit(size).cast("long")
    if not upper[0]:
        node = F.expr(f"shiftright({size}L, level) - shiftright(reach, level)")
    looking = parts.withColumn("node", node).drop("leaf", "reach")
    low, high = (None, by) if upper[1] else (by, None)
    return inner, _ranges(looking, ["level", "node"], checkpointed(_blocks(inner, ["level", "node"], y)), low, high)
