"""Exact percentiles of groups of any size, by distributed selection.

A group of up to LIMIT values is left to Spark's percentile, whose state is a group's values. In a larger one the two values
around the wanted rank are looked for: a quantile sketch gives two values that most likely enclose it, one pass counts exactly how
many are below and between, the rank moves into the part that holds it, and what lies in that part goes on. A round keeps about
a twentieth of a group, so a few rounds leave LIMIT values or a single one. A sketch that is off costs a round, never the result.
All passes combine before the shuffle, however much of the rows one group has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import checkpointed

#: Values of a group that one task sorts.
LIMIT = 50_000
#: Half of the share of a group's ranks that a bracket is meant to hold: well over the sketch's error.
MARGIN, SKETCH = 0.025, 800
#: Ranks that are read off a sketch.
GRID = 200
#: Large groups that are broadcast, a row each; more are joined by shuffle.
BROADCAST_GROUPS = 100_000


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))


def _with(rows: DataFrame, targets: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with what `targets` says of their keys."""
    named = targets.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in targets.columns if c not in keys])
    few = targets.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(named) if few else named, _same(keys), how).drop(*[f"__{k}" for k in keys])


def percentile(df: DataFrame, groups: list[str], value: str, q: float, output: str, distinct: bool = False) -> DataFrame:
    """A row for each group: the linear percentile of its values, or of its distinct values. Nulls don't count and a group of
    nulls only has null; NaN is greater than all numbers."""
    keys = [f"k{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys, strict=True)], F.col(f"`{value}`").cast("double").alias("v"))
    if distinct:
        rows = rows.distinct()
    rows = checkpointed(rows)
    large = checkpointed(rows.groupBy(*keys).agg(F.count("v").alias("n")).where(F.col("n") > LIMIT))
    small = _with(rows, large, keys, "left_anti").groupBy(*keys).agg(F.percentile("v", F.lit(q)).alias("found"))
    named = [F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)]
    if not large.limit(1).count():
        return small.select(*named, F.col("found").alias(output))
    if not groups:  # the one group is large
        small = small.limit(0)
    at = (F.col("n") - 1) * F.lit(q)
    targets = large.withColumn("rank", F.explode(F.array(F.floor(at), F.ceil(at)))).distinct()
    wanted = _selected(_with(rows.where("v is not null"), targets, keys), [*keys, "target"], keys)
    both = large.select(*keys, at.alias("at"))
    ends = _with(wanted.select(*keys, "target", "found"), both, keys).groupBy(*keys).agg(F.any_value("at").alias("at"), F.min_by("found", "target").alias("low"), F.max_by("found", "target").alias("high"))
    share = F.col("at") - F.floor("at")
    exact = F.when((share == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + share * F.col("high"))
    return small.unionByName(ends.select(*keys, exact.alias("found"))).select(*named, F.col("found").alias(output))


def _selected(candidates: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """(keys, found): the value of each target rank (column `rank`, from 0) among its candidates `v`."""
    candidates = checkpointed(candidates.select(*groups, F.col("rank").alias("target"), "v", "rank"))
    done = None
    while True:
        shape = candidates.groupBy(*keys, "rank").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_double(F.when(~F.isnan("v"), F.col("v")), SKETCH).alias("s"))
        state = checkpointed(shape.withColumn("s", F.when(F.kll_sketch_get_n_double("s") > 0, F.col("s"))))
        single = state.where("least = most").select(*keys, F.col("least").alias("found"))
        few = state.where(f"not (least = most) and n <= {LIMIT}").select(*keys)
        sorted_values = _with(candidates, few, keys, "left_semi").groupBy(*keys, "rank").agg(F.sort_array(F.collect_list("v")).alias("all"))
        found = checkpointed(single.unionByName(sorted_values.select(*keys, F.get("all", F.col("rank")).alias("found"))))
        done = found if done is None else done.unionByName(found)
        open_ = state.where(f"not (least = most) and n > {LIMIT}")
        if not open_.limit(1).count():
            return done
        place = (F.col("rank") + 0.5) / F.col("n")
        grid = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))  # it takes constant ranks only
        outside = lambda k: (k < 0) | (k > GRID) | F.col("s").isNull()
        end = lambda k, beyond: F.when(outside(k), F.col(beyond)).otherwise(F.get(grid, F.least(F.greatest(k, F.lit(0)), F.lit(GRID)).cast("int")))
        pivot = end(F.round(place * GRID), "least")
        brackets = open_.select(*keys, "least", "most", pivot.alias("pivot"), end(F.floor((place - MARGIN) * GRID), "least").alias("low"), end(F.ceil((place + MARGIN) * GRID), "most").alias("high"))
        # a bracket of all candidates would be no progress: then one of them parts the less from the greater
        whole = (F.col("low") == F.col("least")) & (F.col("high") == F.col("most"))
        brackets = brackets.select(*keys, *[F.when(whole, F.col("pivot")).otherwise(F.col(c)).alias(c) for c in ("low", "high")])
        marked = _with(candidates, checkpointed(brackets), keys)
        v = F.col("v")
        counts = marked.groupBy(*keys, "rank", "low", "high").agg(F.count_if(v < F.col("low")).alias("below"), F.count_if(v < F.col("high")).alias("under"), F.count_if(v <= F.col("high")).alias("upto"))
        rank = F.col("rank")
        part = F.when(rank < F.col("below"), 0).when(rank < F.col("upto"), 1).otherwise(2)
        moved = checkpointed(counts.select(*keys, "low", "high", part.alias("part"), F.when(part == 0, rank).when(part == 1, rank - F.col("below")).otherwise(rank - F.col("upto")).alias("moved")))
        kept = _with(candidates, moved, keys)
        inside = F.when(F.col("part") == 0, v < F.col("low")).when(F.col("part") == 1, (v >= F.col("low")) & (v <= F.col("high"))).otherwise(v > F.col("high"))
        candidates = checkpointed(kept.where(inside).select(*keys, "v", F.col("moved").alias("rank")))
