"""Mergeable sketches as stored columns: distinct counts (HyperLogLog), quantiles (KLL) and frequent items.

A sketch is built by one aggregate, kept as a column (by day, say), and merged by another (by month); an expression reads the
estimate off. All three are Spark's own aggregates: they combine before the shuffle, and a group's state has a fixed size.

Nulls aren't counted. A group without values has an empty sketch: 0 distinct values, null quantiles, no frequent items.
Errors: a distinct count has a relative standard error of 1.04 / sqrt(2**DISTINCT_LOG), 0.8 %; a quantile's rank is off by at
most 0.6 % of the rows in 99 of 100 sketches; an item's frequency is never below the true one and above it by at most
3.5 / TRACKED of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import INTEGER, NUMBER, TEXT, PlanError, Value, number

DISTINCT_LOG, QUANTILES, TRACKED = 14, 800, 10_000
#: What the plan language calls them: operation -> the estimates' function names.
BUILDS = {"sketch_distinct": "merge_distinct", "sketch_quantiles": "merge_quantiles", "sketch_frequent": "merge_frequent"}
OPERATIONS = {"approx_count_distinct", *BUILDS, *BUILDS.values()}
RELATIVE_ERROR = 0.01


def _hashable(v: Value) -> Column:
    """Whole numbers as such, all else as its text."""
    return v.column.cast("long") if v.kind == INTEGER else v.column.cast("string")


def aggregate(operation: str, source: Value, only: Callable[[Column], Column]) -> Column:
    if operation == "approx_count_distinct":
        return F.approx_count_distinct(only(_hashable(source)), RELATIVE_ERROR)
    if operation == "sketch_distinct":
        return F.hll_sketch_agg(only(_hashable(source)), DISTINCT_LOG)
    if operation == "merge_distinct":
        return F.hll_union_agg(only(source.column))
    if operation == "sketch_quantiles":
        return F.kll_sketch_agg_double(only(number(source, operation).column.cast("double")), QUANTILES)
    if operation == "merge_quantiles":
        return F.kll_merge_agg_double(only(source.column))
    if operation == "sketch_frequent":
        return F.call_function("approx_top_k_accumulate", only(_hashable(source)), F.lit(TRACKED))
    return F.call_function("approx_top_k_combine", only(source.column), F.lit(TRACKED))


def _fraction(v: Value, name: str) -> float:
    if not v.is_literal or isinstance(v.literal, bool) or not isinstance(v.literal, (int, float)) or not 0 <= v.literal <= 1:
        raise PlanError(f"{name} takes a literal from 0 to 1")
    return float(v.literal)


def _filled(sketch: Column, found: Column) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, found)


def distinct(args: list[Value]) -> Value:
    return Value(F.hll_sketch_estimate(args[0].column), INTEGER)


def quantile(args: list[Value]) -> Value:
    q = _fraction(args[1], "quantile_estimate")
    return Value(_filled(args[0].column, F.kll_sketch_get_quantile_double(args[0].column, F.lit(q))), NUMBER)


def rank(args: list[Value]) -> Value:
    """The share of values at or below a number."""
    return Value(_filled(args[0].column, F.kll_sketch_get_rank_double(args[0].column, number(args[1]).column.cast("double"))), NUMBER)


def frequent(args: list[Value]) -> Value:
    """The k most frequent items and their counts, as JSON, the most frequent first, of equals the least item."""
    k = args[1].literal
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= TRACKED:
        raise PlanError(f"frequent_items takes a literal number from 1 to {TRACKED}")
    # equally frequent items come in any order: all that are tracked are read, then sorted and cut
    found = F.filter(F.call_function("approx_top_k_estimate", args[0].column, F.lit(TRACKED)), lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("item"), x["count"].alias("count"))))
    return Value(F.to_json(F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count")))), TEXT)


FUNCTIONS = {"distinct_estimate": (1, 1, distinct), "quantile_estimate": (2, 2, quantile), "rank_estimate": (2, 2, rank), "frequent_items": (2, 2, frequent)}
