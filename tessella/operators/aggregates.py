"""Grouped and scalar aggregates: all measures of one grain over one input in a single groupBy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessella.functions import sketches
from tessella.functions.conditions import predicate
from tessella.functions.values import NUMBER, PlanError, Value, number, quoted

from . import selection
from .relation import Relation

_NAMES = {"nunique": "count_distinct", "average": "avg", "mean": "avg", "percentile": "percentile_cont", "quantile": "percentile_cont", "count(*)": "count_rows"}
OPERATIONS = {"count", "count_rows", "count_distinct", "sum", "avg", "min", "max", "median", "percentile_cont", *sketches.OPERATIONS}


def operation(name: Any, quantile: Any = None) -> tuple[str, float | None]:
    """The canonical aggregate and its quantile; percentile_NN carries its percent in the name."""
    name = str(name or "").lower()
    if m := re.fullmatch(r"(?:percentile|p)_?(\d{1,3}(?:\.\d+)?)", name):
        name, quantile = "percentile_cont", float(m[1]) / 100
    name = _NAMES.get(name, name)
    if name not in OPERATIONS:
        raise PlanError(f"unsupported aggregate: {name}")
    if name != "percentile_cont":
        return name, None
    if isinstance(quantile, bool) or not isinstance(quantile, (int, float)) or not 0 <= quantile <= 1:
        raise PlanError("a percentile takes a quantile between 0 and 1")
    return name, float(quantile)


def is_aggregate(name: Any) -> bool:
    try:
        operation(name, 0.5)
    except PlanError:
        return False
    return True


@dataclass(frozen=True)
class Measure:
    operation: str
    output: str
    target: str | None = None
    distinct: bool = False
    quantile: float | None = None
    filters: tuple = field(default=())
    #: "selection": a percentile that no task holds a group's values for; "in_order": a sum of doubles in the relation's order.
    method: str | None = None


def _column(m: Measure, r: Relation, keep: Column | None) -> Column:
    only = (lambda c: F.when(keep, c)) if keep is not None else (lambda c: c)
    if m.operation == "count_rows" or (m.operation == "count" and m.target in (None, "*")):
        if m.distinct:
            raise PlanError("a row count takes no distinct flag")
        return F.count(only(F.lit(1)))
    if not m.target or m.target == "*":
        raise PlanError(f"{m.operation} requires a target column")
    source = Value(quoted(m.target), r.kinds[m.target])
    if m.operation in ("count", "count_distinct"):
        return (F.count_distinct if m.distinct or m.operation == "count_distinct" else F.count)(only(source.column))
    if m.operation in sketches.OPERATIONS:
        return sketches.aggregate(m.operation, source, only)
    if m.operation in ("min", "max"):
        return getattr(F, m.operation)(only(source.column))
    x = number(source, m.operation)
    value = only(x.column)
    if m.operation == "sum":
        return F.sum_distinct(value) if m.distinct else F.sum(value)
    if m.operation == "avg":
        total, n = (F.sum_distinct(value), F.count_distinct(value)) if m.distinct else (None, None)
        return total.cast("double") / F.nullif(n, F.lit(0)) if m.distinct else F.avg(value.cast("double") if x.kind == NUMBER else value)
    if m.distinct:
        values = F.array_sort(F.collect_set(value.cast("double")))  # the distinct values of one group
        return _linear(values, m.quantile if m.operation == "percentile_cont" else 0.5)
    return F.median(value) if m.operation == "median" else F.percentile(value.cast("double"), F.lit(m.quantile))


def _linear(values: Column, q: float) -> Column:
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def grouping_sets(grouping: Any, groups: list[str]) -> list[list[str]] | None:
    """The sets of a rollup, a cube or a list of lists; None for plain grouping."""
    if grouping in (None, "plain"):
        return None
    if grouping == "rollup":
        return [groups[:k] for k in range(len(groups), -1, -1)]
    if grouping == "cube":
        return [[g for i, g in enumerate(groups) if not mask >> i & 1] for mask in range(1 << len(groups))]
    if not isinstance(grouping, list) or not all(isinstance(s, list) and set(s) <= set(groups) for s in grouping) or not grouping:
        raise PlanError("grouping is rollup, cube or a list of lists of group_by fields")
    return grouping


def aggregate(r: Relation, groups: list[str], measures: list[Measure], sets: list[list[str]] | None = None, marker: str | None = None) -> Relation:
    """With grouping sets a field that a set leaves out is null there; `marker` names a column of the sets' bits, the last
    field's lowest, 1 where left out. Null keys are a group. A measure with filters of its own sees only the rows that pass; a group without such rows has
    null there, and one that no measure sees is absent. Without groups there is one row, with counts of zero."""
    apart = [m for m in measures if m.method == "selection"]
    if apart:
        return _joined(r, groups, measures, apart, sets)
    r, last = _running(r, groups, measures, sets)
    columns, seen = [], []
    for i, m in enumerate(measures):
        keep = predicate({"all": list(m.filters)}, r.kinds) if m.filters else None
        c = F.max_by(last[i], "__place") if i in last else _column(m, r, keep)
        if keep is not None and groups:
            name = f"__seen{i}"
            columns.append(F.count(F.when(keep, 1)).alias(name))
            seen.append(name)
        columns.append(c.alias(m.output))
    keys = [quoted(g) for g in groups]
    if sets is None:
        df = r.df.groupBy(*keys).agg(*columns)
    else:
        df = r.df.groupingSets([[quoted(g) for g in s] for s in sets], *keys).agg(*([F.grouping_id().cast("long").alias(marker)] if marker else []), *columns)
    if seen and len(seen) == len(measures):
        df = df.where(" or ".join(f"`{s}` > 0" for s in seen))
    out = []
    for i, m in enumerate(measures):
        c = quoted(m.output)
        out.append(F.when(F.col(f"__seen{i}") > 0, c).alias(m.output) if f"__seen{i}" in seen else c)
    return Relation(df.select(*keys, *([quoted(marker)] if marker else []), *out))


def _running(r: Relation, groups: list[str], measures: list[Measure], sets: list[list[str]] | None) -> tuple[Relation, dict[int, str]]:
    """r with a running sum, by group and in r's order, for each measure that asks for it; its last value is the group's sum.

    Doubles added in another order have another sum, so a plain sum differs in its last digits from run to run. The window is the
    groups' own exchange, and it takes a row at a time.
    """
    found = {i: f"__running{i}" for i, m in enumerate(measures) if m.method == "in_order"}
    if not found:
        return r, found
    if sets is not None or not groups or not r.order or any(measures[i].distinct for i in found):
        raise PlanError("a sum in order takes groups, sorted rows and no grouping sets or distinct values")
    w = Window.partitionBy(*[quoted(g) for g in groups]).orderBy(*r.total_order())
    columns = {"__place": F.row_number().over(w)}
    for i, name in found.items():
        m = measures[i]
        x = number(Value(quoted(m.target), r.kinds[m.target]), m.operation).column
        x = F.when(predicate({"all": list(m.filters)}, r.kinds), x) if m.filters else x
        columns[name] = F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return Relation(r.df.withColumns(columns), r.order), found


def _joined(r: Relation, groups: list[str], measures: list[Measure], apart: list[Measure], sets: list[list[str]] | None) -> Relation:
    """The measures of one groupBy, and those by selection joined to them group by group."""
    if sets is not None:
        raise PlanError("selection takes plain groups")
    rest = [m for m in measures if m not in apart]
    filtered = all(m.filters for m in measures)
    if filtered and any(m.method == "in_order" for m in rest):
        raise PlanError("a sum in order next to selection takes a measure without filters")
    base = aggregate(r, groups, rest).df if rest and not filtered else r.df.groupBy(*[quoted(g) for g in groups]).agg(*[_column(m, r, predicate({"all": list(m.filters)}, r.kinds)).alias(m.output) for m in rest] or [F.count(F.lit(1)).alias("__rows")])
    for m in apart:
        if not m.target or m.target == "*":
            raise PlanError(f"{m.operation} requires a target column")
        value = number(Value(quoted(m.target), r.kinds[m.target]), m.operation).column
        rows = r.df.where(predicate({"all": list(m.filters)}, r.kinds)) if m.filters else r.df
        rows = rows.select(*[quoted(g) for g in groups], value.alias("__value"))
        found = selection.percentile(rows, groups, "__value", m.quantile if m.operation == "percentile_cont" else 0.5, "__found", m.distinct)
        found = found.select(*[quoted(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__found").alias(m.output))
        same = reduce(Column.__and__, [quoted(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.lit(True))
        base = base.join(found, same, "left").drop(*[f"__g{i}" for i in range(len(groups))])
    return Relation(base.select(*[quoted(f) for f in (*groups, *[m.output for m in measures])]))
