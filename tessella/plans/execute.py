"""Lower a compiled plan to one lazy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tessella.operators import aggregates, frames, joins, rows
from tessella.operators.relation import Relation

from .compiler import CompiledPlan, Node, compile_plan
from .shapes import TOGETHER


def lower(node: Node, inputs: list[Relation]) -> Relation:
    p, r = node.params, inputs[0]
    if node.operator == "Filter_Aggregate":
        kept = rows.keep(r, p["filters"])
        return aggregates.aggregate(kept, p["groups"], p["measures"], p["sets"], p["marker"]) if "measures" in p else kept
    if node.operator == "Math_Compute":
        return rows.compute(r, p["expression"], p["output"], p["partition"])
    if node.operator == "Date_Extract":
        return rows.date_extract(r, p["source"], p["part"], p["output"], p["fiscal_start"])
    if node.operator == "Bucket":
        return rows.bucket(r, p["source"], p["output"], p["rules"], p["default"])
    if node.operator == "Order_By":
        return rows.order_by(r, p["keys"], p["limit"], p["offset"])
    if node.operator == "Range_Window":
        return frames.range_frame(r, **p)
    if node.operator == "Distinct":
        return rows.distinct(r, p["keys"])
    if node.operator == "Integrate":
        for other in inputs[1:]:
            r = joins.integrate(r, other, p["how"], p["left_on"], p["right_on"], p["nulls_equal"], p["suffixes"], p["validate"], p["max_rows"])
        return r
    if node.operator == "Set_Intersect":
        return joins.intersect(inputs, **p)
    if node.operator == TOGETHER and p["keys"]:
        on = p["keys"]
        return reduce(lambda a, b: joins.integrate(a, b, "outer", on, on, nulls_equal=True, validate="1:1"), inputs)
    if node.operator in ("Set_Difference", "Difference"):
        return joins.difference(inputs, **p)
    if node.operator in ("Set_Union", "Union"):
        return joins.union(inputs, **p)
    return joins.combine_scalars(inputs)


def relation(plan: CompiledPlan, datasets: dict[str, DataFrame]) -> Relation:
    made = {name: Relation(df) for name, df in datasets.items()}
    for node in plan.check().nodes:
        made[node.id] = lower(node, [made[i] for i in node.inputs])
    out = made[plan.output]
    if out.order:
        out = Relation(out.df.orderBy(*[k.column() for k in out.order]), out.order)
    if plan.rounding is not None:
        out = rows.rounded(out, plan.rounding)
    return rows.project(out, plan.projection) if plan.projection else out


def run(plan: dict, datasets: dict[str, DataFrame]) -> DataFrame:
    """Compile, check and lower; the result is lazy."""
    return relation(compile_plan(plan, {n: df.columns for n, df in datasets.items()}), datasets).df
