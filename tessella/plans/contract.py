"""What a caller asks for against what a compiled plan gives: fields, measures, grouping, order, limit."""

from __future__ import annotations

from typing import Any

from .compiler import CompiledPlan, sort_keys


def breaches(plan: CompiledPlan, asked: dict[str, Any]) -> list[str]:
    """asked: projection, group_by, metrics [{output_column, operation}], order_by, limit; each optional."""
    found = []
    if asked.get("projection") and list(asked["projection"]) != plan.fields:
        found.append(f"the output is {plan.fields}, not {list(asked['projection'])}")
    nodes = {n.id: n for n in plan.nodes}
    end = nodes.get(plan.output)
    lineage = end.lineage if end else {}
    for m in asked.get("metrics") or []:
        have = lineage.get(m["output_column"])
        if have is None:
            found.append(f"no calculation gives {m['output_column']}")
        elif m.get("operation") and have["operation"] not in (m["operation"], "expression"):
            found.append(f"{m['output_column']} is a {have['operation']}, not a {m['operation']}")
        elif "group_by" in asked and set(have.get("group_by", [])) != set(asked["group_by"]):
            found.append(f"{m['output_column']} is grouped by {have.get('group_by', [])}, not {asked['group_by']}")
    sorts = [n for n in plan.nodes if n.operator == "Order_By"]
    if asked.get("order_by"):
        wanted = sort_keys({"order_by": asked["order_by"]})
        if not sorts or sorts[-1].params["keys"][: len(wanted)] != wanted:
            found.append("the output isn't in the order asked for")
    if asked.get("limit") is not None and (not sorts or sorts[-1].params["limit"] != asked["limit"]):
        found.append(f"the output isn't limited to {asked['limit']} rows")
    return found


def explain(plan: CompiledPlan) -> list[dict[str, Any]]:
    """The steps as plain data: operator, inputs, output fields."""
    return [{"id": n.id, "operator": n.operator, "inputs": n.inputs, "fields": n.fields, "stage": n.stage} for n in plan.nodes]
