"""The raw retrieval contract: one table, its fields and row conditions, and nothing that calculates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import conditions
from tessella.functions.values import TEXT, PlanError, kind_of, quoted
from tessella.operators.relation import Relation
from tessella.operators.rows import keep

#: Requests that belong to later steps.
CALCULATIONS = ("joins", "join", "group_by", "aggregations", "order_by", "limit", "distinct", "having", "calculations", "expressions")


def null_tests(condition: Any) -> Any:
    """At the scan, = null and != null are presence tests."""
    if isinstance(condition, dict):
        for key in ("all", "any"):
            if isinstance(condition.get(key), list):
                return {key: [null_tests(c) for c in condition[key]]}
        if "not" in condition:
            return {"not": null_tests(condition["not"])}
        if "value" in condition and condition["value"] is None and condition.get("operator") in ("=", "!="):
            return {"field": conditions.field_of(condition), "operator": "is_null" if condition["operator"] == "=" else "is_not_null"}
    return condition


def retrieve(contract: dict[str, Any], source: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Fields and rows of one source; Catalyst pushes both into the scan. ignore_case compares text without regard to case."""
    asked = [k for k in CALCULATIONS if contract.get(k)]
    errors = [f"a raw retrieval doesn't calculate: {k}" for k in asked]
    fields = contract.get("fields")
    if not isinstance(fields, list) or not fields or len(set(fields)) != len(fields):
        raise PlanError([*errors, "a raw retrieval lists its fields, each once"])
    errors += [f"unknown field: {f}" for f in fields if f not in source.columns]
    given = contract.get("filters") or []
    tree = [null_tests(conditions.normalise(c)) for c in (given if isinstance(given, list) else [given])]
    for c in tree:
        errors += conditions.breaches(c, source.columns, "retrieval", scan=True)
    errors += [f"contradiction: {e}" for e in conditions.contradictions({"all": tree})]
    if errors:
        raise PlanError(errors)
    if ignore_case:
        for leaf in (x for c in tree for x in conditions.leaves(c)):
            leaf["case_sensitive"] = False
    return keep(Relation(source), tree, scan=True).df.select(*[quoted(f) for f in fields])


def with_case_folded_keys(df: DataFrame) -> DataFrame:
    """Text fields under a collation that ignores case, as some backends compare scans."""
    return df.withColumns({f.name: F.collate(quoted(f.name), "UTF8_LCASE") for f in df.schema if kind_of(f.dataType) == TEXT})
