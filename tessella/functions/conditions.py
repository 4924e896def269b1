"""Predicate trees (JSON) as boolean Columns with SQL's three-valued logic."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BOOLEAN, INTEGER, NULL, NUMBER, TEXT, TIME, PlanError, Value, literal, number, quoted, time

#: Fixed values of the plan language: other spellings of predicate operators.
_SPELLINGS = {"eq": "=", "==": "=", "equals": "=", "ne": "!=", "<>": "!=", "gt": ">", "ge": ">=", "gte": ">=", "lt": "<", "le": "<=", "lte": "<=", "isnull": "is_null", "notnull": "is_not_null", "is_not": "is_not_null", "notin": "not_in", "notlike": "not_like", "notilike": "not_ilike"}
_NULL_TESTS = {"is_null", "is_not_null"}
_ORDERED = {"<", "<=", ">", ">=", "between"}
OPERATORS = {"=", "!=", "<", "<=", ">", ">=", "in", "not_in", "between", "contains", "not_contains", "like", "not_like", "ilike", "not_ilike"} | _NULL_TESTS
SCAN_OPERATORS = OPERATORS - {"like", "not_like", "ilike", "not_ilike"}


def normalise(condition: Any) -> Any:
    """One spelling: and/or/conditions/logic become all/any, operator names their canonical ones, BETWEEN text a pair."""
    if isinstance(condition, list):
        return {"all": [normalise(c) for c in condition]}
    if not isinstance(condition, dict):
        return condition
    c = dict(condition)
    for old, new in (("and", "all"), ("or", "any")):
        if old in c:
            c[new] = c.pop(old)
    for group in ("conditions", "filters"):
        if group in c and "field" not in c and "column" not in c:
            c["any" if str(c.pop("logic", "and")).lower() == "or" else "all"] = c.pop(group)
    for key in ("all", "any"):
        if key in c:
            return {key: [normalise(x) for x in c[key]] if isinstance(c[key], list) else c[key]}
    if "not" in c:
        return {"not": normalise(c["not"])}
    op = re.sub(r"\s+", "_", str(c.get("operator", "=")).strip().lower())
    c["operator"] = op = _SPELLINGS.get(op, op)
    if op == "between" and isinstance(c.get("value"), str) and (m := re.fullmatch(r"\s*'?([\dT:.\- ]+?)'?\s+and\s+'?([\dT:.\- ]+?)'?\s*", c["value"], re.I)):
        c["value"] = [m[1], m[2]]
    return c


def field_of(condition: dict) -> Any:
    return condition.get("field") or condition.get("column") or condition.get("target_column")


def leaves(condition: Any):
    """The comparisons of a normalised tree."""
    if isinstance(condition, dict):
        for key in ("all", "any"):
            if isinstance(condition.get(key), list):
                for c in condition[key]:
                    yield from leaves(c)
                return
        if "not" in condition:
            yield from leaves(condition["not"])
            return
    yield condition


def breaches(condition: Any, fields: list[str], context: str, scan: bool = False) -> list[str]:
    """What is wrong with a normalised tree over these fields."""
    if not isinstance(condition, dict):
        return [f"{context}: every predicate must be an object"]
    for key in ("all", "any"):
        if key in condition:
            if not isinstance(condition[key], list) or not condition[key]:
                return [f"{context}: {key} requires predicates"]
            return [e for c in condition[key] for e in breaches(c, fields, context, scan)]
    if "not" in condition:
        return breaches(condition["not"], fields, context, scan)
    name, op, found = field_of(condition), condition.get("operator", "="), []
    if not isinstance(name, str) or name not in fields:
        found.append(f"{context}: field does not exist on the selected input: {name}")
    if op not in (SCAN_OPERATORS if scan else OPERATORS):
        return [*found, f"{context}: unsupported operator: {op}"]
    if op in _NULL_TESTS:
        return found
    value = condition.get("value")
    if value is None:
        found.append(f"{context}: a comparison with null is unknown; use is_null or is_not_null")
    elif op in ("in", "not_in") and not isinstance(value, list):
        found.append(f"{context}: {op} requires a list")
    elif op == "between" and (not isinstance(value, list) or len(value) != 2 or None in value):
        found.append(f"{context}: between requires two endpoints")
    elif op not in ("in", "not_in", "between") and isinstance(value, (list, dict)):
        found.append(f"{context}: {op} requires one value")
    if isinstance(value, str) and re.match(r"\s*\(?\s*select\b", value, re.I):
        found.append(f"{context}: a subquery is no literal")
    if str(condition.get("data_type", "")).lower() in ("date", "datetime"):
        found += [f"{context}: not a date: {v}" for v in (value if isinstance(value, list) else [value]) if isinstance(v, str) and not re.match(r"\d{4}-\d{2}-\d{2}([ T]|$)", v)]
    return found


def _parts(condition: Any, key: str) -> list:
    """The conjuncts (or disjuncts) of a tree, those of nested ones of the same kind among them."""
    if isinstance(condition, dict) and isinstance(condition.get(key), list):
        return [p for c in condition[key] for p in _parts(c, key)]
    return [condition]


def _plain(value: Any) -> Any:
    """Numbers of one value alike, whichever way they are written; truth values are no numbers."""
    if isinstance(value, bool):
        return ("truth", value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _may_be_equal(a: dict, b: dict) -> bool:
    """Whether one value can equal both literals: text that says a number is that number for some columns."""
    x, y = a.get("value"), b.get("value")
    if any(isinstance(v, bool) for v in (x, y)):
        return str(x).lower() == str(y).lower() or (x, y) in ((True, 1), (1, True), (False, 0), (0, False))
    try:
        return float(x) == float(y)
    except (TypeError, ValueError):
        pass
    if a.get("case_sensitive") is False or b.get("case_sensitive") is False:
        return str(x).lower() == str(y).lower()
    return x == y


def contradictions(condition: Any) -> list[str]:
    """Fields that a conjunction, however nested, both compares and requires to be null, or equates with two values."""
    found: list[str] = []
    if not isinstance(condition, dict):
        return found
    for branch in condition.get("any") or []:
        found += contradictions(branch)
    leaves = [c for c in _parts(condition, "all") if isinstance(c, dict)] if "all" in condition else []
    null: set[str] = set()
    compared: set[str] = set()
    equal: dict[str, list[dict]] = {}
    for c in leaves:
        if "operator" not in c:
            found += contradictions(c)
            continue
        f = field_of(c)
        (null if c["operator"] == "is_null" else compared).add(f)
        if c["operator"] == "=":
            if any(not _may_be_equal(c, other) for other in equal.get(f, [])):
                found.append(f"{f} equals two values")
            equal.setdefault(f, []).append(c)
    return found + [f"{f} is null and compared" for f in sorted(null & compared)]


def canonical(condition: Any) -> Any:
    """The tree without regard to the order and nesting of its conjuncts and disjuncts or the spelling of numbers, for comparison."""
    if not isinstance(condition, dict):
        return condition
    for key in ("all", "any"):
        if key in condition:
            parts = {repr(c): c for c in (canonical(p) for p in _parts(condition, key))}
            return next(iter(parts.values())) if len(parts) == 1 else (key, tuple(parts[k] for k in sorted(parts)))
    if "not" in condition:
        return ("not", canonical(condition["not"]))
    operator, value = condition.get("operator", "="), _plain(condition.get("value"))
    if operator in ("in", "not_in") and isinstance(value, list):
        value = sorted({repr(v): v for v in value}.values(), key=repr)
    return (field_of(condition), operator, repr(value), condition.get("case_sensitive", True))


def pattern(like: str) -> str:
    """LIKE without an escape character: backslashes stand for themselves."""
    return like.replace("\\", "\\\\")


def _operands(source: Value, value: Any, condition: dict, ordered: bool) -> tuple[Column, Column]:
    declared = str(condition.get("data_type") or condition.get("value_type") or "").lower()
    numeric_text = isinstance(value, str) and re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", value) is not None
    if source.kind == TIME or declared in ("date", "datetime"):
        return time(source, "filter"), time(literal(str(value)), "filter")
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    numeric = declared in ("number", "numeric", "integer", "float") or is_number or (source.kind in (INTEGER, NUMBER) and numeric_text) or (ordered and numeric_text and declared not in ("string", "text"))
    if numeric:
        x = float(value) if isinstance(value, str) else value
        return number(source, "filter").column, F.lit(int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x)
    if source.kind == BOOLEAN:
        truth = {"true": True, "false": False, "1": True, "0": False}
        return source.column, F.lit(value if isinstance(value, bool) else truth.get(str(value).lower()))
    if isinstance(value, bool):
        return (number(source, "filter").column, F.lit(int(value))) if source.kind in (INTEGER, NUMBER) else (source.column.cast("string"), F.lit(str(value)))
    left, right = source.column.cast("string"), str(value)
    return (F.lower(left), F.lit(right.lower())) if condition.get("case_sensitive") is False else (left, F.lit(right))


def predicate(condition: Any, kinds: dict[str, str], scan: bool = False) -> Column:
    """A normalised, checked tree as a Column. At the scan an empty IN list is plain false; locally null stays unknown."""
    if "all" in condition or "any" in condition:
        key = "all" if "all" in condition else "any"
        out = None
        for c in condition[key]:
            p = predicate(c, kinds, scan)
            out = p if out is None else out & p if key == "all" else out | p
        return out
    if "not" in condition:
        return ~predicate(condition["not"], kinds, scan)
    name, op, value = field_of(condition), condition.get("operator", "="), condition.get("value")
    source = Value(quoted(name), kinds[name])
    if op == "is_null":
        return source.column.isNull()
    if op == "is_not_null":
        return source.column.isNotNull()
    if op in ("in", "not_in"):
        if not value:
            empty = F.lit(op == "not_in")
            return empty if scan else F.when(source.column.isNotNull(), empty)
        known = [v for v in value if v is not None]
        sides = [_operands(source, v, condition, False) for v in known]
        out = F.lit(None).cast("boolean")
        if sides and (source.kind not in (TEXT,) or len({type(v) for v in known}) == 1):
            out = sides[0][0].isin(*[r for _, r in sides])
        else:
            for left, right in sides:
                out = out | (left == right)
        out = out | F.lit(None).cast("boolean") if len(known) < len(value) else out
        return ~out if op == "not_in" else out
    if op == "between":
        (x, low), (y, high) = (_operands(source, v, condition, True) for v in value)
        return (x >= low) & (y <= high)
    if op.removeprefix("not_") in ("contains", "like", "ilike"):
        kind, string, wanted = op.removeprefix("not_"), source.column.cast("string"), str(value)
        if kind == "contains":
            fold = condition.get("case_sensitive") is False
            out = (F.lower(string) if fold else string).contains(wanted.lower() if fold else wanted)
        elif kind == "ilike" or condition.get("case_sensitive") is False:
            out = string.ilike(pattern(wanted))
        else:
            out = string.like(pattern(wanted))
        return ~out if op.startswith("not_") else out
    if source.kind == NULL:
        return F.lit(None).cast("boolean")
    left, right = _operands(source, value, condition, op in _ORDERED)
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
