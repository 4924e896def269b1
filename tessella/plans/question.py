"""Checks of what a question was understood to ask, and the keys that its branches need for their joins."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tessella.functions.values import PlanError
from tessella.sources.catalog import Catalog

from .normalise import identifiers


def _is(kind: type, nonempty: bool = False) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, kind) and not (kind is int and isinstance(v, bool)) and bool(v or not nonempty)


#: Fixed values of the interpretation: its clauses, and the fields of the entries of each list clause with what they hold.
TEXT, LIST = _is(str, True), _is(list)
CLAUSES = ("bindings", "group_by", "metrics", "filters", "required_projection", "order_by", "ambiguities", "limit", "population", "null_policy")
ENTRIES: dict[str, dict[str, Callable[[Any], bool]]] = {
    "bindings": {"phrase": TEXT, "table": TEXT, "column": TEXT, "rule_ids": LIST},
    "group_by": {"table": TEXT, "column": TEXT},
    "metrics": {"output": TEXT, "definition": TEXT, "operands": LIST, "inner_aggregation": TEXT, "outer_aggregation": TEXT, "entity_keys": LIST, "units": TEXT, "rule_ids": LIST},
    "filters": {"phrase": TEXT, "description": _is(str), "operands": LIST, "stage": lambda v: v in ("scan", "final")},
    "order_by": {"column": TEXT, "direction": lambda v: v in ("ASC", "DESC")},
}
#: Where an entry refers to columns, and which entries must quote the question.
REFERENCES, QUOTED = ("operands", "entity_keys"), ("bindings", "filters")


def breaches(asked: Any, question: str, fields: dict[str, list[str]], rules: set[str] = frozenset()) -> list[str]:
    """Everything that is wrong with an interpretation. fields: table -> columns; rules: the known rule ids."""
    if not isinstance(asked, dict):
        return ["an interpretation is an object"]
    found = [f"no such clause: {k}" for k in asked if k not in CLAUSES] + [f"missing clause: {k}" for k in CLAUSES if k not in asked]
    whole = {k: [] for k in CLAUSES} | {"limit": None, "population": "", "null_policy": ""} | asked
    found += [f"{k} is text" for k in ("population", "null_policy") if not isinstance(whole[k], str)]
    if whole["limit"] is not None and not (_is(int)(whole["limit"]) and whole["limit"] > 0):
        found.append("limit is a positive whole number or null")
    lists = [k for k in CLAUSES if k not in ("limit", "population", "null_policy")]
    found += [f"{k} is a list" for k in lists if not isinstance(whole[k], list)]
    whole |= {k: [] for k in lists if not isinstance(whole[k], list)}
    if whole["ambiguities"]:
        found.append(f"the question's meaning is open: {whole['ambiguities']}")
    if not whole["required_projection"] or not all(TEXT(x) and "." not in x for x in whole["required_projection"]):
        found.append("required_projection lists plain output names")
    derived = {m.get("output") for m in whole["metrics"] if isinstance(m, dict)}

    def column(ref: Any, where: str) -> None:
        table, name = (ref.get("table"), ref.get("column")) if isinstance(ref, dict) else (None, None)
        if name not in fields.get(table, []):
            found.append(f"{where}: no such column: {table}.{name}")

    for clause, shape in ENTRIES.items():
        for k, entry in enumerate(whole[clause]):
            where = f"{clause}[{k}]"
            if clause == "group_by" and isinstance(entry, dict) and entry.get("column") in derived and not entry.get("table"):
                continue  # a group by a measure's own output
            if not isinstance(entry, dict) or set(entry) != set(shape):
                found.append(f"{where} has the fields {', '.join(shape)}")
                continue
            found += [f"{where}: bad {f}: {entry[f]!r}" for f, holds in shape.items() if not holds(entry[f])]
            if clause in QUOTED and str(entry["phrase"]) not in question:
                found.append(f"{where}: the phrase isn't in the question: {entry['phrase']!r}")
            if "rule_ids" in shape and isinstance(entry["rule_ids"], list):
                found += [f"{where}: no such rule: {r}" for r in entry["rule_ids"] if r not in rules]
            if {"table", "column"} <= set(shape):
                column(entry, where)
            for part in REFERENCES:
                for ref in entry.get(part) or [] if isinstance(entry.get(part), list) else []:
                    column(ref, where)
    return found


def with_connection_keys(contracts: dict[str, dict], joins: list[dict], catalog: Catalog) -> dict[str, dict]:
    """Retrieval contracts by branch with the keys that the declared joins need of them, and their own required fields.

    joins: {left, right: branches, left_on, right_on}. An added field is optional, so it leaves the rows as they were; a key
    may be written table.field. Keys of different kinds, and unknown ones, are errors.
    """
    errors, added = [], {b: identifiers(c.get("required_fields")) for b, c in contracts.items()}
    known = {b: {f.name: f.dataType for f in catalog.read(c["class"]).schema} for b, c in contracts.items()}
    for j in joins:
        sides = []
        for branch, keys in ((j.get("left"), j.get("left_on")), (j.get("right"), j.get("right_on"))):
            prefix = contracts.get(branch, {}).get("class", "") + "."
            names = [k.removeprefix(prefix) for k in identifiers(keys)]
            unknown = [k for k in names if k not in known.get(branch, {})]
            if unknown or not names:
                errors.append(f"a connection names an unknown branch or key: {branch} {unknown}")
            sides.append((branch, names))
        (left, a), (right, b) = sides
        if len(a) != len(b):
            errors.append(f"a connection has as many left as right keys: {a} {b}")
        for x, y in zip(a, b, strict=False):
            kinds = {type(known[s][k]).__name__ for s, k in ((left, x), (right, y)) if k in known.get(s, {})}
            if len(kinds) > 1 and kinds & {"StringType", "BooleanType"}:
                errors.append(f"connection keys are of different kinds: {x} and {y}")
        for branch, names in sides:
            added.setdefault(branch, []).extend(names)
    errors += [f"{b} requires an unknown field: {f}" for b, fields in added.items() for f in fields if f not in known.get(b, {}) and not any(f in e for e in errors)]
    if errors:
        raise PlanError(errors)
    out = {}
    for branch, contract in contracts.items():
        more = [f for f in dict.fromkeys(added[branch]) if f not in contract["fields"]]
        out[branch] = {**{k: v for k, v in contract.items() if k != "required_fields"}, "fields": [*contract["fields"], *more], "optional_fields": [*(contract.get("optional_fields") or []), *more]}
    return out
