"""Random predicate trees over nulls against DuckDB, and the scan's pushdown."""

import random

import duckdb

from tessella.functions.conditions import breaches, canonical, contradictions, normalise, predicate
from tessella.plans.execute import run

ROWS = [(None, None), (1, "a"), (2, None), (None, "b%"), (3, "A_"), (-1, "ab\\c"), (2, "")]
SQL_OPERATORS = {"=": "=", "!=": "<>", "<": "<", ">=": ">="}


def tree(rng, depth):
    if depth and rng.random() < 0.6:
        kind = rng.choice(["all", "any", "not"])
        if kind == "not":
            c, s = tree(rng, depth - 1)
            return {"not": c}, f"(not {s})"
        parts = [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return {kind: [c for c, _ in parts]}, "(" + (" and " if kind == "all" else " or ").join(s for _, s in parts) + ")"
    field = rng.choice("xs")
    op = rng.choice(["=", "!=", "<", ">=", "in", "not_in", "is_null", "is_not_null", "between", "like", "contains"])
    quote = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    pick = (lambda: rng.choice([-1, 1, 2, 3])) if field == "x" else (lambda: rng.choice(["a", "b%", "A_", "", "ab\\c"]))
    if op in ("like", "contains"):
        field, value = "s", rng.choice(["a%", "%_", "b%", "\\", "A_", ""])
        return {"field": field, "operator": op, "value": value}, f"(s like '{value}' escape '')" if op == "like" else f"contains(s, '{value}')"
    if op.startswith("is_"):
        return {"field": field, "operator": op}, f"({field} is {'not ' if 'not' in op else ''}null)"
    if op in ("in", "not_in"):
        values = [pick() for _ in range(rng.randint(1, 3))] + ([None] if rng.random() < 0.3 else [])
        return {"field": field, "operator": op, "value": values}, f"({field} {op.replace('_', ' ')} ({', '.join(map(quote, values))}))"
    if op == "between":
        low, high = pick(), pick()
        return {"field": field, "operator": op, "value": [low, high]}, f"({field} between {quote(low)} and {quote(high)})"
    value = pick()
    return {"field": field, "operator": op, "value": value}, f"({field} {SQL_OPERATORS[op]} {quote(value)})"


def test_trees_agree_with_sql(spark):
    rng = random.Random(12)
    trees = [tree(rng, 3) for _ in range(80)]
    df = spark.createDataFrame(ROWS, "x int, s string").coalesce(1)
    kinds = {"x": "integer", "s": "text"}
    assert not any(breaches(normalise(c), ["x", "s"], "t") for c, _ in trees)
    got = df.select("x", "s", *[predicate(normalise(c), kinds).alias(f"p{i}") for i, (c, _) in enumerate(trees)]).collect()
    con = duckdb.connect()
    con.execute("create table t (x int, s varchar)")
    con.executemany("insert into t values (?, ?)", ROWS)
    for i, (c, sql) in enumerate(trees):
        want = {(r[0], r[1]): r[2] for r in con.execute(f"select x, s, {sql} from t").fetchall()}
        assert {(r.x, r.s): r[f"p{i}"] for r in got} == want, (c, sql)


def test_canonical_trees():
    a = normalise({"conditions": [{"field": "x", "operator": "gte", "value": 1}, {"field": "y", "operator": "isnull"}], "logic": "or"})
    b = normalise({"or": [{"column": "y", "operator": "is null"}, {"field": "x", "operator": ">=", "value": 1}]})
    assert canonical(a) == canonical(b)
    assert normalise({"field": "d", "operator": "BETWEEN", "value": "'2024-01-01' AND '2024-02-01'"})["value"] == ["2024-01-01", "2024-02-01"]
    assert contradictions(normalise([{"field": "x", "value": 1}, {"field": "x", "value": 2}]))


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = {"steps": [{"operator": "Math_Compute", "expression": "o_totalprice * 2", "output_column": "p"}, {"operator": "Filter_Aggregate", "operation": "filter", "filters": [{"field": "o_orderdate", "operator": ">=", "value": "1997-01-01", "data_type": "date"}, {"field": "o_orderstatus", "operator": "in", "value": ["F", "O"]}]}], "projection": ["o_orderkey", "p"]}
    text = run(plan, {"orders": orders})._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "In(o_orderstatus" in text
    assert "o_custkey" not in text.split("ReadSchema")[-1] and "BatchEvalPython" not in text


def test_nested_conjunctions_and_spellings_of_numbers():
    eq = lambda v, **more: {"field": "x", "operator": "=", "value": v, **more}
    null = {"field": "x", "operator": "is_null"}
    assert contradictions({"all": [null, {"all": [eq(1)]}]}) == ["x is null and compared"]
    assert contradictions({"any": [eq(0), {"all": [eq(1), {"all": [{"any": [eq(2), eq(3)]}, eq(2)]}]}]}) == ["x equals two values"]
    for a, b in ((1, 1.0), (1, "1"), ("1.0", 1), (True, "true"), ("a", "a")):
        assert contradictions({"all": [eq(a), eq(b)]}) == []
    assert contradictions({"all": [eq("A"), eq("a", case_sensitive=False)]}) == [] and contradictions({"all": [eq("A"), eq("a")]}) and contradictions({"all": [eq(True), eq("no")]})
    assert contradictions({"any": [eq(1), eq(2)]}) == contradictions({"not": {"all": [eq(1), null]}}) == []
    flat = {"all": [eq(1), null, eq("y")]}
    assert canonical(flat) == canonical({"all": [{"all": [eq("y"), {"all": [eq(1.0)]}]}, null, eq(1)]}) and canonical({"all": [eq(2)]}) == canonical(eq(2.0))
    assert canonical(eq(1)) != canonical(eq(True)) and canonical(eq("1")) != canonical(eq(1)) and canonical({"any": [eq(1), eq(2)]}) != canonical({"all": [eq(1), eq(2)]})
    listed = lambda v: {"field": "x", "operator": "in", "value": v}
    assert canonical(listed([2, 1.0, 1])) == canonical(listed([1, 2]))
