"""Operators and the compiler's contracts."""

import pytest

from tessella.functions.values import PlanError
from tessella.operators import compare
from tessella.plans import contract, dag, extras, limits
from tessella.plans.compiler import compile_plan
from tessella.plans.execute import run
from tessella.sources import catalog, graph, retrieval, sinks
from tessella.streaming import events


@pytest.fixture(scope="module")
def data(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "x", 3.0), (2, None, None), (None, "y", 5.0)], "id int, g string, v double")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "id int, label string")
    return {"a": a, "b": b}


def out(plan, data):
    return sorted((tuple(r) for r in run(plan, data).collect()), key=str)


def test_null_keys_match_only_when_asked(data):
    join = {"operator": "Integrate", "inputs": ["a", "b"], "join_key": "id"}
    assert len(out({"steps": [join]}, data)) == 4
    assert len(out({"steps": [{**join, "nulls_equal": True}]}, data)) == 5
    assert len(out({"steps": [{**join, "join_type": "full outer"}]}, data)) == 7


def test_cardinality_is_asserted(data):
    with pytest.raises(Exception, match="cardinality"):
        out({"steps": [{"operator": "Integrate", "inputs": ["a", "b"], "join_key": "id", "validate": "m:1"}]}, data)


def test_row_limit_is_an_error(data):
    with pytest.raises(PlanError, match="4 rows"):
        out({"steps": [{"operator": "Integrate", "inputs": ["a", "b"], "join_key": "id", "max_output_rows": 3}]}, data)


def test_groups_keep_nulls(data):
    plan = {"steps": [{"operator": "Filter_Aggregate", "group_by": ["g"], "aggregations": [{"operation": "sum", "target_column": "v", "output_column": "s"}, {"operation": "count", "target_column": "v", "output_column": "n"}, {"operation": "count_rows", "output_column": "m"}], "input": "a"}]}
    assert out(plan, data) == [("x", 4.0, 2, 2), ("y", 5.0, 1, 1), (None, None, 0, 1)]


def test_differences(data):
    base = {"operator": "Set_Difference", "inputs": ["a", "b"], "join_key": ["id"]}
    assert out({"steps": [base]}, data) == [(2, None, None)]
    assert out({"steps": [{**base, "nulls_equal": False}]}, data) == [(2, None, None), (None, "y", 5.0)]
    assert len(out({"steps": [{"operator": "Set_Intersect", "inputs": ["a", "b"], "join_key": ["id"], "distinct": False}]}, data)) == 3
    assert len(out({"steps": [{"operator": "Set_Intersect", "inputs": ["a", "b"], "join_key": ["id"]}]}, data)) == 2


def test_union_fills_absent_fields(data):
    assert len(out({"steps": [{"operator": "Union", "inputs": ["a", "b"], "all": "true"}]}, data)) == 7
    assert len(out({"steps": [{"operator": "Union", "inputs": ["a", "b"], "join_key": ["id"]}]}, data)) == 3


def test_order_limit_and_distinct(data):
    plan = {"steps": [{"operator": "Order_By", "order_by": "v DESC", "input": "a"}, {"operator": "Distinct", "distinct_on": ["id"]}]}
    assert out(plan, data) == [(1, "x", 3.0), (2, None, None), (None, "y", 5.0)]
    top = run({"steps": [{"operator": "Order_By", "order_by": [{"column": "v", "nulls": "first"}], "limit": "2", "input": "a"}]}, data).collect()
    assert [r.v for r in top] == [None, 1.0]


def test_distinct_without_order_keeps_a_whole_row(data):
    got = out({"steps": [{"operator": "Distinct", "distinct_on": ["id"], "input": "a"}]}, data)
    assert got == [(1, "x", 1.0), (2, None, None), (None, "y", 5.0)]


def test_windows(data):
    plan = {"steps": [{"operator": "Order_By", "order_by": "v", "input": "a"}, {"operator": "Math_Compute", "expression": "cumsum(v)", "output_column": "c", "window_partition_by": ["g"]}, {"operator": "Math_Compute", "expression": "lag(v, 1, -1)", "output_column": "l", "window_partition_by": ["g"]}], "projection": ["v", "c", "l"]}
    assert out(plan, data) == [(1.0, 1.0, -1.0), (3.0, 4.0, 1.0), (5.0, 5.0, -1.0), (None, None, -1.0)]


def test_bucket_and_rounding(data):
    plan = {"steps": [{"operator": "Bucket", "input_column": "v", "output_column": "b", "rules": [{"max": 3, "label": "low"}, {"min": 3, "label": "high"}], "default": "none", "input": "a"}], "projection": ["v", "b"]}
    assert out(plan, data) == [(1.0, "low"), (3.0, "low"), (5.0, "high"), (None, "none")]


@pytest.mark.parametrize(
    "steps,message",
    [
        ([{"operator": "Nonsense"}], "unsupported operator"),
        ([{"operator": "Filter_Aggregate", "operation": "sum", "target_column": "zz", "output_column": "s"}], "does not exist"),
        ([{"operator": "Filter_Aggregate", "operation": "sum", "target_column": "v"}], "output_column"),
        ([{"operator": "Filter_Aggregate", "operation": "filter", "filters": [{"field": "v", "operator": "=", "value": None}]}], "null"),
        ([{"operator": "Filter_Aggregate", "operation": "filter", "filters": [{"field": "v", "operator": "=", "value": 1}, {"field": "v", "operator": "is null"}]}], "contradiction"),
        ([{"operator": "Filter_Aggregate", "operation": "filter", "filters": [{"field": "g", "operator": "in", "value": "(select g from b)"}]}], "subquery"),
        ([{"operator": "Math_Compute", "expression": "lag(v)", "output_column": "l"}], "Order_By"),
        ([{"operator": "Order_By", "order_by": "v", "limit": -1}], "limit"),
        ([{"operator": "Date_Extract", "input_column": "v", "part": "week", "output_column": "w"}], "date part"),
        ([{"operator": "Integrate", "inputs": ["a"], "join_key": "id"}], "two inputs"),
        ([{"operator": "Integrate", "inputs": ["a", "b"]}], "explicit keys"),
        ([{"operator": "Integrate", "inputs": ["a", "b"], "join_key": "id", "join_type": "theta"}], "join type"),
        ([{"operator": "Filter_Aggregate", "operation": "percentile", "target_column": "v", "output_column": "p", "quantile": 2}], "quantile"),
        ([{"operator": "Order_By", "order_by": "v", "id": "a"}], "duplicate or invalid"),
    ],
)
def test_contract_errors(steps, message):
    schemas = {"a": ["id", "g", "v"], "b": ["id", "label"]}
    plan = compile_plan({"steps": [{"input": "a", **s} if "inputs" not in s else s for s in steps]}, schemas)
    assert any(message in e for e in plan.errors), plan.errors
    with pytest.raises(PlanError):
        plan.check()


def test_several_errors_come_together():
    plan = compile_plan({"steps": [{"operator": "Distinct", "distinct_on": ["q"], "input": "a"}, {"operator": "Order_By", "order_by": "w"}], "projection": ["zz"]}, {"a": ["id"]})
    assert len(plan.errors) == 3


def test_measures_share_one_aggregate():
    plan = compile_plan({"final_measures": [{"operation": "sum", "input_column": "v", "output_column": "s"}, {"operation": "max", "input_column": "v", "output_column": "m"}], "final_group_by": ["g"]}, {"raw": ["g", "v"]}).check()
    assert [n.operator for n in plan.nodes] == ["Filter_Aggregate"] and plan.fields == ["g", "s", "m"]


def test_measures_of_two_inputs_are_joined(data):
    plan = {"final_measures": [{"operation": "sum", "input_column": "v", "output_column": "s", "inputs": ["a"], "group_by": ["id"]}, {"operation": "count", "input_column": "label", "output_column": "n", "inputs": ["b"], "group_by": ["id"]}]}
    assert out(plan, data) == [(1, 4.0, 2), (2, None, None), (None, 5.0, 1)]


def test_spellings():
    plan = compile_plan({"steps": [{"type": "filter_aggregate", "agg": "AVERAGE", "target_column": "v", "output_column": "m", "input_dataset": "a", "step_id": "s1"}, {"operator": "Filter", "filter": {"column": "m", "operator": "gte", "value": 1}}]}, {"a": ["v"]}).check()
    assert plan.nodes[0].params["measures"][0].operation == "avg"


def test_fingerprint_and_cost():
    def make(name):
        return compile_plan({"steps": [{"operator": "Distinct", "input": "a", "id": name}, {"operator": "Order_By", "order_by": "v", "input": name}]}, {"a": ["v"]}).check()

    one, two = make("p"), make("q")
    assert dag.fingerprint(one) == dag.fingerprint(two) and dag.cost(one) == 3 + 4
    assert dag.breaches(dag.as_dag(one), one.output) == []
    assert dag.breaches({"x": ["y"], "y": ["x"]}, "x")
    assert dag.breaches({"x": [], "y": []}, "x") == ["y doesn't contribute to the output"]


def test_retrieval_contract(data):
    with pytest.raises(PlanError, match="calculate"):
        retrieval.retrieve({"fields": ["id"], "limit": 5}, data["a"])
    got = retrieval.retrieve({"fields": ["g"], "filters": [{"field": "v", "operator": "!=", "value": None}, {"field": "id", "operator": "in", "value": []}]}, data["a"])
    assert got.count() == 0
    assert retrieval.retrieve({"fields": ["g"], "filters": [{"field": "v", "operator": "=", "value": None}]}, data["a"]).count() == 1


def test_yaml_catalog_and_sinks(spark, data, tmp_path):
    (tmp_path / "t.yaml").write_text("identity: {id: T1, subtype: Fact}\nattributes:\n- {name: id, type: integer, nullable: false}\n- {name: v, type: decimal}\nprimary_keys: [id]\n")
    (tmp_path / "c.yaml").write_text("identity: {id: C1, subtype: Context}\nattributes: []\n")
    tables = catalog.load_yaml(str(tmp_path))
    assert [t.name for t in tables] == ["T1"] and tables[0].schema.simpleString() == "struct<id:bigint,v:double>" and tables[0].nullable == {"id": False}
    target = str(tmp_path / "out")
    sinks.write(data["a"], target, "json")
    assert sinks.questions(spark, target).count() == 4
    with pytest.raises(PlanError):
        sinks.write(data["a"], target)


def test_streams_equal_batch(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["col"]).col("ts").cast("timestamp"))
    stream = events.source(spark, str(tmp_path / "in"))
    live = events.drain(events.tumbling(stream), "tumbling_test", "complete", str(tmp_path / "c1"))
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, live.collect())) == sorted(map(key, events.tumbling(batch).collect()))
    once = events.drain(events.unique(stream), "unique_test", "append", str(tmp_path / "c2"))
    assert once.count() == batch.select("event_id").distinct().count()
    totals = events.drain(events.running_totals(stream), "totals_test", "update", str(tmp_path / "c3"))
    assert totals.count() == batch.select("user_id").distinct().count()


def test_contract_and_explanation():
    plan = compile_plan({"steps": [{"operator": "Filter_Aggregate", "operation": "sum", "target_column": "v", "output_column": "s", "group_by": ["g"], "input": "a"}, {"operator": "Order_By", "order_by": "s DESC", "limit": 3}]}, {"a": ["g", "v"]}).check()
    assert contract.breaches(plan, {"projection": ["g", "s"], "group_by": ["g"], "metrics": [{"output_column": "s", "operation": "sum"}], "order_by": "s DESC", "limit": 3}) == []
    assert len(contract.breaches(plan, {"projection": ["s"], "group_by": [], "metrics": [{"output_column": "s", "operation": "sum"}, {"output_column": "t"}], "order_by": "s", "limit": 4})) == 5
    assert [s["operator"] for s in contract.explain(plan)] == ["Filter_Aggregate", "Order_By"]


def test_time_limit(spark):
    assert limits.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(limits.OutOfTime):
        limits.within(spark, 1, lambda: spark.range(10**13).selectExpr("sum(id % 7)").collect())
    with pytest.raises(ZeroDivisionError):
        limits.within(spark, 60, lambda: 1 // 0)


def test_similarity_with_topics(spark):
    df = spark.createDataFrame([(1, "total revenue by region", ["revenue"], ["sum"]), (2, "total revenue by nation", ["revenue"], ["sum"]), (3, "weather by region", ["weather"], [])], "id int, text string, t array<string>, i array<string>")
    got = {(r.l_id, r.r_id): r for r in compare.similar(df, df, "id", "text", 3, "t", "i").collect()}
    assert got[1, 1].label == "near duplicate" and got[1, 2].score > got[1, 3].score and got[1, 3].topic == 0


def test_id_aliases_cover_ids_of_any_length(spark, tmp_path):
    keys = [1, 12, 100, 999, 1000, 1001, 9999, 10000, 12345]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    want = set()
    for k in keys:
        id = f"INV{k:03d}"
        want |= {(id, id), (id.lower(), id)}
        if k < 10000:
            digits = {str(k).zfill(w) for w in range(1, max(3, len(str(k))) + 1)}
            want |= {(p + hyphen + d, id) for p in ("INV", "inv") for hyphen in ("", "-") for d in digits}
    assert {(r.alias, r.id) for r in extras.id_aliases(spark, str(tmp_path)).collect()} == want


def test_hops_have_no_bound(spark):
    chain = [("chain", i, i + 1) for i in range(14)]
    ring = [("ring", i, (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame([*chain, *ring, ("pair", 1, 2), ("loop", 5, 5)], "graph string, a long, b long")
    assert {r.graph: r.hops for r in graph.hops(edges).collect()} == {"chain": 14, "ring": 4, "pair": 1, "loop": 0}


def test_similarity_needs_no_shared_word(spark, monkeypatch):
    from difflib import SequenceMatcher

    monkeypatch.setattr(compare, "LEFT_BLOCK", 2, raising=False)
    monkeypatch.setattr(compare, "RIGHT_BLOCK", 3, raising=False)
    left = {1: "databases", 2: "Weather by region!", 3: "", 4: None, 5: "qqq"}
    right = {1: "database", 2: "weatherby regions", 3: "zzz", 4: "", 5: "region", 6: "data bases", 7: "region weather by"}
    shape = "id long, text string"
    clean = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    def lexical(a, b):
        x, y = clean(a), clean(b)
        return 0.65 * SequenceMatcher(None, " ".join(x), " ".join(y)).ratio() + 0.35 * len({*x} & {*y}) / len({*x} | {*y}) if x and y else 0.0

    want = {i: sorted(((-lexical(a, b), j) for j, b in right.items()))[:3] for i, a in left.items()}
    got = compare.similar(spark.createDataFrame(list(left.items()), shape), spark.createDataFrame(list(right.items()), shape), "id", "text", 3).collect()
    assert len(got) == 3 * len(left)
    for r in got:
        score, best = want[r.l_id][r.rank - 1]
        assert r.r_id == best and r.score == pytest.approx(-score, abs=1e-12)
