"""Windows over all rows, as-of and range joins, guards, grouping sets and sources, against plain Python."""

import random
import sqlite3
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.values import PlanError
from tessella.operators import aggregates, joins, windows
from tessella.operators.relation import Relation, SortKey
from tessella.plans import question
from tessella.plans.compiler import compile_plan
from tessella.plans.execute import run
from tessella.sources import catalog, graph, sqlite


def math(output, expression, **more):
    return {"operator": "Math_Compute", "output_column": output, "expression": expression, **more}


WINDOWS = {
    "n": "row_number()", "s": "cumsum(v)", "hi": "cummax(v)", "lo": "cummin(v)", "before": "lag(v, 3, -9)", "after": "lead(v)", "mean": "rolling_mean(v, 4, 2)",
    "top": "rolling_max(v, 3, 1)", "r": "rank()", "d": "dense_rank()", "p": "percent_rank()", "tile": "ntile(4)", "f": "first_value(v)", "l": "last_value(v)",
}


@pytest.mark.parametrize(("block", "rows"), [(3, 50), (1, 7), (1000, 20), (2, 1), (4, 0)])
def test_windows_over_all_rows_are_windows_of_one_partition(spark, monkeypatch, block, rows):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(rows)
    data = [(rng.choice((None, 1, 2, 5)), i, rng.choice((None, rng.randint(-9, 9)))) for i in range(rows)]
    df = spark.createDataFrame(data, "k int, id int, v int").repartition(3).withColumn("one", F.lit(1))
    order = {"operator": "Order_By", "order_by": "k DESC", "input": "t"}
    for name, expression in WINDOWS.items():
        whole = run({"steps": [order, math(name, expression)]}, {"t": df}).collect()
        parted = run({"steps": [order, math(name, expression, window_partition_by=["one"])]}, {"t": df}).collect()
        assert sorted(map(str, whole)) == sorted(map(str, parted)), expression


def test_window_expressions_mix_functions_and_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 2)
    df = spark.createDataFrame([(i, i * i) for i in range(9)], "id int, v int")
    got = run({"steps": [{"operator": "Order_By", "order_by": "id DESC", "input": "t"}, math("v", "v - coalesce(lag(v), 0) + cumsum(v) * 0"), math("n", "row_number()")]}, {"t": df}).collect()
    assert [(r.id, r.v, r.n) for r in got] == [(i, i * i - ((i + 1) ** 2 if i < 8 else 0), 9 - i) for i in range(8, -1, -1)]
    with pytest.raises(PlanError):
        run({"steps": [{"operator": "Order_By", "order_by": "id", "input": "t"}, math("x", "ntile(0)")]}, {"t": df})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), unique=True, max_size=4), st.lists(st.sampled_from("abcd"), unique=True, max_size=4), st.sampled_from([("", "_right"), ("_l", "_r"), ("", ""), ("_2", "_2")]))
def test_joined_names_are_distinct_and_keep_what_they_can(left, right, suffixes):
    extra = [f + "_right" for f in left[:1]]
    left, right, keys = [*left, *extra], [*right, "k"], ["k"]
    names_l, names_r, fields = joins.joined_names([*left, "k"], right, keys, keys, suffixes)
    assert len(fields) == len(set(fields)) == len(left) + len(right) and names_l["k"] == names_r["k"] == "k"
    for f in {*left, *right} - (set(left) & set(right)):
        assert (names_l | names_r)[f] == f or f == "k"
    assert set(names_l.values()) | set(names_r.values()) == set(fields)


def test_cross_joins_are_lazy_and_limited_by_the_caller(spark):
    data = {"long": spark.range(9).toDF("a"), "short": spark.range(3).toDF("b"), "other": spark.range(8).toDF("c")}
    cross = lambda *x, **more: run({"steps": [{"operator": "Integrate", "inputs": list(x), "join_type": "cross", **more}]}, data)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    made = cross("long", "other")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(jobs)  # nothing runs while the plan is built
    assert made.count() == 72 and cross("short", "long", max_output_rows=27).count() == 27
    with pytest.raises(PlanError, match="27 rows; at most 26"):
        cross("short", "long", max_output_rows=26)


def test_cardinality_guard_moves_keys_only(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, w string")
    join = {"operator": "Integrate", "inputs": ["a", "b"], "join_key": "k", "validate": "1:1", "join_type": "left"}
    assert run({"steps": [join]}, {"a": a, "b": b}).count() == 3  # null keys can't match, so they may repeat
    with pytest.raises(Exception, match="cardinality"):
        run({"steps": [{**join, "nulls_equal": True}]}, {"a": a, "b": b}).count()
    plan = joins.integrate(Relation(a), Relation(b), "inner", ["k"], ["k"], validate="m:1").df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_groups_of_steps_in_any_declared_order(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "k int, v double")
    steps = [
        {"operator": "Integrate", "inputs": ["s", "m"], "join_key": "k", "id": "both"},
        {"operator": "Filter_Aggregate", "operation": "sum", "target_column": "v", "output_column": "s", "group_by": ["k"], "id": "s", "input": "a"},
        {"operator": "Filter_Aggregate", "operation": "max", "target_column": "v", "output_column": "m", "group_by": ["k"], "id": "m", "input": "a"},
    ]
    assert sorted(tuple(r) for r in run({"merge_steps": steps}, {"a": a}).collect()) == [(1, 5.0, 3.0), (2, 5.0, 5.0)]
    loop = compile_plan({"steps": [{"operator": "Distinct", "id": "x", "input": "y"}, {"operator": "Distinct", "id": "y", "input": "x"}]}, {"a": ["k"]})
    assert any("wait for each other" in e for e in loop.errors)
    early = compile_plan({"final_measures": [{"operation": "sum", "input_column": "v", "output_column": "s"}], "final_group_by": ["y"], "final_steps": [{"operator": "Order_By", "order_by": "y"}, {"operator": "Date_Extract", "input_column": "d", "part": "year", "output_column": "y"}]}, {"raw": ["d", "v"]}).check()
    assert [n.operator for n in early.nodes] == ["Date_Extract", "Filter_Aggregate", "Order_By"]
    skip = compile_plan({"merge_steps": [{"operator": "Distinct", "id": "x", "input": "raw"}], "final_steps": [{"operator": "Distinct", "id": "z", "input": "raw"}], "final_output": "x"}, {"raw": ["v"]})
    assert any("explicit merge" in e for e in skip.errors)
    passed = compile_plan({"steps": [{"operator": "Distinct", "id": "x"}, {"operator": "Distinct", "id": "z"}], "output": "x"}, {"raw": ["v"]})
    assert any("bypasses" in e for e in passed.errors)


def test_sets_of_groups_and_plan_distinct(spark):
    a = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 3.0), ("y", 1, 4.0), ("y", 1, 4.0)], "g string, h int, v double")
    measure = {"operation": "sum", "target_column": "v", "output_column": "s"}
    cube = run({"steps": [{"operator": "Filter_Aggregate", "group_by": ["g", "h"], "aggregations": [measure], "grouping": "cube", "input": "a"}]}, {"a": a}).collect()
    assert len(cube) == 3 + 2 + 2 + 1 and [r.s for r in cube if r.g is None and r.h is None] == [13.0]
    bad = compile_plan({"steps": [{"operator": "Filter_Aggregate", "group_by": ["g"], "aggregations": [measure], "grouping": [["q"]], "input": "a"}]}, {"a": ["g", "v"]})
    assert any("grouping" in e for e in bad.errors)
    top = run({"final_steps": [{"operator": "Order_By", "order_by": "v DESC, g", "limit": 2}], "distinct": True, "projection": ["g", "h", "v"]}, {"raw": a}).collect()
    assert [tuple(r) for r in top] == [("y", 1, 4.0), ("x", 2, 3.0)]


def test_text_is_sorted_as_numbers_when_asked(spark):
    df = spark.createDataFrame([("10",), ("9",), ("1,000",), ("x",), (None,)], "t string")
    got = run({"steps": [{"operator": "Order_By", "order_by": [{"column": "t", "as": "number"}], "input": "a"}]}, {"a": df}).collect()
    assert [r.t for r in got[:3]] == ["9", "10", "1,000"] and {r.t for r in got[3:]} == {"x", None}


def test_sqlite_files(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.executescript("""create table a (id integer primary key, name varchar(20) not null, at date, v numeric, unique (name, v));
            create table "odd name" ("x y" text, a_id int references a (id), ok boolean); create unique index part on "odd name" (a_id) where ok;
            create table keyed (k text primary key, n int) without rowid;""")
        db.executemany("insert into a values (?, ?, ?, ?)", [(i, f"n{i}", "2024-01-02", i / 2 if i % 3 else None) for i in range(1, 300)])
        db.execute('insert into "odd name" values (?, ?, ?)', ("q", 5, 1))
        db.execute("insert into keyed values ('a', 1)")
    tables = {t.name: t for t in sqlite.discover(path)}
    a, odd = tables["a"], tables["odd name"]
    assert a.primary == ["id"] and a.unique == [["name", "v"]] and a.nullable["name"] is False and a.schema.simpleString() == "struct<id:bigint,name:string,at:date,v:double>"
    assert odd.unique == [] and odd.foreign == [{"columns": ["a_id"], "table": "a", "target": ["id"]}]
    known = catalog.Catalog(spark, list(tables.values()))
    got = known.read("a")
    assert got.count() == 299 and got.where("v is null").count() == 99 and str(got.where("id = 5").first()) == "Row(id=5, name='n5', at=datetime.date(2024, 1, 2), v=2.5)"
    assert [tuple(r) for r in known.read("odd name").collect()] == [("q", 5, True)] and known.read("keyed").count() == 1
    assert known.health(["a"]).first().instances == 299 and sqlite.scan(spark, a, ["name"]).columns == ["name"]


def test_catalogs_found_in_folders_and_sessions(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.createDataFrame([(1, None), (1, 2), (2, 2)], "a int, b int").createOrReplaceTempView("seen_view")
    assert [(t.name, t.schema.fieldNames()) for t in catalog.discover(spark, str(tmp_path))] == [("t", ["id"])]
    view = next(t for t in catalog.registered(spark) if t.name == "seen_view")
    assert catalog.Catalog(spark, [view]).read("seen_view").count() == 3
    df = spark.table("seen_view")
    assert [catalog.is_key(df, k).first().is_unique for k in (["a"], ["a", "b"], ["b"])] == [False, False, False]
    assert catalog.is_key(df.where("b is not null"), ["a", "b"]).first().is_unique and catalog.is_key(df.limit(0), ["a"]).first().is_unique


def test_single_properties_must_be_single(spark):
    facts = [("s1", graph.TYPE, "C"), ("s1", "p", "1"), ("s1", "q", "2"), ("s1", "q", "2"), ("s2", graph.TYPE, "C"), ("s2", "p", "x"), ("s3", "p", "9")]
    df = spark.createDataFrame(facts, "s string, p string, o string")
    shape = {"a": {"iri": "p", "datatype": graph.XSD + "integer", "single": True}, "b": {"iri": "q", "single": True}}
    got = sorted(tuple(r) for r in graph.class_table(df, "C", shape, optional=("b",)).collect())
    assert got == [("s1", 1, "2"), ("s2", None, None)]
    assert graph.class_table(df, "C", shape).count() == 1
    with pytest.raises(Exception, match="several values"):
        graph.class_table(df.union(spark.createDataFrame([("s1", "q", "3")], "s string, p string, o string")), "C", shape, optional=("b",)).collect()


def test_interpretations_and_connection_keys(spark):
    fields, text = {"sales": ["id", "amount", "region"]}, "total amount by region over 5"
    good = {
        "bindings": [{"phrase": "amount", "table": "sales", "column": "amount", "rule_ids": ["r1"]}], "group_by": [{"table": "sales", "column": "region"}],
        "metrics": [{"output": "total", "definition": "sum", "operands": [{"table": "sales", "column": "amount"}], "inner_aggregation": "none", "outer_aggregation": "sum", "entity_keys": [], "units": "none", "rule_ids": []}],
        "filters": [{"phrase": "over 5", "description": "", "operands": [], "stage": "scan"}], "required_projection": ["region", "total"],
        "order_by": [{"column": "total", "direction": "DESC"}], "ambiguities": [], "limit": None, "population": "all", "null_policy": "keep",
    }
    assert question.breaches(good, text, fields, {"r1"}) == []
    for clause, value, message in [
        ("limit", 0, "positive"), ("limit", True, "positive"), ("ambiguities", ["which?"], "open"), ("required_projection", ["sales.total"], "plain"), ("filters", [{**good["filters"][0], "stage": "later"}], "stage"),
        ("bindings", [{**good["bindings"][0], "phrase": "profit"}], "isn't in"), ("bindings", [{**good["bindings"][0], "rule_ids": ["r9"]}], "no such rule"), ("group_by", [{"table": "sales", "column": "x"}], "no such column"),
        ("order_by", [{"column": "total"}], "has the fields"), ("metrics", "total", "is a list"), ("population", 1, "text"),
    ]:
        assert any(message in e for e in question.breaches({**good, clause: value}, text, fields, {"r1"})), (clause, value)
    assert question.breaches({k: v for k, v in good.items() if k != "limit"} | {"extra": 1}, text, fields, {"r1"}) == ["no such clause: extra", "missing clause: limit"]
    known = catalog.Catalog.folder(spark, "/root/testdata/sf0.001", ["customer", "orders"])
    asked = {"c": {"class": "customer", "fields": ["c_name"], "required_fields": ["c_acctbal"]}, "o": {"class": "orders", "fields": ["o_totalprice"]}}
    got = question.with_connection_keys(asked, [{"left": "c", "left_on": "customer.c_custkey", "right": "o", "right_on": "o_custkey"}], known)
    assert got["c"]["fields"] == ["c_name", "c_acctbal", "c_custkey"] and got["o"] == {"class": "orders", "fields": ["o_totalprice", "o_custkey"], "optional_fields": ["o_custkey"]}
    for join in ({"left": "c", "left_on": "nope", "right": "o", "right_on": "o_custkey"}, {"left": "c", "left_on": "c_name", "right": "o", "right_on": "o_custkey"}, {"left": "c", "left_on": ["c_custkey", "c_name"], "right": "o", "right_on": "o_custkey"}, {"left": "z", "left_on": "a", "right": "o", "right_on": "o_custkey"}):
        with pytest.raises(PlanError):
            question.with_connection_keys(asked, [join], known)


def test_intermediate_rows_can_be_released(spark):
    mark, before = windows.written(), spark.sparkContext.getCheckpointDir()
    kept = windows.checkpointed(spark.range(5))
    paths = windows._WRITTEN[mark:]
    assert kept.count() == 5 and len(paths) == 1 and spark.sparkContext.getCheckpointDir() == before
    windows.release(spark, mark)
    at = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert windows.written() == mark and not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_sum_in_order_is_the_same_on_any_partitioning(spark):
    """One addition after the other by id; nulls don't count, and a group of nulls has no sum."""
    rows = [(i, i % 3, None if i % 7 == 0 or i % 3 == 2 else i / 10) for i in range(300)]
    want = {g: None if g == 2 else reduce(lambda a, b: a + b, (x for _, h, x in rows if h == g and x is not None)) for g in range(3)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "i int, g int, x double").repartition(parts)
        made = [aggregates.Measure("sum", "total", "x", method="in_order"), aggregates.Measure("count", "n", "x")]
        got = aggregates.aggregate(Relation(df, (SortKey("i"),)), ["g"], made).df
        assert got.columns == ["g", "total", "n"] and {r.g: r.total for r in got.collect()} == want
    with pytest.raises(PlanError):
        aggregates.aggregate(Relation(df), ["g"], made)


def test_property_profile_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_PER_TASK", 5)
    rows = [(f"s{i}", graph.TYPE, "C", None) for i in range(20)] + [(f"s{i % 10}", "p", f"v{i % 3}", ["int", None][i % 2]) for i in range(30)]
    r = graph.property_profile(spark.createDataFrame(rows, "s string, p string, o string, datatype string")).first()
    assert (r["values"], r.distinct, r.most_subjects, r.instances, r.members, r.datatypes) == (30, 3, 10, 10, 20, ["int"])
