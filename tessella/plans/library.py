"""Named plans over the star-schema tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .execute import run


@dataclass(frozen=True)
class Query:
    tables: tuple[str, ...]
    plan: dict[str, Any]
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(self.plan, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})


def agg(operation: str, target: str | None, output: str, **more) -> dict:
    return {"operation": operation, "target_column": target, "output_column": output, **more}


def group(by: list[str], *measures: dict, **more) -> dict:
    return {"operator": "Filter_Aggregate", "group_by": by, "aggregations": list(measures), **more}


def where(*filters: dict, **more) -> dict:
    return {"operator": "Filter_Aggregate", "operation": "filter", "filters": list(filters), **more}


def cond(field: str, operator: str, value: Any = None, **more) -> dict:
    return {"field": field, "operator": operator, **({} if operator.startswith("is_") else {"value": value}), **more}


def math(output: str, expression: str, **more) -> dict:
    return {"operator": "Math_Compute", "output_column": output, "expression": expression, **more}


def join(inputs: list[str], left: str | list, right: str | list, how: str = "inner", **more) -> dict:
    return {"operator": "Integrate", "inputs": inputs, "left_on": left, "right_on": right, "join_type": how, **more}


def sort(order_by: Any, **more) -> dict:
    return {"operator": "Order_By", "order_by": order_by, **more}


REVENUE = math("revenue", "round(l_extendedprice * (1 - l_discount), 4)")
C = "customer"
#: a measure and a key with nulls, made alike on both sides
NULLED = [math("bal", "nullif(round(c_acctbal, 0) % 5, 0)"), math("seg", "nullif(c_mktsegment, 'BUILDING')")]
NULLED_SQL = "select *, nullif(r - 5 * floor(r / 5), 0) as bal, nullif(c_mktsegment, 'BUILDING') as seg from (select *, round_even(c_acctbal, 0) as r from customer)"
DAY = "cast(l_shipdate as date)"

QUERIES: dict[str, Query] = {
    # the flagship: revenue by market segment over three tables
    "segment_revenue": Query(
        (C, "orders", "lineitem"),
        {
            "merge_steps": [join([C, "orders"], "c_custkey", "o_custkey", id="co"), join(["co", "lineitem"], "o_orderkey", "l_orderkey", id="col")],
            "pre_steps": [math("revenue", "l_extendedprice * (1 - l_discount)")],
            "final_measures": [agg("sum", "revenue", "total"), agg("count", "*", "n"), agg("avg", "l_quantity", "mean_quantity")],
            "final_group_by": ["c_mktsegment"],
            "final_steps": [sort("total DESC, c_mktsegment", limit=10)],
            "rounding": {"total": 1, "mean_quantity": 4},
        },
        "select c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 1) as total, count(*) as n, round(avg(l_quantity), 4) as mean_quantity from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey group by 1 order by total desc limit 10",
    ),
    "pricing_summary": Query(
        ("lineitem",),
        {
            "steps": [
                where(cond("l_shipdate", "<=", "1998-09-02", data_type="date")),
                math("disc_price", "l_extendedprice * (1 - l_discount)"),
                math("charge", "disc_price * (1 + l_tax)"),
                group(["l_returnflag", "l_linestatus"], agg("sum", "l_quantity", "sum_qty"), agg("sum", "l_extendedprice", "sum_base"), agg("sum", "disc_price", "sum_disc"), agg("sum", "charge", "sum_charge"), agg("avg", "l_quantity", "avg_qty"), agg("count_rows", "*", "n")),
                sort(["l_returnflag", "l_linestatus"]),
            ],
            "rounding": {"sum_qty": 1, "sum_base": 0, "sum_disc": 0, "sum_charge": 0, "avg_qty": 4},
        },
        "select l_returnflag, l_linestatus, round(sum(l_quantity), 1) as sum_qty, round(sum(l_extendedprice), 0) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 0) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) as sum_charge, round(avg(l_quantity), 4) as avg_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    ),
    # scans, projections, predicates
    "scan_projection": Query(("nation",), {"steps": [], "projection": ["n_name", "n_nationkey"]}, "select n_name, n_nationkey from nation"),
    "copy_rename": Query(("region",), {"steps": [math("name", "column('r_name')")], "projection": ["name"]}, "select r_name as name from region"),
    "filter_comparison": Query((C,), {"steps": [where(cond("c_acctbal", ">", 5000), cond("c_mktsegment", "!=", "BUILDING"))], "projection": ["c_custkey", "c_acctbal"]}, "select c_custkey, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment <> 'BUILDING'"),
    "filter_numeric_text": Query((C,), {"steps": [where(cond("c_acctbal", "gte", "7500.5"))], "projection": ["c_custkey"]}, "select c_custkey from customer where c_acctbal >= 7500.5"),
    "filter_date": Query(("orders",), {"steps": [where(cond("o_orderdate", "between", ["1995-01-01", "1995-12-31"], data_type="date"))], "projection": ["o_orderkey"]}, "select o_orderkey from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1995-12-31'"),
    "filter_between": Query(("part",), {"steps": [where(cond("p_size", "between", [10, 20]))], "projection": ["p_partkey", "p_size"]}, "select p_partkey, p_size from part where p_size between 10 and 20"),
    "filter_in": Query((C,), {"steps": [where(cond("c_mktsegment", "in", ["BUILDING", "MACHINERY"]))], "projection": ["c_custkey"]}, "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "filter_not_in_null": Query((C,), {"steps": [*NULLED, where(cond("seg", "not in", ["MACHINERY"]), {"not": cond("seg", "in", ["AUTOMOBILE", None])})], "projection": ["c_custkey"]}, f"select c_custkey from ({NULLED_SQL}) where seg not in ('MACHINERY') and not (seg in ('AUTOMOBILE', null))"),
    "filter_null_tests": Query((C,), {"steps": [*NULLED, where({"any": [cond("bal", "is_null"), {"all": [cond("seg", "is_null"), cond("bal", "is_not_null")]}]})], "projection": ["c_custkey"]}, f"select c_custkey from ({NULLED_SQL}) where bal is null or (seg is null and bal is not null)"),
    "filter_not_any_null": Query((C,), {"steps": [*NULLED, where({"not": {"any": [cond("bal", "=", 2), cond("seg", "=", "MACHINERY")]}})], "projection": ["c_custkey"]}, f"select c_custkey from ({NULLED_SQL}) where not (bal = 2 or seg = 'MACHINERY')"),
    "filter_contains": Query(("part",), {"steps": [where(cond("p_name", "contains", "re", case_sensitive=False), cond("p_type", "not_contains", "BRASS"))], "projection": ["p_partkey"]}, "select p_partkey from part where contains(lower(p_name), 're') and not contains(p_type, 'BRASS')"),
    "filter_like": Query(("part",), {"steps": [where(cond("p_type", "like", "%A_%"), cond("p_type", "not like", "%E"))], "projection": ["p_partkey"]}, "select p_partkey from part where p_type like '%A_%' and p_type not like '%E'"),
    "filter_ilike": Query(("part",), {"steps": [where({"any": [cond("p_type", "ilike", "%brass"), cond("p_brand", "not_ilike", "brand#1%")]})], "projection": ["p_partkey"]}, "select p_partkey from part where p_type ilike '%brass' or p_brand not ilike 'brand#1%'"),
    "filter_case_insensitive": Query((C,), {"steps": [where(cond("c_mktsegment", "=", "building", case_sensitive=False))], "projection": ["c_custkey"]}, "select c_custkey from customer where lower(c_mktsegment) = 'building'"),
    "filter_empty_in": Query((C,), {"steps": [where({"any": [cond("c_name", "in", []), cond("c_custkey", "<=", 5)]})], "projection": ["c_custkey"]}, "select c_custkey from customer where c_custkey <= 5"),
    "having": Query(("orders",), {"steps": [group(["o_custkey"], agg("count", "*", "n")), where(cond("n", ">", 12))]}, "select o_custkey, count(*) as n from orders group by 1 having count(*) > 12"),
    "rounding_exact": Query(("lineitem",), {"steps": [math("x", "l_extendedprice / 1000"), math("y", "round(l_extendedprice / 1000, 2)")], "projection": ["l_orderkey", "l_linenumber", "y"]}, "select l_orderkey, l_linenumber, round_even(l_extendedprice / 1000, 2) as y from lineitem"),
    # joins
    "join_inner_composite": Query(("lineitem", "supplier"), {"merge_steps": [join(["lineitem", "supplier"], "l_suppkey", "s_suppkey", validate="m:1")], "final_measures": [agg("sum", "l_quantity", "q")], "final_group_by": ["s_nationkey"], "rounding": 2}, "select s_nationkey, round(sum(l_quantity), 2) as q from lineitem join supplier on l_suppkey = s_suppkey group by 1"),
    "join_left": Query((C, "orders"), {"merge_steps": [join([C, "orders"], "c_custkey", "o_custkey", "left")], "final_measures": [agg("count", "o_orderkey", "orders"), agg("count_rows", "*", "rows")], "final_group_by": ["c_nationkey"]}, "select c_nationkey, count(o_orderkey) as orders, count(*) as rows from customer left join orders on c_custkey = o_custkey group by 1"),
    "join_right": Query(("orders", C), {"merge_steps": [join(["orders", C], "o_custkey", "c_custkey", "right")], "final_steps": [where(cond("o_orderkey", "is_null"))], "projection": ["c_custkey"]}, "select c_custkey from orders right join customer on o_custkey = c_custkey where o_orderkey is null"),
    "join_full_nullsafe": Query((C, "supplier"), {"pre_steps": [{**math("k", "nullif(c_nationkey, 3)"), "input": C, "id": "a"}, group(["k"], agg("count", "*", "n"), input="a", id="b"), {**math("k", "nullif(nullif(s_nationkey, 3), 5)"), "input": "supplier", "id": "c"}, group(["k"], agg("count", "*", "m"), input="c", id="d"), {"operator": "Integrate", "inputs": ["b", "d"], "join_key": ["k"], "join_type": "outer", "nulls_equal": True, "validate": "1:1"}]}, "select coalesce(a.k, b.k) as k, n, m from (select nullif(c_nationkey, 3) as k, count(*) as n from customer group by 1) a full join (select nullif(nullif(s_nationkey, 3), 5) as k, count(*) as m from supplier group by 1) b on a.k is not distinct from b.k"),
    "join_null_keys": Query((C, "nation"), {"merge_steps": [{**math("k", "nullif(c_nationkey, 3)"), "input": C, "id": "a"}, {**math("k", "nullif(n_nationkey, 3)"), "input": "nation", "id": "b"}, join(["a", "b"], ["k"], ["k"])], "final_measures": [agg("count", "*", "n")]}, "select count(*) as n from (select nullif(c_nationkey, 3) as k from customer) a join (select nullif(n_nationkey, 3) as k from nation) b using (k)"),
    "join_cross_scalar": Query((C,), {"pre_steps": [{"operator": "Filter_Aggregate", "input": C, "operation": "avg", "target_column": "c_acctbal", "output_column": "mean", "id": "m"}, {"operator": "Integrate", "inputs": [C, "m"], "join_type": "cross"}], "final_steps": [math("gap", "round(c_acctbal - mean, 2)"), where(cond("gap", ">", 4000))], "projection": ["c_custkey", "gap"]}, "select c_custkey, round(c_acctbal - mean, 2) as gap from customer, (select avg(c_acctbal) as mean from customer) where round(c_acctbal - mean, 2) > 4000"),
    "join_suffixes": Query(("nation", "region"), {"merge_steps": [{**math("name", "n_name"), "input": "nation", "id": "a"}, {**math("name", "r_name"), "input": "region", "id": "b"}, {**math("name_right", "r_name"), "input": "b", "id": "c"}, join(["a", "c"], "n_regionkey", "r_regionkey", id="j")], "projection": ["name", "name_right", "name_right_2"]}, "select n_name as name, r_name as name_right, r_name as name_right_2 from nation join region on n_regionkey = r_regionkey"),
    "join_self": Query(("nation",), {"steps": [join(["nation", "nation"], "n_regionkey", "n_regionkey"), where(cond("n_nationkey", "<", 5))], "projection": ["n_name", "n_name_right"]}, "select a.n_name, b.n_name as n_name_right from nation a join nation b using (n_regionkey) where a.n_nationkey < 5"),
    "join_multiway": Query(("nation", "region", C), {"merge_steps": [join([C, "nation"], "c_nationkey", "n_nationkey", id="x"), join(["x", "region"], "n_regionkey", "r_regionkey")], "final_measures": [agg("count", "*", "n")], "final_group_by": ["r_name"]}, "select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"),
    "semi_join": Query((C, "orders"), {"steps": [{"operator": "Set_Intersect", "inputs": [C, "orders"], "left_on": ["c_custkey"], "right_on": ["o_custkey"], "distinct": False, "nulls_equal": False}], "projection": ["c_custkey"]}, "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "anti_join": Query((C, "orders"), {"steps": [{"operator": "Set_Difference", "inputs": [C, "orders"], "left_on": ["c_custkey"], "right_on": ["o_custkey"], "distinct": False, "nulls_equal": False}], "projection": ["c_custkey"]}, "select c_custkey from customer where c_custkey not in (select o_custkey from orders)"),
    "anti_null_keys": Query((C, "supplier"), {"merge_steps": [{**math("k", "nullif(c_nationkey, 3)"), "input": C, "id": "a"}, {**math("k", "s_nationkey"), "input": "supplier", "id": "b"}, {"operator": "Difference", "inputs": ["a", "b"], "join_key": ["k"], "distinct": False, "nulls_equal": False}], "projection": ["c_custkey", "k"]}, "select c_custkey, k from (select *, nullif(c_nationkey, 3) as k from customer) a where not exists (select 1 from supplier where s_nationkey = a.k)"),
    "snapshot_latest": Query(("orders",), {"pre_steps": [{"operator": "Filter_Aggregate", "input": "orders", "group_by": ["o_custkey"], "operation": "max", "target_column": "o_orderdate", "output_column": "latest", "id": "m"}, join(["orders", "m"], ["o_custkey", "o_orderdate"], ["o_custkey", "latest"])], "projection": ["o_orderkey", "o_custkey"]}, "select o_orderkey, o_custkey from orders join (select o_custkey, max(o_orderdate) as d from orders group by 1) m using (o_custkey) where o_orderdate = d"),
    # aggregates
    "agg_multi": Query((C,), {"steps": [*NULLED, group(["seg"], agg("count", "*", "n"), agg("count", "bal", "n_bal"), agg("sum", "bal", "s"), agg("avg", "bal", "a"), agg("min", "bal", "lo"), agg("max", "bal", "hi"), agg("count_distinct", "bal", "d"))], "rounding": {"a": 6}}, f"select seg, count(*) as n, count(bal) as n_bal, sum(bal) as s, round(avg(bal), 6) as a, min(bal) as lo, max(bal) as hi, count(distinct bal) as d from ({NULLED_SQL}) group by 1"),
    "agg_distinct_flag": Query(("part",), {"steps": [group(["p_brand"], agg("sum", "p_size", "s", distinct=True), agg("avg", "p_size", "a", distinct=True), agg("count", "p_size", "n", distinct=True))], "rounding": {"a": 6}}, "select p_brand, cast(sum(distinct p_size) as bigint) as s, round(avg(distinct p_size), 6) as a, count(distinct p_size) as n from part group by 1"),
    "agg_scalar_empty": Query((C,), {"steps": [where(cond("c_custkey", "<", 0)), group([], agg("count", "*", "n"), agg("sum", "c_acctbal", "s"), agg("max", "c_name", "m"))]}, "select count(*) as n, sum(c_acctbal) as s, max(c_name) as m from customer where c_custkey < 0"),
    "agg_percentile": Query(("lineitem",), {"steps": [group(["l_returnflag"], agg("median", "l_quantity", "m"), agg("percentile", "l_quantity", "p", quantile=0.9), agg("percentile_25", "l_extendedprice", "q"))], "rounding": 6}, "select l_returnflag, round(median(l_quantity), 6) as m, round(quantile_cont(l_quantity, 0.9), 6) as p, round(quantile_cont(l_extendedprice, 0.25), 6) as q from lineitem group by 1"),
    "agg_scalar_percentile": Query((C,), {"steps": [math("p", "percentile(column('c_acctbal'), 0.9)")], "rounding": 4}, "select round(quantile_cont(c_acctbal, 0.9), 4) as p from customer"),
    "agg_conditional": Query(("orders",), {"steps": [math("open", "where(o_orderstatus == 'O', o_totalprice, 0)"), group(["o_orderpriority"], agg("sum", "open", "open_total"), agg("count", "*", "n"))], "rounding": {"open_total": 1}}, "select o_orderpriority, round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end), 1) as open_total, count(*) as n from orders group by 1"),
    "agg_filtered_measure": Query(("orders",), {"steps": [group(["o_orderpriority"], agg("count", "*", "f", filters=[cond("o_orderstatus", "=", "F")]), agg("count", "*", "n"))]}, "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as f, count(*) as n from orders group by 1"),
    "two_level_agg": Query(("orders",), {"steps": [group(["o_custkey", "o_orderstatus"], agg("sum", "o_totalprice", "total")), group(["o_orderstatus"], agg("avg", "total", "mean"), agg("max", "total", "most"))], "rounding": 2}, "select o_orderstatus, round(avg(total), 2) as mean, round(max(total), 2) as most from (select o_custkey, o_orderstatus, sum(o_totalprice) as total from orders group by 1, 2) group by 1"),
    "combine_scalars": Query((C, "orders"), {"merge_steps": [group([], agg("count", "*", "customers"), input=C, id="a"), group([], agg("count", "*", "orders"), agg("max", "o_totalprice", "top"), input="orders", id="b"), {"operator": "Combine_Scalars", "inputs": ["a", "b"]}], "final_steps": [math("per", "round(orders / customers, 4)")]}, "select customers, orders, top, round(orders / customers, 4) as per from (select count(*) as customers from customer), (select count(*) as orders, max(o_totalprice) as top from orders)"),
    "minmax_index": Query((C,), {"pre_steps": [group([], agg("min", "c_acctbal", "lo"), agg("max", "c_acctbal", "hi"), input=C, id="s"), {"operator": "Integrate", "inputs": [C, "s"], "join_type": "cross"}], "final_steps": [math("score", "round((c_acctbal - lo) / (hi - lo) * 100, 4)")], "projection": ["c_custkey", "score"]}, "select c_custkey, round((c_acctbal - lo) / (hi - lo) * 100, 4) as score from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)"),
    "share_of_group": Query(("orders",), {"merge_steps": [group(["o_custkey"], agg("sum", "o_totalprice", "book"), input="orders", id="b"), {"operator": "Integrate", "inputs": ["orders", "b"], "join_key": ["o_custkey"]}], "final_steps": [math("share", "round(o_totalprice / book, 6)"), where(cond("share", ">", 0.5))], "projection": ["o_orderkey", "share"]}, "select o_orderkey, share from (select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders) where share > 0.5"),
    "cohort_proportion": Query((C,), {"steps": [*NULLED, math("hit", "where(bal > 2, 1, 0)"), group(["c_nationkey"], agg("avg", "hit", "share"))], "rounding": 6}, f"select c_nationkey, round(avg(case when bal > 2 then 1 else 0 end), 6) as share from ({NULLED_SQL}) group by 1"),
    "max_concentration": Query((C, "orders"), {"merge_steps": [join(["orders", C], "o_custkey", "c_custkey")], "pre_steps": [group(["c_custkey", "c_mktsegment"], agg("max", "o_totalprice", "top"))], "final_measures": [agg("avg", "top", "mean_top")], "final_group_by": ["c_mktsegment"], "rounding": 2}, "select c_mktsegment, round(avg(top), 2) as mean_top from (select c_custkey, c_mktsegment, max(o_totalprice) as top from orders join customer on o_custkey = c_custkey group by 1, 2) group by 1"),
    # windows
    "win_row_number": Query(("orders",), {"steps": [sort("o_custkey, o_orderdate DESC, o_orderkey"), math("rn", "row_number()", window_partition_by=["o_custkey"]), where(cond("rn", "<=", 2))], "projection": ["o_custkey", "o_orderkey", "rn"]}, "select o_custkey, o_orderkey, rn from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn <= 2"),
    "win_lag_lead": Query(("orders",), {"steps": [sort("o_orderdate, o_orderkey"), math("before", "lag(o_totalprice, 1, 0)", window_partition_by=["o_custkey"]), math("after", "lead(o_totalprice, 2)", window_partition_by=["o_custkey"])], "projection": ["o_orderkey", "before", "after"]}, "select o_orderkey, lag(o_totalprice, 1, 0) over w as before, lead(o_totalprice, 2) over w as after from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"),
    "win_rolling": Query((C,), {"steps": [*NULLED, sort("c_custkey"), math("m", "rolling_mean(bal, 3, 2)", window_partition_by=["c_nationkey"]), math("s", "rolling_sum(bal, 3)", window_partition_by=["c_nationkey"])], "projection": ["c_custkey", "m", "s"], "rounding": 6}, f"select c_custkey, round(case when count(bal) over w >= 2 then avg(bal) over w end, 6) as m, round(case when count(bal) over w >= 3 then sum(bal) over w end, 6) as s from ({NULLED_SQL}) window w as (partition by c_nationkey order by c_custkey rows between 2 preceding and current row)"),
    "win_cumsum": Query((C,), {"steps": [*NULLED, sort("c_custkey"), math("t", "cumsum(bal)", window_partition_by=["seg"])], "projection": ["c_custkey", "t"]}, f"select c_custkey, case when bal is not null then sum(bal) over (partition by seg order by c_custkey) end as t from ({NULLED_SQL})"),
    # sorting, sets, distinct
    "topk_tiebreak": Query(("part",), {"steps": [sort([{"column": "p_size", "direction": "DESC"}, "p_partkey"], limit=15)], "projection": ["p_partkey", "p_size"]}, "select p_partkey, p_size from part order by p_size desc, p_partkey limit 15"),
    "sort_nulls_last": Query((C,), {"steps": [*NULLED, sort([{"column": "bal", "direction": "DESC"}, {"column": "c_custkey"}], limit=20)], "projection": ["c_custkey", "bal"]}, f"select c_custkey, bal from ({NULLED_SQL}) order by bal desc nulls last, c_custkey limit 20"),
    "topk_stable": Query(("part",), {"steps": [sort("p_partkey"), sort("p_size", limit=12)], "projection": ["p_partkey"]}, "select p_partkey from part order by p_size, p_partkey limit 12"),
    "topk_distinct_first": Query(("part",), {"final_steps": [sort("p_size DESC", limit=5)], "distinct_on": ["p_size"], "projection": ["p_size"]}, "select distinct p_size from part order by p_size desc limit 5"),
    "set_intersect": Query((C, "supplier"), {"steps": [{"operator": "Set_Intersect", "inputs": [C, "supplier"], "left_on": ["c_nationkey"], "right_on": ["s_nationkey"]}], "projection": ["c_nationkey"]}, "select c_nationkey from customer intersect select s_nationkey from supplier"),
    "set_difference": Query(("nation", "supplier"), {"steps": [{"operator": "Difference", "inputs": ["nation", "supplier"], "left_on": ["n_nationkey"], "right_on": ["s_nationkey"]}], "projection": ["n_nationkey"]}, "select n_nationkey from nation except select s_nationkey from supplier"),
    "set_union": Query((C, "supplier"), {"merge_steps": [group(["c_nationkey"], agg("count", "*", "n"), input=C, id="a"), {**math("k", "c_nationkey"), "input": "a", "id": "b"}, group(["s_nationkey"], agg("count", "*", "n"), input="supplier", id="c"), {**math("k", "s_nationkey"), "input": "c", "id": "d"}, {"operator": "Set_Union", "inputs": ["b", "d"]}], "projection": ["k", "n", "s_nationkey"]}, "select c_nationkey as k, n, null::int as s_nationkey from (select c_nationkey, count(*) as n from customer group by 1) union select s_nationkey, n, s_nationkey from (select s_nationkey, count(*) as n from supplier group by 1)"),
    "set_union_all": Query(("nation", "region"), {"merge_steps": [{**math("name", "n_name"), "input": "nation", "id": "a"}, {**math("name", "r_name"), "input": "region", "id": "b"}, {"operator": "Union", "inputs": ["a", "b"], "all": True}], "projection": ["name"]}, "select n_name as name from nation union all select r_name from region"),
    "set_union_keyed": Query((C, "supplier"), {"merge_steps": [{**math("k", "c_nationkey"), "input": C, "id": "a"}, {**math("k", "s_nationkey"), "input": "supplier", "id": "b"}, {"operator": "Union", "inputs": ["a", "b"], "join_key": ["k"]}], "projection": ["k"]}, "select c_nationkey as k from customer union select s_nationkey from supplier"),
    "distinct_all": Query(("part",), {"steps": [{"operator": "Distinct"}, group(["p_brand", "p_type"], agg("count", "*", "n"))]}, "select p_brand, p_type, count(*) as n from part group by 1, 2"),
    "distinct_on": Query(("orders",), {"steps": [sort("o_totalprice DESC, o_orderkey"), {"operator": "Distinct", "distinct_on": ["o_custkey"]}], "projection": ["o_custkey", "o_orderkey"]}, "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1"),
    # scalar functions
    "math_arithmetic": Query(("lineitem",), {"steps": [math("a", "l_quantity / nullif(l_linenumber - 1, 0)"), math("b", "(l_linenumber - 4) % 3"), math("c", "-l_quantity ** 2"), math("d", "abs(l_linenumber - 4) + 1"), math("e", "l_linenumber / 0")], "projection": ["l_orderkey", "l_linenumber", "a", "b", "c", "d", "e"], "rounding": {"a": 6}}, "select l_orderkey, l_linenumber, round(l_quantity / nullif(l_linenumber - 1, 0), 6) as a, cast((l_linenumber - 4) - floor((l_linenumber - 4) / 3.0) * 3 as bigint) as b, -(l_quantity ** 2) as c, cast(abs(l_linenumber - 4) + 1 as bigint) as d, null::double as e from lineitem"),
    "math_logic": Query((C,), {"steps": [*NULLED, math("t", "(bal > 1 and not seg == 'MACHINERY') or bal is null"), math("u", "1 < bal <= 3"), math("v", "bal in (1, 2)")], "projection": ["c_custkey", "t", "u", "v"]}, f"select c_custkey, (bal > 1 and not seg = 'MACHINERY') or bal is null as t, 1 < bal and bal <= 3 as u, bal in (1, 2) as v from ({NULLED_SQL})"),
    "case_when": Query((C,), {"steps": [math("band", "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal <= 5000 THEN 'low' ELSE 'high' END"), group(["band"], agg("count", "*", "n"))]}, "select case when c_acctbal < 0 then 'debt' when c_acctbal <= 5000 then 'low' else 'high' end as band, count(*) as n from customer group by 1"),
    "math_text": Query(("part",), {"steps": [math("a", "upper(substr(p_name, 1, 3))"), math("b", "length(p_name)"), math("c", "lower(p_brand)"), math("d", "like(p_type, '%BRASS')"), math("e", "coalesce(nullif(p_brand, 'Brand#11'), 'none')"), math("f", "contains(p_name, 'a')")], "projection": ["p_partkey", "a", "b", "c", "d", "e", "f"]}, "select p_partkey, upper(substr(p_name, 1, 3)) as a, length(p_name) as b, lower(p_brand) as c, p_type like '%BRASS' as d, coalesce(nullif(p_brand, 'Brand#11'), 'none') as e, contains(p_name, 'a') as f from part"),
    "math_templates": Query(("lineitem",), {"steps": [{"operator": "Math_Compute", "operation": "percentage_change", "left_column": "l_quantity", "right_column": "l_linenumber", "output_column": "p"}, {"operator": "Math_Compute", "operation": "absolute_gap", "left_column": "l_quantity", "right_column": "l_linenumber", "output_column": "g"}], "projection": ["l_orderkey", "l_linenumber", "p", "g"], "rounding": {"p": 4}}, "select l_orderkey, l_linenumber, round((l_linenumber - l_quantity) / l_quantity * 100, 4) as p, abs(l_quantity - l_linenumber) as g from lineitem"),
    "bucket": Query((C,), {"steps": [*NULLED, {"operator": "Bucket", "input_column": "bal", "output_column": "band", "rules": [{"max": 1, "label": "low"}, {"min": 1, "max": 3, "min_inclusive": False, "max_inclusive": False, "label": "mid"}, {"min": 3, "label": "high"}], "default": "none"}, group(["band"], agg("count", "*", "n"))]}, f"select case when bal <= 1 then 'low' when bal > 1 and bal < 3 then 'mid' when bal >= 3 then 'high' else 'none' end as band, count(*) as n from ({NULLED_SQL}) group by 1"),
    "date_parts": Query(("orders",), {"steps": [*[{"operator": "Date_Extract", "input_column": "o_orderdate", "part": p, "output_column": p} for p in ("year", "month", "day", "quarter", "quarter_start", "month_start", "year_num", "month_num", "day_num")]], "projection": ["o_orderkey", "year", "month", "day", "quarter", "quarter_start", "month_start", "year_num", "month_num", "day_num"]}, "select o_orderkey, strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%Y-%m') as month, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) as quarter, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') as quarter_start, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start, year(o_orderdate) as year_num, month(o_orderdate) as month_num, day(o_orderdate) as day_num from orders"),
    "date_fiscal": Query(("orders",), {"steps": [{"operator": "Date_Extract", "input_column": "o_orderdate", "part": "fiscal_year", "fiscal_start_month": 4, "output_column": "fy"}, {"operator": "Date_Extract", "input_column": "o_orderdate", "part": "fiscal_quarter", "fiscal_start_month": 4, "output_column": "fq"}, group(["fy", "fq"], agg("count", "*", "n"))]}, "select year(o_orderdate) - case when month(o_orderdate) < 4 then 1 else 0 end as fy, (month(o_orderdate) + 8) % 12 // 3 + 1 as fq, count(*) as n from orders group by 1, 2"),
    "date_diff_boundary": Query(("orders", "lineitem"), {"merge_steps": [join(["orders", "lineitem"], "o_orderkey", "l_orderkey")], "final_steps": [*[math(u, f"date_diff('{u}', o_orderdate, l_shipdate)") for u in ("day", "month", "quarter", "year", "hour")], math("days", "l_shipdate - o_orderdate")], "projection": ["l_orderkey", "l_linenumber", "day", "month", "quarter", "year", "hour", "days"]}, "select l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) as day, date_diff('month', o_orderdate, l_shipdate) as month, date_diff('quarter', o_orderdate, l_shipdate) as quarter, date_diff('year', o_orderdate, l_shipdate) as year, date_diff('hour', o_orderdate, l_shipdate) as hour, (epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0 as days from orders join lineitem on o_orderkey = l_orderkey"),
    "date_functions": Query(("orders",), {"steps": [math("a", "date_add('month', 1, o_orderdate)"), math("b", "date_trunc('quarter', o_orderdate)"), math("c", "year(o_orderdate) * 100 + month(o_orderdate)"), math("d", "datetime('2024-02-29') > o_orderdate"), math("e", "quarter(dateadd('day', -10, o_orderdate))")], "projection": ["o_orderkey", "a", "b", "c", "d", "e"]}, "select o_orderkey, o_orderdate + interval 1 month as a, cast(date_trunc('quarter', o_orderdate) as timestamp) as b, year(o_orderdate) * 100 + month(o_orderdate) as c, timestamp '2024-02-29' > o_orderdate as d, quarter(o_orderdate - interval 10 day) as e from orders"),
}
