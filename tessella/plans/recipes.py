"""More named plans and source queries, each with its SQL: recipes of the domain and rows of the plan language's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import compare, joins, ordered_joins
from tessella.operators.relation import Relation
from tessella.sources import catalog, graph, retrieval

from .compiler import compile_plan
from .extras import _BASE, _CLASSES, query, read, triples
from .library import C, NULLED, NULLED_SQL, Query, agg, cond, group, join, math, sort, where
from .question import with_connection_keys

TABLES = "region nation customer supplier part orders lineitem events".split()
COUNT = agg("count_rows", None, "n")

PLANS: dict[str, Query] = {
    # two keys, each group once: every order meets its customer's count of orders of its status
    "join_composite_keys": Query(
        ("orders",),
        {
            "merge_steps": [
                group(["o_custkey", "o_orderstatus"], COUNT, inputs=["orders"], id="counts"),
                join(["orders", "counts"], ["o_custkey", "o_orderstatus"], ["o_custkey", "o_orderstatus"], validate="m:1"),
            ],
            "projection": ["o_orderkey", "n"],
        },
        "select o_orderkey, n from orders join (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2) using (o_custkey, o_orderstatus)",
    ),
    "join_row_cap": Query(
        (C, "nation"),
        {"steps": [join([C, "nation"], "c_nationkey", "n_nationkey", max_output_rows=10**9)], "projection": ["c_custkey", "n_name"]},
        "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey",
    ),
    "sort_numeric_text": Query(
        (C,),
        {
            "steps": [math("t", "concat(c_custkey, '')"), sort([{"column": "t", "as": "number", "direction": "DESC"}], limit=15)],
            "projection": ["t"],
        },
        "select cast(c_custkey as varchar) as t from customer order by c_custkey desc limit 15",
    ),
    "filter_numeric_text_column": Query(
        (C,),
        {"steps": [math("t", "concat(c_custkey, '')"), where(cond("t", ">", 20), cond("t", "<=", 100))], "projection": ["c_custkey", "t"]},
        "select c_custkey, cast(c_custkey as varchar) as t from customer where c_custkey > 20 and c_custkey <= 100",
    ),
    "limit_without_sort": Query(("region",), {"steps": [{"operator": "Order_By", "limit": 1000}], "projection": ["r_name"]}, "select r_name from region"),
    "sort_offset": Query(
        ("orders",),
        {"steps": [sort("o_totalprice DESC, o_orderkey", limit=25, offset=10)], "projection": ["o_orderkey"]},
        "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 25 offset 10",
    ),
    "fiscal_year_by_end": Query(
        ("orders",),
        {
            "final_steps": [
                {"operator": "Date_Extract", "input_column": "o_orderdate", "part": "fiscal_year", "fiscal_start_month": 4, "output_column": "began"},
                math("fiscal_year", "began + 1"),
            ],
            "projection": ["o_orderkey", "fiscal_year"],
        },
        "select o_orderkey, year(o_orderdate) + case when month(o_orderdate) >= 4 then 1 else 0 end as fiscal_year from orders",
    ),
    "client_percentiles": Query(
        ("orders",),
        {
            "pre_steps": [group(["o_custkey"], agg("sum", "o_totalprice", "total"))],
            "final_measures": [agg("percentile_cont", "total", "p25", quantile=0.25), agg("median", "total", "p50"), agg("p90", "total", "p90")],
            "rounding": 2,
        },
        "select round(quantile_cont(total, 0.25), 2) as p25, round(median(total), 2) as p50, round(quantile_cont(total, 0.9), 2) as p90 from (select sum(o_totalprice) as total from orders group by o_custkey)",
    ),
    "lowest_without_nulls": Query(
        (C,),
        {"steps": [*NULLED, where(cond("bal", "is_not_null")), sort("bal, c_custkey", limit=12)], "projection": ["c_custkey", "bal"]},
        f"select c_custkey, bal from ({NULLED_SQL}) where bal is not null order by bal, c_custkey limit 12",
    ),
    # a name joined without its suffix, as a benchmark is to its total-return variant
    "join_without_suffix": Query(
        (C,),
        {
            "merge_steps": [
                math("index_name", "concat(c_mktsegment, ' TRI')", inputs=[C], id="variants"),
                math("plain_name", "regexp_replace(index_name, ' TRI$', '')", inputs=["variants"], id="named"),
                group(["c_mktsegment"], COUNT, inputs=[C], id="sizes"),
                join(["named", "sizes"], "plain_name", "c_mktsegment", validate="m:1"),
            ],
            "projection": ["c_custkey", "plain_name", "n"],
        },
        "select c_custkey, c_mktsegment as plain_name, n from customer join (select c_mktsegment, count(*) as n from customer group by 1) using (c_mktsegment)",
    ),
    # each client's exemption applies once, to the client's own total
    "client_exemption": Query(
        ("orders",),
        {
            "pre_steps": [group(["o_custkey"], agg("sum", "o_totalprice", "gain"))],
            "final_steps": [math("taxable", "round(greatest(gain - 1000000, 0), 2)")],
            "projection": ["o_custkey", "taxable"],
        },
        "select o_custkey, round_even(greatest(sum(o_totalprice) - 1000000, 0), 2) as taxable from orders group by 1",
    ),
    "drawdown_plan": Query(
        ("events",),
        {
            "pre_steps": [sort("event_id"), math("d", "date_trunc('day', ts)"), group(["user_id", "d"], agg("sum", "value", "v", method="in_order"))],
            "final_steps": [
                sort("d"),
                math("peak", "cummax(v)", window_partition_by=["user_id"]),
                math("before", "lag(peak)", window_partition_by=["user_id"]),
                math("drawdown", "round(v / peak - 1, 6)"),
                math("new_high", "CASE WHEN is_null(before) THEN false ELSE v > before END"),
            ],
            "projection": ["user_id", "d", "drawdown", "new_high"],
        },
        "with m as (select user_id, date_trunc('day', ts) as d, sum(value) as v from events group by 1, 2) select user_id, cast(d as timestamp) as d, round_even(v / nullif(max(v) over w, 0) - 1, 6) as drawdown, coalesce(v > max(v) over (partition by user_id order by d rows between unbounded preceding and 1 preceding), false) as new_high from m window w as (partition by user_id order by d)",
    ),
    "rollup_plan": Query(
        ("orders",),
        {"steps": [group(["o_orderstatus", "o_orderpriority"], COUNT, agg("max", "o_totalprice", "most"), grouping="rollup", grouping_column="g")]},
        "select o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) as g, count(*) as n, max(o_totalprice) as most from orders group by rollup (o_orderstatus, o_orderpriority)",
    ),
    "cube_plan": Query(
        ("orders",),
        {"steps": [group(["o_orderstatus", "o_orderpriority"], COUNT, grouping="cube", grouping_column="g")]},
        "select o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) as g, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    ),
    "grouping_sets_plan": Query(
        ("orders",),
        {"steps": [group(["o_orderstatus", "o_orderpriority"], COUNT, grouping=[["o_orderpriority"], []])]},
        "select cast(null as varchar) as o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderpriority), ())",
    ),
    "rank_plan": Query(
        (C,),
        {
            "steps": [
                math("b", "round(c_acctbal / 1000, 0)"),
                sort("b DESC"),
                *[math(o, e, window_partition_by=["c_nationkey"]) for o, e in (("r", "rank()"), ("d", "dense_rank()"))],
                math("p", "round(percent_rank(), 9)", window_partition_by=["c_nationkey"]),
            ],
            "projection": ["c_custkey", "r", "d", "p"],
        },
        "select c_custkey, rank() over w as r, dense_rank() over w as d, round_even(percent_rank() over w, 9) as p from (select *, round_even(c_acctbal / 1000, 0) as b from customer) window w as (partition by c_nationkey order by b desc)",
    ),
    # windows over all rows, which no task may hold
    "win_all_rows": Query(
        ("orders",),
        {
            "steps": [
                sort("o_orderdate, o_orderkey"),
                math("k", "floor(o_totalprice)"),
                math("rn", "row_number()"),
                math("total", "cumsum(k)"),
                math("peak", "cummax(k)"),
                math("before", "lag(k, 2, -1)"),
                math("after", "lead(k)"),
                math("mean", "round(rolling_mean(k, 5, 2), 6)"),
                math("tile", "ntile(7)"),
                math("first", "first_value(k)"),
            ],
            "projection": ["o_orderkey", "rn", "total", "peak", "before", "after", "mean", "tile", "first"],
        },
        "select o_orderkey, row_number() over w as rn, cast(sum(k) over w as bigint) as total, max(k) over w as peak, lag(k, 2, -1) over w as before, lead(k) over w as after, round_even(case when count(k) over f >= 2 then avg(k) over f end, 6) as mean, ntile(7) over w as tile, first_value(k) over w as first from (select *, cast(floor(o_totalprice) as bigint) as k from orders) window w as (order by o_orderdate, o_orderkey), f as (order by o_orderdate, o_orderkey rows between 4 preceding and current row)",
    ),
    "rank_all_rows": Query(
        (C,),
        {
            "steps": [math("b", "round(c_acctbal / 500, 0)"), sort("b DESC"), math("r", "rank()"), math("d", "dense_rank()"), math("p", "round(percent_rank(), 9)")],
            "projection": ["c_custkey", "r", "d", "p"],
        },
        "select c_custkey, rank() over w as r, dense_rank() over w as d, round_even(percent_rank() over w, 9) as p from (select *, round_even(c_acctbal / 500, 0) as b from customer) window w as (order by b desc)",
    ),
    "division_by_zero": Query(
        ("lineitem",),
        {"steps": [math("q", "round(l_tax / l_discount, 6)"), math("m", "l_linenumber % (l_linenumber - l_linenumber)"), where(cond("l_quantity", ">", 45))], "projection": ["l_orderkey", "l_linenumber", "q", "m"]},
        "select l_orderkey, l_linenumber, round_even(l_tax / nullif(l_discount, 0), 6) as q, cast(null as bigint) as m from lineitem where l_quantity > 45",
    ),
    "math_patterns": Query(
        (C,),
        {
            "steps": [
                math("digits", "regexp_extract(c_name, '[0-9]+')"),
                math("stem", "regexp_replace(c_name, '[0-9]', '')"),
                math("part", "split_part(c_mktsegment, 'I', 2)"),
                math("has", "regexp_like(c_mktsegment, '^B.*G$')"),
                math("low", "least(c_acctbal, 0)"),
                math("same", "is_null(part) = false and c_custkey <> 3"),
            ],
            "projection": ["c_custkey", "digits", "stem", "part", "has", "low", "same"],
        },
        "select c_custkey, nullif(regexp_extract(c_name, '[0-9]+'), '') as digits, regexp_replace(c_name, '[0-9]', '', 'g') as stem, string_split(c_mktsegment, 'I')[2] as part, regexp_matches(c_mktsegment, '^B.*G$') as has, least(c_acctbal, 0) as low, string_split(c_mktsegment, 'I')[2] is not null and c_custkey <> 3 as same from customer",
    ),
    "json_values": Query(
        ("events",),
        {"steps": [math("keyed", "json_value(props, '$.k')")], "projection": ["event_id", "keyed"]},
        "select event_id, props ->> '$.k' as keyed from events",
    ),
}


# -- sources ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name from customer where c_acctbal > 0")
def retrieve_empty_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = {"fields": ["c_custkey", "c_name"], "filters": [{"field": "c_custkey", "operator": "not_in", "value": []}, {"field": "c_acctbal", "operator": ">", "value": 0}]}
    return retrieval.retrieve(contract, read(spark, sf_dir, C))


@query(f"select table_name, column_name, cast(row_number() over (partition by table_name order by column_index) as bigint) as place from duckdb_columns() where table_name in ({', '.join(repr(t) for t in TABLES)}) and schema_name = 'main' and database_name = current_database()")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns, found by listing the folder."""
    found = catalog.discover(spark, sf_dir)
    rows = [(t.name, f, k) for t in found if t.name in TABLES for k, f in enumerate(t.schema.fieldNames(), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place long")


@query(" union all ".join(f"select '{t}' as table_name, '{k}' as key, count(*) as rows, count(*) = count(distinct {k if ',' not in k else '(' + k + ')'}) as is_unique from {t}" for t, k in (("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey,l_linenumber"), ("orders", "o_custkey"))))
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether columns that might be keys name each row once."""
    asked = (("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey,l_linenumber"), ("orders", "o_custkey"))
    checks = [catalog.is_key(read(spark, sf_dir, t), k.split(",")).select(F.lit(t).alias("table_name"), F.lit(k).alias("key"), "rows", "is_unique") for t, k in asked]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query(" union all ".join(f"select '{t}' as source, true as healthy, count(*) as instances from {t}" for t in TABLES[:6]) + " union all select 'no_such_table', false, null")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = catalog.Catalog.folder(spark, sf_dir, [*TABLES[:6], "no_such_table"])
    return known.health()


@query("select c_name, o_totalprice from customer join orders on c_custkey = o_custkey where o_totalprice > 200000")
def connection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that were pruned to the fields asked for get the keys of the declared join."""
    known = catalog.Catalog.folder(spark, sf_dir, [C, "orders"])
    asked = {"who": {"class": C, "fields": ["c_name"]}, "what": {"class": "orders", "fields": ["o_totalprice"], "filters": [{"field": "o_totalprice", "operator": ">", "value": 200000}]}}
    full = with_connection_keys(asked, [{"left": "who", "left_on": "customer.c_custkey", "right": "what", "right_on": ["o_custkey"]}], known)
    rows = {b: Relation(retrieval.retrieve({k: v for k, v in c.items() if k != "optional_fields"}, known.read(c["class"]))) for b, c in full.items()}
    return joins.integrate(rows["who"], rows["what"], "inner", ["c_custkey"], ["o_custkey"]).df.select("c_name", "o_totalprice")


def ontology(spark: SparkSession) -> DataFrame:
    facts = [(_BASE + c, graph.TYPE, graph.CLASSES[0]) for c in ("Customer", "Nation", "Empty")] + [(_BASE + "name", graph.SAME, _BASE + "title")]
    return spark.createDataFrame([(*f, None) for f in facts], "s string, p string, o string, datatype string")


@query("""select * from (values ('Customer', 'balance', 'number', '', ''), ('Customer', 'name', 'text', '', 'title'), ('Customer', 'nation', 'reference', 'Nation', ''), ('Nation', 'label', 'text', '', '')) as v(class, field, datatype, targets, same)
join (select 'Customer' as class, count(*) as instances from customer union all select 'Nation', count(*) from nation) using (class)""")
def graph_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.describe(triples(spark, sf_dir), ontology(spark))
    return found.select("class", "field", "datatype", "targets", F.regexp_replace("same_as", _BASE, "").alias("same"), "instances")


@query("select 'http://example.org/c' || c_custkey as subject_iri, c_acctbal as balance, 'http://example.org/n' || c_nationkey as nation from customer where c_acctbal < 0")
def graph_described_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class read by what the ontology and the triples say of it."""
    facts = triples(spark, sf_dir)
    classes = graph.as_classes(graph.describe(facts, ontology(spark)))
    contract = {"class": "Customer", "fields": ["subject_iri", "balance", "nation"], "filters": [{"field": "balance", "operator": "<", "value": 0}]}
    return graph.retrieve_class(facts, contract, classes)


@query("select * from (values ('no_key', 1), ('mixed_grain', 1), ('null_compared', 1), ('two_unknown_fields', 2)) as v(plan, breaches)")
def plan_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many breaches of contract the compiler finds in plans that break it, before anything is read."""
    bad = {
        "no_key": {"steps": [{"operator": "Integrate", "inputs": ["a", "b"]}]},
        "mixed_grain": {"final_measures": [agg("sum", "v", "s", inputs=["a"], group_by=["k"]), agg("sum", "v", "t", inputs=["a"])]},
        "null_compared": {"steps": [where(cond("v", "=", None), inputs=["a"])]},
        "two_unknown_fields": {"steps": [where(cond("x", "=", 1), inputs=["a"]), sort("y")]},
    }
    rows = [(name, len(compile_plan(plan, {"a": ["k", "v"], "b": ["k", "w"]}).errors)) for name, plan in bad.items()]
    return spark.createDataFrame(rows, "plan string, breaches int")


# -- joins by order and range, comparison by place --------------------------------------------------------------------


@query("""with e as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2), v as (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by 1, 2)
select e.event_id, v.view_id from e asof left join v on e.user_id = v.user_id and e.ts >= v.ts""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase of the same user."""
    events = read(spark, sf_dir, "events")
    of = lambda kind, name: events.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("event_id").alias(name))
    found = ordered_joins.as_of(Relation(of("purchase", "event_id")), Relation(of("view", "view_id")), ["user_id"], ["user_id"], "ts", "ts")
    return found.df.select("event_id", "view_id")


@query("select o_orderkey, n_nationkey from orders join nation on o_totalprice between n_nationkey * 20000 and n_nationkey * 20000 + 25000")
def join_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 20000).alias("low"), (F.col("n_nationkey") * 20000 + 25000).alias("high"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordered_joins.theta(Relation(orders), Relation(bands), [("o_totalprice", ">=", "low"), ("o_totalprice", "<=", "high")]).df.select("o_orderkey", "n_nationkey")


@query("""with a as (select o_orderkey as k, row_number() over (order by o_orderdate, o_orderkey) as place from orders), b as (select o_orderkey as k, row_number() over (order by o_orderdate, o_orderkey desc) as place from orders)
select place, 'wrong' as status, 'o_orderkey' as wrong from a join b using (place) where a.k <> b.k""")
def compare_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of the same rows, compared place by place."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    placed = lambda *by: compare.placed(orders, [F.col("o_orderdate"), *by], "place").select("place", "o_orderkey")
    return compare.ordered(placed(F.col("o_orderkey")), placed(F.col("o_orderkey").desc()), "place")
