"""Queries over sources, profiles, comparisons, graphs and streams, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import aggregates, compare, joins
from tessella.operators.relation import Relation, SortKey
from tessella.sources import catalog, graph, retrieval, sinks
from tessella.streaming import events as streams

Function = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Function], dict[str, str], Callable]:
    """Queries by name, their SQL, and the decorator that registers both."""
    queries: dict[str, Function] = {}
    statements: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f: Function):
            queries[f.__name__] = f
            if sql:
                statements[f.__name__] = sql
            return f

        return register

    return queries, statements, query


QUERIES, SQL, query = registry()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalog.Catalog.folder(spark, sf_dir, [name]).read(name)


# -- sources ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name from customer where (c_mktsegment = 'BUILDING' or c_acctbal between 0 and 100) and c_nationkey not in (1, 2)")
def retrieve_raw(spark, sf_dir):
    contract = {"class": "customer", "fields": ["c_custkey", "c_name"], "filters": [{"logic": "or", "conditions": [{"field": "c_mktsegment", "operator": "eq", "value": "BUILDING"}, {"field": "c_acctbal", "operator": "BETWEEN", "value": "0 AND 100"}]}, {"field": "c_nationkey", "operator": "not in", "value": [1, 2]}]}
    return retrieval.retrieve(contract, read(spark, sf_dir, "customer"))


@query("select c_custkey from customer where lower(c_mktsegment) = 'machinery'")
def retrieve_ignore_case(spark, sf_dir):
    contract = {"fields": ["c_custkey"], "filters": [{"field": "c_mktsegment", "operator": "=", "value": "machinery"}, {"field": "c_name", "operator": "!=", "value": None}]}
    return retrieval.retrieve(contract, read(spark, sf_dir, "customer"), ignore_case=True)


@query("""with x as (select unnest([{f: 'c_mktsegment', v: c_mktsegment}, {f: 'c_nationkey', v: cast(c_nationkey as varchar)}, {f: 'k', v: cast(nullif(c_nationkey, 3) as varchar)}]) as s from customer),
c as (select s.f as field, s.v as v, count(*) as n from x group by 1, 2)
select field, cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (where v is null), 0) as bigint) as nulls, count(v) as distinct, max(n) filter (where v is not null) as most from c group by 1""")
def profile_columns(spark, sf_dir):
    return catalog.profile(read(spark, sf_dir, "customer").selectExpr("c_mktsegment", "c_nationkey", "nullif(c_nationkey, 3) as k"))


@query("with n as (select n_regionkey as k, count(*) as a from nation group by 1), r as (select s_nationkey as k, count(*) as b from supplier group by 1) select count(n.k) as left_keys, count(r.k) as right_keys, max(a) as left_max, max(b) as right_max, count(*) filter (where n.k is not null and r.k is not null) as matched, count(*) filter (where r.k is null) as left_only, count(*) filter (where n.k is null) as right_only, count(*) filter (where a > 1 and b > 1) as many_to_many from n full join r on n.k = r.k")
def join_diagnostics(spark, sf_dir):
    return joins.diagnostics(Relation(read(spark, sf_dir, "nation")), Relation(read(spark, sf_dir, "supplier")), ["n_regionkey"], ["s_nationkey"])


@query("""with ids as (select 'INV' || lpad(cast(c_custkey as varchar), cast(greatest(3, length(cast(c_custkey as varchar))) as int), '0') as id, cast(c_custkey as varchar) as d from customer),
p as (select id, d, unnest(['INV', 'inv']) as p from ids where length(d) <= 4), w as (select id, d, p, unnest(range(1, greatest(3, length(d)) + 1)) as w from p),
n as (select id, p, case when length(d) >= w then d else lpad(d, cast(w as int), '0') end as n from w)
select distinct unnest([p || n, p || '-' || n]) as alias, id from n
union select unnest([id, lower(id)]) as alias, id from ids where length(d) > 4""")
def id_aliases(spark, sf_dir):
    ids = read(spark, sf_dir, "customer").select(F.format_string("INV%03d", "c_custkey").alias("id"))
    return sinks.alias_map(ids)


# -- graph ------------------------------------------------------------------------------------------------------------

_BASE = "http://example.org/"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations as (s, p, o, datatype): names for some, a link to the nation for all."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    fact = lambda p, o, t=None: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(t).cast("string").alias("datatype"))
    customers = c.select(F.concat(F.lit(_BASE + "c"), "c_custkey").alias("s"), F.explode(F.array(fact(graph.TYPE, F.lit(_BASE + "Customer")), fact(_BASE + "balance", F.col("c_acctbal"), graph.XSD + "double"), fact(_BASE + "nation", F.concat(F.lit(_BASE + "n"), "c_nationkey")), fact(_BASE + "name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))))).alias("f"))
    nations = n.select(F.concat(F.lit(_BASE + "n"), "n_nationkey").alias("s"), F.explode(F.array(fact(graph.TYPE, F.lit(_BASE + "Nation")), fact(_BASE + "label", F.col("n_name")))).alias("f"))
    return customers.unionByName(nations).select("s", "f.*").where("o is not null")


_CLASSES = {"Customer": {"iri": _BASE + "Customer", "properties": {"balance": {"iri": _BASE + "balance", "datatype": graph.XSD + "double", "single": True}, "name": {"iri": _BASE + "name", "same_as": [_BASE + "title"], "single": True}, "nation": {"iri": _BASE + "nation"}}}}


@query("select 'http://example.org/c' || c_custkey as subject_iri, c_acctbal as balance, case when c_custkey % 3 = 0 then c_name end as name from customer where c_acctbal > 1000 and (c_custkey % 3 <> 0 or c_name <> 'x')")
def graph_class_table(spark, sf_dir):
    contract = {"class": "Customer", "fields": ["subject_iri", "balance", "name"], "optional_fields": ["name"], "filters": [{"field": "balance", "operator": ">", "value": 1000}, {"any": [{"field": "name", "operator": "is_null"}, {"field": "name", "operator": "!=", "value": "x"}]}]}
    return graph.retrieve_class(triples(spark, sf_dir), contract, _CLASSES)


@query("select 'http://example.org/c' || c_custkey as start, n_name as label from customer join nation on c_nationkey = n_nationkey")
def graph_links(spark, sf_dir):
    return graph.links(triples(spark, sf_dir), [_BASE + "nation", _BASE + "label"]).select("start", F.col("end").alias("label"))


@query("""with f as (select 'Customer' as c, 'balance' as p, cast(c_acctbal as varchar) as o, c_custkey as s from customer union all select 'Customer', 'nation', cast(c_nationkey as varchar), c_custkey from customer union all select 'Customer', 'name', c_name, c_custkey from customer where c_custkey % 3 = 0 union all select 'Nation', 'label', n_name, n_nationkey from nation),
m as (select 'Customer' as c, count(*) as members from customer union all select 'Nation', count(*) from nation),
v as (select c, p, o, count(*) as n from f group by 1, 2, 3)
select v.c as class, v.p as property, cast(sum(n) as bigint) as "values", count(*) as "distinct", max(n) as most_subjects, round(cast(sum(n) as double) / any_value(members), 6) as coverage from v join m on m.c = v.c group by 1, 2""")
def graph_property_profile(spark, sf_dir):
    short = lambda c: F.regexp_replace(c, _BASE, "")
    p = graph.property_profile(triples(spark, sf_dir))
    return p.select(short("class").alias("class"), short("p").alias("property"), "values", "distinct", "most_subjects", F.round("coverage", 6).alias("coverage"))


@query("select n_regionkey as graph, count(*) - 1 as hops from nation group by 1 having count(*) > 1")
def graph_hops(spark, sf_dir):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    chain = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("a"), F.lead("n_nationkey").over(w).alias("b"))
    return graph.hops(chain.where("b is not null"))


# -- comparison -------------------------------------------------------------------------------------------------------


@query("select count(*) filter (where p_size % 7 <> 0) as matched, count(*) filter (where p_size % 7 = 0) as missing, count(*) filter (where p_size % 7 = 0) as extra from part")
def compare_counts(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    changed = part.withColumn("p_size", F.when(F.col("p_size") % 7 == 0, -F.col("p_size")).otherwise(F.col("p_size")))
    return compare.counts(part, changed)


@query("select p_partkey, case when p_partkey % 11 = 0 then 'missing' else 'wrong' end as status, case when p_partkey % 11 = 0 then null else 'p_size' end as wrong from part where p_partkey % 11 = 0 or p_size % 7 = 0")
def compare_keyed(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    changed = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_size") % 7 == 0, -F.col("p_size")).otherwise(F.col("p_size")))
    return compare.keyed(part, changed, ["p_partkey"])


@query("select o_orderstatus as before, case when o_totalprice > 100000 then 'F' else o_orderstatus end as after, count(*) as n from orders group by 1, 2")
def label_transitions(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    after = orders.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 100000, "F").otherwise(F.col("o_orderstatus")))
    return compare.transitions(orders, after, "o_orderkey", "o_orderstatus")


@query("""select coalesce(o_orderpriority, 'all') as o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as "right", round(count(*) filter (where o_orderstatus = 'F') / count(*), 6) as share, round(avg(o_totalprice), 2) as mean_s, round(median(o_totalprice), 4) as median_s from orders group by rollup (o_orderpriority)""")
def run_metrics(spark, sf_dir):
    m = compare.run_metrics(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", right="F")
    return m.select("o_orderpriority", "n", "right", F.round("share", 6).alias("share"), F.round("mean_s", 2).alias("mean_s"), F.round("median_s", 4).alias("median_s"))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rn from orders) where rn >= 3 and (rn - 3) % 5 = 0")
def systematic_sample(spark, sf_dir):
    return compare.systematic(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 5, 3, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query()
def text_similarity(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return compare.similar(b, b, "item_id", "text", 2).select("l_id", "r_id", F.round("score", 6).alias("score"), "rank")


# -- recipes that the plan language can't say -------------------------------------------------------------------------


@query("with m as (select user_id, date_trunc('day', ts) as d, sum(value) as v from events group by 1, 2) select user_id, cast(d as timestamp) as d, round(v / nullif(max(v) over (partition by user_id order by d), 0) - 1, 6) as drawdown, coalesce(v > max(v) over (partition by user_id order by d rows between unbounded preceding and 1 preceding), false) as new_high from m")
def drawdown_new_high(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "value")
    day = aggregates.aggregate(Relation(events, (SortKey("event_id"),)), ["user_id", "d"], [aggregates.Measure("sum", "v", "value", method="in_order")]).df
    w = Window.partitionBy("user_id").orderBy("d")
    peak, before = F.max("v").over(w), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return day.select("user_id", "d", (F.round((F.col("v") / F.nullif(peak, F.lit(0.0)) - 1) * 1e6) / 1e6).alias("drawdown"), F.coalesce(F.col("v") > before, F.lit(False)).alias("new_high"))


@query("select regexp_replace(p_type, ' [A-Z]+$', '') as kind, count(*) as n from part group by 1")
def suffix_stripped_groups(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.regexp_replace("p_type", " [A-Z]+$", "").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, grouping(o_orderpriority) as g, count(*) as n, round(sum(o_totalprice), 0) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, sf_dir):
    r = read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority")
    return r.agg(F.grouping("o_orderpriority").cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


@query("select c_custkey, rank() over w as r, dense_rank() over w as d, ntile(4) over w as q from customer window w as (partition by c_nationkey order by c_acctbal desc, c_custkey)")
def rank_family(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(w).cast("long").alias("q"))


# -- streams ----------------------------------------------------------------------------------------------------------


@query("select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with m as (select *, case when ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null then 1 else 0 end as f from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(f) over (partition by user_id order by ts, event_id) as s from m) select user_id, min(ts) as start, count(*) as n from s group by user_id, s""")
def session_windows(spark, sf_dir):
    return streams.sessions_by_gap(read(spark, sf_dir, "events"))
