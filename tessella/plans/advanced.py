"""Queries over joins by order and inequality, tolerant comparison, sketches and percentiles by selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ordered_joins, tolerant
from tessella.operators.relation import Relation

from .execute import run
from .extras import read, registry
from .library import agg, group, math

QUERIES, SQL, query = registry()


# -- joins ------------------------------------------------------------------------------------------------------------


@query("""select n_nationkey, count(*) as parts, cast(sum(p_size) as bigint) as sizes, min(p_partkey) as first
from part join nation on p_retailprice < 900 + 40 * n_nationkey and p_size >= 2 * n_nationkey group by 1""")
def join_two_inequalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under a price and over a size that both depend on the nation."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", (900 + 40 * F.col("n_nationkey")).alias("price"), (2 * F.col("n_nationkey")).alias("size"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    found = ordered_joins.theta(Relation(part), Relation(nation), [("p_retailprice", "<", "price"), ("p_size", ">=", "size")]).df
    return found.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").cast("long").alias("sizes"), F.min("p_partkey").alias("first"))


@query("""with b as (select n_nationkey, case when n_nationkey % 5 = 0 then -1e9 else n_nationkey * 1000 end as low, case when n_nationkey % 5 = 0 then 1e9 else n_nationkey * 1000 + 3000 end as high from nation)
select n_nationkey, count(*) as n, round(max(o_totalprice), 2) as most from orders join b on o_totalprice between low and high group by 1""")
def join_wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in price bands, of which every fifth spans all prices."""
    k, wide = F.col("n_nationkey"), F.col("n_nationkey") % 5 == 0
    bands = read(spark, sf_dir, "nation").select("n_nationkey", F.when(wide, -1e9).otherwise(k * 1000).alias("low"), F.when(wide, 1e9).otherwise(k * 1000 + 3000).alias("high"))
    orders = read(spark, sf_dir, "orders").select("o_totalprice")
    found = ordered_joins.theta(Relation(orders), Relation(bands), [("o_totalprice", ">=", "low"), ("o_totalprice", "<=", "high")]).df
    return found.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("most"))


_EVENTS = """with u as (select event_id, event_type, ts, case when user_id % 10 < 9 then 0 else user_id end as k from events),
e as (select k, ts, max(event_id) as event_id from u where event_type = 'purchase' group by 1, 2), v as (select k, ts, max(event_id) as view_id from u where event_type = 'view' group by 1, 2)"""


def _purchases_and_views(spark: SparkSession, sf_dir: str) -> tuple[Relation, Relation]:
    """Purchases and views of users, nine tenths of whom share one key."""
    events = read(spark, sf_dir, "events").withColumn("k", F.when(F.col("user_id") % 10 < 9, 0).otherwise(F.col("user_id")))
    of = lambda kind, name: Relation(events.where(F.col("event_type") == kind).groupBy("k", "ts").agg(F.max("event_id").alias(name)))
    return of("purchase", "event_id"), of("view", "view_id")


@query(f"""{_EVENTS} select e.event_id, case when epoch_us(v.ts) - epoch_us(e.ts) <= 60000000 then v.view_id end as view_id from e asof left join v on e.k = v.k and e.ts <= v.ts""")
def join_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view within a minute after each purchase."""
    purchases, views = _purchases_and_views(spark, sf_dir)
    return ordered_joins.as_of(purchases, views, ["k"], ["k"], "ts", "ts", direction="forward", tolerance=60).df.select("event_id", "view_id")


@query(f"""{_EVENTS}, b as (select e.event_id, e.ts, v.view_id, v.ts as at from e asof left join v on e.k = v.k and e.ts >= v.ts), f as (select e.event_id, v.view_id, v.ts as at from e asof left join v on e.k = v.k and e.ts <= v.ts)
select event_id, case when b.at is null or epoch_us(f.at) - epoch_us(b.ts) < epoch_us(b.ts) - epoch_us(b.at) then f.view_id else b.view_id end as view_id from b join f using (event_id)""")
def join_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest view before or after each purchase."""
    purchases, views = _purchases_and_views(spark, sf_dir)
    return ordered_joins.as_of(purchases, views, ["k"], ["k"], "ts", "ts", direction="nearest").df.select("event_id", "view_id")


# -- comparison -------------------------------------------------------------------------------------------------------


@query("""select count(*) filter (where o_orderkey % 7 <> 0) as matched, count(*) filter (where o_orderkey % 7 = 0) as missing, count(*) filter (where o_orderkey % 7 = 0) as extra from orders""")
def compare_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with one or two decimals against the prices themselves, a seventh of which are off by one."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    odd = F.col("o_orderkey") % 2 == 1
    expected = orders.select("o_orderkey", F.when(odd, F.col("price").cast("decimal(18,1)").cast("string")).otherwise(F.col("price").cast("string")).alias("price"))
    actual = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return tolerant.counts(expected, actual)


@query("""with n as (select o_custkey, cast(o_totalprice as decimal(18,2)) as p from orders) select cast(o_custkey as varchar) as o_custkey, 'missing' as status, count(*) as n from n where o_custkey % 11 = 0 group by 1""")
def compare_tolerant_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' orders the other side lacks, when several prices of a customer may be written alike."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), (F.col("o_orderkey") % 2 == 1).alias("odd"))
    expected = orders.select("o_custkey", F.when(F.col("odd"), F.col("price").cast("decimal(18,1)").cast("string")).otherwise(F.col("price").cast("string")).alias("price"))
    actual = orders.where("o_custkey % 11 <> 0").select("o_custkey", "price")
    return tolerant.differences(expected, actual).groupBy("o_custkey", "status").agg(F.sum("n").alias("n"))


# -- aggregates -------------------------------------------------------------------------------------------------------

_SKETCHES = (("distinct", "o_custkey"), ("quantiles", "o_totalprice"), ("frequent", "o_orderpriority"))


@query("""select cast(extract(year from o_orderdate) as bigint) as year, count(*) as n, true as distinct_fits, true as median_fits, count(distinct o_orderpriority) as priorities from orders group by 1""")
def sketches_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each month merged by year: the distinct customers within 3 % and the median's rank within 1 % of the exact ones."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").alias("month"))
    months = run({"steps": [group(["year", "month"], *[agg(f"sketch_{k}", c, k) for k, c in _SKETCHES], inputs=["orders"])]}, {"orders": orders})
    read_off = [math("customers", "distinct_estimate(distinct)"), math("median", "quantile_estimate(quantiles, 0.5)"), math("top", "frequent_items(frequent, 10)")]
    years = run({"steps": [group(["year"], *[agg(f"merge_{k}", k, k) for k, _ in _SKETCHES], inputs=["months"]), *read_off], "projection": ["year", "customers", "median", "top"]}, {"months": months})
    exact = orders.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("exact"))
    below = orders.join(F.broadcast(years.select("year", "median")), "year").groupBy("year").agg(F.avg((F.col("o_totalprice") <= F.col("median")).cast("double")).alias("share"))  # a row a year
    found = years.join(exact, "year").join(below, "year")
    return found.select("year", "n", (F.abs(F.col("customers") / F.col("exact") - 1) < 0.03).alias("distinct_fits"), (F.abs(F.col("share") - 0.5) < 0.01).alias("median_fits"), F.json_array_length("top").cast("long").alias("priorities"))


@query("""select l_returnflag, round(median(l_extendedprice), 4) as median, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, count(*) as n, round(d.q, 4) as quantities
from lineitem join (select l_returnflag as f, quantile_cont(l_quantity, 0.3) as q from (select distinct l_returnflag, l_quantity from lineitem) group by 1) d on f = l_returnflag group by l_returnflag, d.q""")
def agg_percentile_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of three large groups, by selection, next to a plain measure."""
    by = {"method": "selection"}
    measures = [agg("median", "l_extendedprice", "median", **by), agg("p90", "l_extendedprice", "p90", **by), agg("count", None, "n"), agg("p30", "l_quantity", "quantities", distinct=True, **by)]
    return run({"steps": [group(["l_returnflag"], *measures, inputs=["lineitem"])], "rounding": {"median": 4, "p90": 4, "quantities": 4}}, {"lineitem": read(spark, sf_dir, "lineitem")})


# -- frames -----------------------------------------------------------------------------------------------------------


def _range(output: str, operation: str, source: str, order: str, before: float, after: float, **more) -> dict:
    return {"operator": "Range_Window", "operation": operation, "input_column": source, "order_column": order, "before": before, "after": after, "output_column": output, **more}


@query("""select o_orderkey, cast(sum(o_orderkey % 5) over w as bigint) as week, count(*) over (partition by o_custkey order by o_orderdate range between interval 30 days preceding and interval 0 days following exclude current row) as earlier, max(o_totalprice) over w as most
from orders window w as (partition by o_custkey order by o_orderdate range between interval 30 days preceding and interval 7 days following)""")
def frame_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders within days of each order."""
    by = {"window_partition_by": ["o_custkey"]}
    steps = [math("one", "o_orderkey % 5", inputs=["orders"]), _range("week", "sum", "one", "o_orderdate", 30, 7, **by), _range("earlier", "count", "one", "o_orderdate", 30, 0, exclude="current", **by), _range("most", "max", "o_totalprice", "o_orderdate", 30, 7, **by)]
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return run({"steps": steps, "projection": ["o_orderkey", "week", "earlier", "most"]}, {"orders": orders})


@query("""select c_custkey, count(*) over w as near, cast(sum(c_nationkey) over (order by c_acctbal range between 5 preceding and 5 following exclude group) as bigint) as others, min(c_custkey) over w as first
from customer window w as (order by c_acctbal range between 5 preceding and 5 following)""")
def frame_over_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balances are within 5 of one's own."""
    steps = [_range("near", "count", "c_custkey", "c_acctbal", 5, 5, inputs=["customer"]), _range("others", "sum", "c_nationkey", "c_acctbal", 5, 5, exclude="group"), _range("first", "min", "c_custkey", "c_acctbal", 5, 5)]
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return run({"steps": steps, "projection": ["c_custkey", "near", "others", "first"]}, {"customer": customer})
