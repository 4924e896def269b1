"""Sketches in the plan language: merged ones say what one pass says, within the stated errors."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions.values import PlanError
from tessella.plans.execute import run

BUILDS = [("distinct", "v"), ("quantiles", "x"), ("frequent", "item")]
READS = [("n", "distinct_estimate(distinct)"), ("median", "quantile_estimate(quantiles, 0.5)"), ("p99", "quantile_estimate(quantiles, 0.99)"), ("top", "frequent_items(frequent, 3)")]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 30).cast("int").alias("day"), (F.col("id") % 3).cast("int").alias("month"), (F.col("id") * 7919 % 20011).alias("v"),
        (F.col("id") * 7919 % 60_000).cast("double").alias("x"), F.when(F.col("id") % 5 == 0, "hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.concat(F.lit("i"), F.col("id") % 2000)).alias("item"),
    )
    return df.unionByName(spark.createDataFrame([(99, 99, None, None, None)], "day int, month int, v long, x double, item string"))


def measures(kind):
    return [{"operation": f"{kind}_{n}", "target_column": c if kind == "sketch" else n, "output_column": n} for n, c in BUILDS]


def plan(by_day):
    steps = [{"operator": "Filter_Aggregate", "inputs": ["t"], "group_by": ["day", "month"] if by_day else ["month"], "aggregations": measures("sketch")}]
    if by_day:
        steps.append({"operator": "Filter_Aggregate", "group_by": ["month"], "aggregations": measures("merge")})
    return {"steps": steps + [{"operator": "Math_Compute", "output_column": o, "expression": e} for o, e in READS], "projection": ["month", *[o for o, _ in READS]]}


def test_merged_equals_one_pass_within_the_errors(spark, rows):
    exact = {r.month: r for r in rows.groupBy("month").agg(F.count_distinct("v").alias("n"), F.count("x").alias("rows"), F.sort_array(F.collect_list("x")).alias("xs")).collect()}
    for by_day in (False, True):
        for r in run(plan(by_day), {"t": rows}).collect():
            if r.month == 99:
                assert (r.n, r["median"], json.loads(r.top)) == (0, None, [])
                continue
            e = exact[r.month]
            assert abs(r.n / e.n - 1) < 0.03
            for q, v in ((0.5, r["median"]), (0.99, r.p99)):
                assert abs(sum(x <= v for x in e.xs) / e.rows - q) < 0.01
            top = json.loads(r.top)
            assert [x["item"] for x in top[:2]] == ["hot", "warm"] and top[0]["count"] == 4000 and top[1]["count"] == pytest.approx(20_000 * 4 / 35, abs=2)


def test_stored_sketches_survive_parquet(spark, rows, tmp_path):
    days = run({"steps": [{"operator": "Filter_Aggregate", "inputs": ["t"], "group_by": ["day", "month"], "aggregations": measures("sketch")}]}, {"t": rows})
    days.write.parquet(str(tmp_path / "days"))
    merge = {"steps": [{"operator": "Filter_Aggregate", "inputs": ["t"], "aggregations": measures("merge")}, {"operator": "Math_Compute", "output_column": "n", "expression": "distinct_estimate(distinct)"}, {"operator": "Math_Compute", "output_column": "r", "expression": "rank_estimate(quantiles, 30000)"}]}
    got = run(merge, {"t": spark.read.parquet(str(tmp_path / "days"))}).first()
    assert abs(got.n / 20011 - 1) < 0.03 and abs(got.r - 0.5) < 0.01


def test_breaches(spark, rows):
    for expression in ("quantile_estimate(q, 2)", "frequent_items(q, 0)"):
        with pytest.raises(PlanError):
            run({"steps": [{"operator": "Filter_Aggregate", "inputs": ["t"], "aggregations": [{"operation": "sketch_quantiles", "target_column": "x", "output_column": "q"}]}, {"operator": "Math_Compute", "output_column": "o", "expression": expression}]}, {"t": rows})
