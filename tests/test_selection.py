"""Percentiles by selection equal Spark's percentile, with small limits so that rounds are needed."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import selection
from tessella.plans.execute import run


@pytest.mark.parametrize("q", [0.0, 0.37, 0.99])
def test_equals_percentile_on_all_groups(spark, monkeypatch, q):
    monkeypatch.setattr(selection, "LIMIT", 100)
    rng = random.Random(int(q * 100))
    value = lambda g: rng.choice([None, 7.0, 7.0, 7.0, rng.uniform(-1, 1), rng.expovariate(1) * 10 ** rng.randrange(-9, 9), float("nan") if g == 3 else -0.5])
    rows = [(g, value(g)) for g in (None, 1, 2, 3) for _ in range(5 if g == 2 else 1500)] + [(4, None)] * 30 + [(5, 1.5)] * 40
    df = spark.createDataFrame(rows, "g int, v double")
    for distinct in (False, True):
        source = df.distinct() if distinct else df
        expected = {r.g: r.p for r in source.groupBy("g").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        got = {r.g: r.p for r in selection.percentile(df, ["g"], "v", q, "p", distinct).collect()}
        assert set(got) == set(expected)
        for g in expected:
            assert got[g] == pytest.approx(expected[g], rel=1e-12, nan_ok=True) if expected[g] is not None else got[g] is None, (g, distinct)


def test_without_groups_and_a_sketch_that_is_off(spark, monkeypatch):
    monkeypatch.setattr(selection, "LIMIT", 30)
    monkeypatch.setattr(selection, "SKETCH", 8)
    monkeypatch.setattr(selection, "MARGIN", 0.001)
    df = spark.range(20_001).select((F.col("id") * 7919 % 20_001).alias("v"))
    assert selection.percentile(df, [], "v", 0.25, "p").first().p == 5000.0
    assert selection.percentile(df.where("v < 0"), [], "v", 0.25, "p").first().p is None


def test_in_a_plan(spark, monkeypatch):
    monkeypatch.setattr(selection, "LIMIT", 10)
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 101).alias("v"))
    measures = [{"operation": "median", "target_column": "v", "output_column": "m", "method": "selection"}, {"operation": "count", "output_column": "n"}, {"operation": "p90", "target_column": "v", "output_column": "p", "method": "selection", "distinct": True, "filters": [{"field": "v", "operator": ">", "value": 40}]}]
    plan = lambda ms: {"steps": [{"operator": "Filter_Aggregate", "inputs": ["t"], "group_by": ["k"], "aggregations": ms}]}
    plain = [{k: v for k, v in m.items() if k != "method"} for m in measures]
    rows = lambda ms: sorted(tuple(r) for r in run(plan(ms), {"t": df}).collect())
    assert rows(measures) == rows(plain)
