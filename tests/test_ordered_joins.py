"""As-of and inequality joins against plain Python, with keys, values and ranges that span tasks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.values import PlanError
from tessella.operators import ordered_joins
from tessella.operators.ordered_joins import OPERATORS, as_of, theta
from tessella.operators.relation import Relation

TEST = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def text(rows):
    return sorted(map(str, map(tuple, rows)))


def expected_as_of(left, right, direction, tolerance):
    out = []
    for k, t, i in left:
        fits = [(b, j) for a, b, j in right if None not in (k, t, a, b) and a == k]
        back = max(((b, j) for b, j in fits if b <= t), default=None)
        ahead = min(((b, j) for b, j in fits if b >= t), default=None)
        hit = back if direction == "backward" else ahead if direction == "forward" else ahead if back is None or (ahead and ahead[0] - t < t - back[0]) else back
        if hit and tolerance is not None and abs(hit[0] - t) > tolerance:
            hit = None
        out.append((k, t, i, *(hit or (None, None))))
    return out


@pytest.mark.parametrize("direction", ordered_joins.DIRECTIONS)
@pytest.mark.parametrize("tolerance", [None, 3])
def test_as_of_with_a_hot_key(spark, direction, tolerance):
    rng = random.Random(3)
    key = lambda: rng.choice((None, 1, 2, 7, 7, 7, 7, 7, 7, 7))
    left = [(key(), rng.choice((None, *range(60))), i) for i in range(300)] * 2
    right = [(key(), rng.choice((None, *range(60))), rng.randrange(3)) for i in range(90)]
    left += [(7, 30, 5)] * 200  # one key at one time
    l, r = spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, i int")
    got = as_of(Relation(l.repartition(3)), Relation(r), ["k"], ["k"], "t", "t", direction=direction, tolerance=tolerance).df
    assert got.columns == ["k", "t", "i", "t_right", "i_right"]
    assert text(got.collect()) == text(expected_as_of(left, right, direction, tolerance))


def test_as_of_times_and_edges(spark):
    day = datetime.date(2024, 1, 1)
    l = spark.createDataFrame([(1, day), (2, day + datetime.timedelta(4)), (3, None)], "i int, d date")
    r = spark.createDataFrame([(day + datetime.timedelta(1), "a"), (day + datetime.timedelta(3), "b"), (None, "c")], "d date, v string")
    near = lambda **more: [x.v for x in as_of(Relation(l), Relation(r), [], [], "d", "d", direction="nearest", **more).df.orderBy("i").collect()]
    assert near() == ["a", "b", None] and near(tolerance=0.5) == [None, None, None]
    stamps = lambda df: df.withColumn("d", F.col("d").cast("timestamp"))
    got = as_of(Relation(stamps(l)), Relation(stamps(r)), [], [], "d", "d", direction="forward", tolerance=86400).df
    assert [x.v for x in got.orderBy("i").collect()] == ["a", None, None]
    assert as_of(Relation(l), Relation(r.limit(0)), [], [], "d", "d").df.where("v is null").count() == 3
    assert as_of(Relation(l.limit(0)), Relation(r), [], [], "d", "d").df.count() == 0
    with pytest.raises(PlanError):
        as_of(Relation(l), Relation(r), [], [], "d", "d", direction="sideways")


def test_no_part_holds_the_hot_key(spark):
    l = spark.range(40_000).select((F.col("id") % 10 > 8).cast("int").alias("k"), "id")
    r = l.where("id % 7 = 0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    try:
        found = as_of(Relation(l), Relation(r), ["k"], ["k"], "id", "id").df
        sizes = [x["n"] for x in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.count() == 40_000 and max(sizes) < 0.6 * 40_000
    wrong = found.where("id_right is not null and (id_right > id or id - id_right > 70)").count()
    assert wrong == 0


@pytest.mark.parametrize("block", [4, 64])
@pytest.mark.parametrize("a", list(OPERATORS))
def test_two_inequalities(spark, monkeypatch, block, a):
    monkeypatch.setattr(ordered_joins, "BLOCK", block)
    rng = random.Random(block)
    value = lambda: rng.choice([None, 5.0, 5.0, 5.0, *[rng.uniform(0, 10) for _ in range(8)]])
    left = [(i, value(), value()) for i in range(90)]
    right = [(i, value(), value()) for i in range(40)] + [(90, 99.0, -99.0), (91, -99.0, 99.0), (92, float("nan"), 5.0)]
    l, r = spark.createDataFrame(left, "i int, x double, y double"), spark.createDataFrame(right, "j int, x double, y double")
    b = rng.choice(list(OPERATORS))
    for conditions in ([("x", a, "x"), ("y", b, "y")], [("x", a, "y")], [("x", a, "x"), ("x", b, "y")]):
        got = theta(Relation(l), Relation(r), conditions).df
        assert got.columns == ["i", "x", "y", "j", "x_right", "y_right"]
        of = {"x": 1, "y": 2}
        holds = lambda p, q, c=conditions: all(p[of[f]] is not None and q[of[g]] is not None and TEST[o](p[of[f]], q[of[g]]) for f, o, g in c)
        pairs = [(p[0], q[0]) for p in left for q in right if holds(p, q)]
        assert sorted((x.i, x.j) for x in got.collect()) == sorted(pairs), conditions


def test_wide_ranges_and_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(ordered_joins, "BLOCK", 100)
    l = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    r = spark.createDataFrame([(0, 9999, "all"), (7, 7, "hot"), (5, 1, "none"), (2990, 2999, "end"), (-5, -1, "before")], "low long, high long, name string")
    got = theta(Relation(l), Relation(r), [("v", ">=", "low"), ("v", "<=", "high")]).df
    n = {x.name: x["count"] for x in got.groupBy("name").count().collect()}
    values = [7 if i % 3 == 0 else i for i in range(3000)]
    assert n == {"all": 3000, "hot": values.count(7), "end": sum(2990 <= v <= 2999 for v in values)}
    for empty in ((l.limit(0), r), (l, r.limit(0))):
        assert theta(Relation(empty[0]), Relation(empty[1]), [("v", ">=", "low"), ("v", "<=", "high")]).df.count() == 0
    with pytest.raises(PlanError):
        theta(Relation(l), Relation(r), [("v", "=", "low")])
