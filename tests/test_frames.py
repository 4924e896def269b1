"""RANGE frames against plain Python, by partition and over all rows in small blocks."""

import random

import pytest

from tessella.functions.values import PlanError
from tessella.operators import frames, ordered_joins
from tessella.operators.relation import Relation

PICK = {"sum": sum, "count": len, "avg": lambda v: sum(v) / len(v), "min": min, "max": max}


def expected(rows, partitioned, operation, before, after, exclude):
    out = []
    for i, (g, k, x, _) in enumerate(rows):
        frame = []
        for j, (h, m, y, _) in enumerate(rows):
            near = (m is None and k is None) or (None not in (m, k) and k - before <= m <= k + after)
            left_out = (exclude == "current" and i == j) or (exclude == "group" and m == k)
            if y is not None and near and not left_out and (not partitioned or g == h):
                frame.append(y)
        out.append((i, PICK[operation](frame) if frame or operation == "count" else None))
    return dict(out)


@pytest.mark.parametrize("kind", ["int", "double"])
def test_range_frames(spark, monkeypatch, kind):
    monkeypatch.setattr(ordered_joins, "BLOCK", 7)
    rng = random.Random(1)
    key = lambda: rng.choice([None, 5, 5, 5, rng.randrange(60)]) if kind == "int" else rng.choice([None, 0.5, 0.5, rng.uniform(-9, 9)])
    rows = [(rng.choice([None, 1, 2]), key(), rng.choice([None, *range(9)]), i) for i in range(80)]
    df = spark.createDataFrame(rows, f"g int, first {kind}, x int, i int")
    for operation, exclude in (("sum", "none"), ("sum", "group"), ("avg", "current"), ("min", "none"), ("count", "current")):
        before, after = rng.choice([(0, 0), (3, 2), (2.5, 0) if kind == "double" else (4, 0), (100, 100)])
        partition = rng.choice([[], ["g"]])
        got = frames.range_frame(Relation(df), operation, "x", "first", before, after, "out", partition, exclude).df
        assert got.columns == ["g", "first", "x", "i", "out"]
        want = expected(rows, bool(partition), operation, before, after, exclude)
        found = {r.i: r.out for r in got.collect()}
        assert len(found) == 80
        for i in want:
            assert found[i] == (pytest.approx(want[i]) if want[i] is not None else None), (operation, exclude, partition, i)


def test_frames_of_doubles_over_the_ends_of_blocks(spark, monkeypatch):
    """Balances in cents, of which many are just 5 apart and stand at the ends of their blocks."""
    monkeypatch.setattr(ordered_joins, "BLOCK", 1)
    keys = [k / 100 + d for k in range(7, 1000, 31) for d in (0, 5)]
    keys = [round(k, 2) for k in keys]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k double")
    got = {r.i: r.out for r in frames.range_frame(Relation(df), "count", "i", "k", 5, 5, "out", []).df.collect()}
    assert got == {i: sum(k - 5 <= m <= k + 5 for m in keys) for i, k in enumerate(keys)}
    far = spark.createDataFrame([(0, float("-inf")), (1, 0.0), (2, float("inf"))], "i int, k double")
    assert {r.i: r.out for r in frames.range_frame(Relation(far), "count", "i", "k", 5, 5, "out", []).df.collect()} == {0: 1, 1: 1, 2: 1}


def test_breaches(spark):
    r = Relation(spark.range(3).toDF("x"))
    for more in (("min", "x", "x", 1, 1, "o", [], "group"), ("mode", "x", "x", 1, 1, "o", []), ("sum", "x", "x", -1, 1, "o", [])):
        with pytest.raises(PlanError):
            frames.range_frame(r, *more)
    assert frames.range_frame(Relation(r.df.limit(0)), "sum", "x", "x", 1, 1, "o", []).df.count() == 0
