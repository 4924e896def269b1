"""Tolerant multiset comparison against a plain largest matching of single rows."""

import random
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pytest

from tessella.operators import tolerant


def number(v):
    try:
        return Decimal(v.strip().replace(",", "")) if v is not None else None
    except InvalidOperation:
        return None


def equal(e, a):
    x, y = number(e), number(a)
    if x is None or y is None:
        return (e if e is None else e.strip()) == (a if a is None else a.strip())
    d = len(e.strip().partition(".")[2])
    if not d:
        return x == y
    step = Decimal(1).scaleb(-d)
    return x.quantize(step, ROUND_HALF_UP) == y.quantize(step, ROUND_HALF_UP)


def largest(expected, actual):
    """Size of a largest matching, by augmenting one expected row after the other."""
    partner = {}

    def tried(i, seen):
        for j, a in enumerate(actual):
            if j not in seen and all(map(equal, expected[i], a)):
                seen.add(j)
                if j not in partner or tried(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    matched = sum(tried(i, set()) for i in range(len(expected)))
    return matched, len(expected) - matched, len(actual) - matched


def frames(spark, expected, actual, fields):
    shape = ", ".join(f"{f} string" for f in fields)
    return spark.createDataFrame(expected, shape), spark.createDataFrame(actual, shape)


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_largest_matching(spark, columns):
    rng = random.Random(columns)
    for trial in range(5):
        spread = rng.choice([0.06, 0.3, 2])

        def value():
            kind = rng.random()
            if kind < 0.12:
                return rng.choice([None, "x", " x", "", "0.05x"])
            x = rng.uniform(-spread, spread)
            return rng.choice([f"{x:.1f}", f"{x:.2f}", f"{x:.3f}", f" {x:.2f} ", f"{x:.0f}", "0.05", "-0.05", "0.0", "-0.00", "1,000.5"])

        make = lambda n: [tuple(rng.choice(["a", "b"]) if k else value() for k in range(1)) + tuple(value() if k < columns - 1 else rng.choice("ab") for k in range(max(1, columns - 1))) for _ in range(n)]  # noqa: E731, B023
        expected, actual = make(40), make(45)
        actual += expected[:10]
        got = tolerant.counts(*frames(spark, expected, actual, [f"c{k}" for k in range(len(expected[0]))])).first()
        assert tuple(got) == largest(expected, actual), trial


def test_chain_that_first_come_first_served_would_lose(spark):
    """The value that rounds to both must go to the finer one, or the other way round."""
    e, a = frames(spark, [("0.1", "k"), ("0.05", "k"), ("0.1", "k")], [("0.052", "k"), ("0.1", "k"), ("0.149", "k")], ["v", "k"])
    assert tuple(tolerant.counts(e, a).first()) == (3, 0, 0)


def test_uniform_decimals_and_edges(spark):
    e, a = frames(spark, [("1.50", None), ("1.50", None), ("2.00", "x")], [("1.495", None), ("1.505", None), ("2", " x "), ("2", "y")], ["v", "k"])
    assert tuple(tolerant.counts(e, a).first()) == (2, 1, 2)
    got = {tuple(r) for r in tolerant.differences(e, a).collect()}
    assert got == {("1.50", None, "missing", 1), ("1.505", None, "extra", 1), ("2", "y", "extra", 1)}
    assert tuple(tolerant.counts(e.limit(0), a).first()) == (0, 0, 4) and tuple(tolerant.counts(e, a.limit(0)).first()) == (0, 3, 0)
    n, m = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, v double"), spark.createDataFrame([(0.52, 1), (0.2501, 2)], "v double, k long")
    assert tuple(tolerant.counts(n, m).first()) == (2, 0, 0)


def test_sweep_holds_one_interval_for_each_number_of_decimals():
    def rows():
        for k in range(3000):
            for width in (1, 10, 100):
                if k % width == 0:
                    yield k, k + width - 1, True, 1
            yield k, k, False, 1

    assert sum(n for _, n in tolerant.sweep(rows())) == 2 * 3000


def test_pairs_and_one_sided_islands_need_no_sweep(spark, monkeypatch):
    monkeypatch.setattr(tolerant, "_swept", lambda batches: (1 / 0 for _ in batches))
    expected = spark.createDataFrame([("a", "1.5"), ("a", "7.25"), ("b", "3.0"), ("b", "x"), ("c", "9.00"), ("c", "9.00")], "k string, v string")
    actual = spark.createDataFrame([("a", "1.46"), ("a", "7.251"), ("a", "8"), ("b", "x"), ("c", "9.001")], "k string, v string")
    assert tuple(tolerant.counts(expected, actual).first()) == (4, 2, 1)
