"""Vector codes against a plain loop over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import vector_codes

SF = "/root/testdata/sf0.001"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows (vec_id, vector, label) -> rows (vec_id, label, codes, error) and the codebooks, in Python integers."""
    good = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in good), default=0) // parts))
    ints = [(i, [math.floor(x * scale) for x in v] + [0] * (width * parts - len(v)), lab) for i, v, lab in good]
    cut = [[w[p * width : p * width + width] for p in range(parts)] for _, w, _ in ints]
    order = sorted(range(len(ints)), key=lambda k: (ints[k][0] is None, ints[k][0] or 0, cut[k]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda p, v: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds if ints else 0):
        new = []
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(find(p, c[p])[1], []).append(c[p])
            new.append([[sum(x) // len(held[k]) for x in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for (i, _, lab), c in zip(ints, cut, strict=True):
        best = [find(p, c[p]) for p in range(parts)]
        out.append((i, lab, [k for _, k in best], sum(d for d, _ in best)))
    return out, books


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit(1), "row": F.lit("x"), "part": F.lit(2), "error": F.lit(0)}).repartition(3)
    coded = vector_codes.compress(df, **options)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    expected, books = plain(rows, **options)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, list) else x for x in r)
    got = [(r.vec_id, r.label, r.codes, r.error) for r in coded.rows.collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert coded.books.tolist() == books
    totals = {}
    for _, lab, _, e in expected:
        totals[lab] = totals.get(lab, 0) + e
    assert all(r.label_error == totals[r.label] for r in vector_codes.with_label_error(coded.rows).collect())
    return coded


def test_against_a_plain_loop(spark, monkeypatch):
    rng = random.Random(1)
    values = [-0.02, -0.01, 0.0, 0.01, 0.5, -0.004]
    rows = [(rng.randrange(-5, 60) if rng.random() < 0.9 else None, [rng.choice(values) for _ in range(8)], rng.choice([0, 1, None])) for _ in range(150)]
    same(spark, rows, parts=4, entries=9)
    monkeypatch.setattr(vector_codes, "HEAVY_ROWS", 3)
    monkeypatch.setattr(vector_codes, "HEAVY_SHARE", 20)
    monkeypatch.setattr(vector_codes, "AT_ONCE", 64)
    same(spark, rows + [rows[0]] * 60, parts=4, entries=9, rounds=3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [nan] * 4, 0), (3, [inf, 0.0, 0.0, 0.0], 0), (4, [None, 1.0, 1.0, 1.0], 0)]
    assert same(spark, rows, parts=2).books.shape == (2, 0, 1)
    assert same(spark, [], parts=2).rows.count() == 0
    same(spark, rows + [(5, [0.1] * 5, None), (None, [], None), (5, [0.1] * 5, None), (6, [0.3], 2), (7, [-0.0039], 2)], parts=4)
    huge = spark.createDataFrame([(1, [1e30, -1e30], 0), (2, [3e38, 0.0], 0), (3, [0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert all(0 <= r.label_error < 1 << 63 for r in vector_codes.with_label_error(vector_codes.compress(huge, parts=2, entries=1).rows).collect())


def test_sums_beyond_64_bits(spark):
    distinct = spark.createDataFrame([(0, [1 << 27], 1 << 40), (0, [(1 << 27) - 1], 1 << 40)], "part int, values array<int>, n long")
    assert vector_codes.moved(distinct, np.array([[[0]]])).tolist() == [[[(1 << 27) - 1]]]


def test_decoded_lies_within_the_error(spark):
    coded = vector_codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    vectors = {r.vec_id: np.floor(np.array(r.embedding, np.float64) * 256) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    for r in coded.decoded().collect():
        assert ((np.array(r.approximation) * 256 - 0.5 - vectors[r.vec_id]) ** 2).sum() == pytest.approx(r.error)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    expected, books = plain([(r.vec_id, r.embedding, r.label) for r in rows])
    flat = ",".join(str(x) for p in books for e in p for x in e)
    totals = {}
    for _, lab, _, e in expected:
        totals[lab] = totals.get(lab, 0) + e
    got = {tuple(r) for r in vector_codes.query(spark, SF).collect()}
    assert got == {(i, "".join(f"{c:02x}" for c in codes), e, totals[lab], hashlib.sha256(flat.encode()).hexdigest()) for i, lab, codes, e in expected}
