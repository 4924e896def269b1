"""Toxicity and quality: held-out accuracy, kernels, edges."""

import math
import os
import pickle
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity

from .test_text_operators import edge_docs

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(rows, labels):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def area(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable"))
    pos = truth == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_toxicity_on_held_out_rows(spark, labels):
    pairs = held(toxicity.query(spark, SF).collect(), labels)
    truth, scores = np.array([x.toxic for _, x in pairs]), np.array([r.score for r, _ in pairs])
    assert all(r.predicted == int(r.score >= 0.5) and r.rejected == (r.score >= r.threshold) for r, _ in pairs)
    assert (np.array([r.predicted for r, _ in pairs]) == truth).mean() > 0.96 and area(scores, truth) > 0.95
    caught = np.array([r.rejected for r, _ in pairs])
    assert caught[truth == 1].mean() > 0.75 and caught[truth == 0].mean() < 0.02


def test_score_comes_from_training(spark, labels):
    """Without an epoch the weights say nothing about toxicity: no statistic of the labels is put into them."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.doc_id in labels and labels[r.doc_id].toxic in (0, 1)]
    part = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5
    train, held_rows = [r for r in docs if part(r) > 1], [r for r in docs if part(r) == 0]
    words = [np.concatenate(toxicity.word_buckets(r.text)) for r in train]
    y, truth = np.array([labels[r.doc_id].toxic for r in train], float), np.array([labels[r.doc_id].toxic for r in held_rows])
    found = []
    for epochs in (0, 4):
        net = toxicity.Classifier()
        net.fit(words, y, epochs=epochs)
        found.append(area(net.logit(net.pooled([r.text for r in held_rows])), truth))
    assert abs(found[0] - 0.5) < 0.1 and found[1] > 0.85


def test_sample_is_bounded_and_takes_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 50)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 30)
    rows = [(7, "same text")] * 300 + [(7, f"another text {i}") for i in range(300)] + [(i, "x" * i) for i in range(1, 2000, 7)] + [(None, "no id"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic").orderBy("doc_id", "t").collect()
    assert len({(r.doc_id, r.text) for r in got}) == len(got) and len(set(got)) == len(got)
    for part, label in ((False, 0), (False, 1), (True, None)):
        own = [r for r in got if (r.part == 1) == part and label in (None, r.label)]
        assert 0 < len(own) <= (30 if part else 50) and sum(len(r.text or "") for r in own) <= 4000
    assert got == toxicity.sample(docs.repartition(5), labels, "toxic").orderBy("doc_id", "t").collect()


def equal_texts_score_alike():
    net, rng = toxicity.Classifier(), np.random.default_rng(2)
    net.embed[:-1] += rng.normal(0, 1, net.embed[:-1].shape).astype(np.float32)
    text = " ".join("w%d" % w for w in rng.integers(0, 999, 700))
    others = [" ".join("w%d" % w for w in rng.integers(0, 999, n)) for n in rng.integers(1, 9000, 40)]
    seen = {net.logit(net.pooled([*others[:k], text, *others[k:]]))[k] for k in range(0, 40, 3)} | {net.logit(net.pooled([text]))[0]}
    assert len(seen) == 1
    assert len(set(net.logit(net.pooled([text] * 40)))) == 1


def equal_statistics_score_alike():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        model = quality.Model(quality.Features(np.zeros(17), np.ones(17)), rng.normal(size=quality.COMPONENTS), np.linspace(0, 1, 9), np.linspace(0, 1, 9), 0.5)
        row = rng.normal(size=(1, 17))
        seen = {float(model.raw(np.concatenate([rng.normal(size=(k, 17)), row, rng.normal(size=(n, 17))]))[k]) for k in (0, 1, 2, 3, 7, 300, 1023, 1024) for n in (0, 1, 3, 500)}
        assert len(seen) == 1


@pytest.mark.parametrize("kernels", ["Haswell", "Zen", "SkylakeX"])
def test_equal_rows_score_alike_in_any_batch_with_any_kernels(kernels):
    code = "from tests.llm import test_models as t; t.equal_texts_score_alike(); t.equal_statistics_score_alike()"
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"OPENBLAS_CORETYPE": kernels}, cwd=os.path.dirname(toxicity.__file__) + "/../..")


def test_steps_follow_the_gradient(monkeypatch):
    """One step from the start: Adam's is against the sign of a finite difference, Adagrad's is proportional to it."""
    monkeypatch.setattr(toxicity, "DROPOUT", 0.0)
    monkeypatch.setattr(toxicity, "EMBED_DECAY", 0.0)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, n).astype(np.int32) for n in (9, 0, 3, 14)]
    y = np.array([1.0, 0.0, 0.0, 1.0])
    start, net = toxicity.Classifier(), toxicity.Classifier()
    for one in (start, net):
        one.embed *= 100
    net.fit(docs, y, epochs=1)

    def loss():
        seq, at = toxicity.laid_out(docs)
        peak, _ = toxicity.peaks(start.responses(seq), at)
        z = start.logit(peak).astype(np.float64)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        return float(np.mean(weight * (np.log1p(np.exp(z)) - y * z)))

    def slope(array, at):
        kept, found = array(start)[at].copy(), []
        for h in (1e-3, -1e-3):
            array(start)[at] = kept + np.float32(h)
            found.append(loss())
        array(start)[at] = kept
        return (found[0] - found[1]) / 2e-3

    arrays = [lambda m: m.filters[0], lambda m: m.filters[1], lambda m: m.filters[2], lambda m: m.bias, lambda m: m.out]
    tried = 0
    for array in arrays:
        for at in list(np.ndindex(array(start).shape))[::7]:
            g = slope(array, at)
            if abs(g) > 2e-3:
                tried += 1
                assert np.sign(array(net)[at] - array(start)[at]) == -np.sign(g)
    ratios = []
    words = np.unique(np.concatenate(docs))
    for w in words[::4]:
        moved = net.embed[w] - start.embed[w]
        g = np.array([slope(lambda m: m.embed, (w, d)) for d in range(toxicity.DIMENSIONS)])
        if np.abs(g).max() > 2e-3:
            tried += 1
            ratios.append(-(moved @ g) / np.sqrt((moved @ moved) * (g @ g)))
    assert tried > 30 and ratios and min(ratios) > 0.98


def test_quality_on_held_out_rows(spark, labels):
    pairs = held(quality.query(spark, SF).collect(), labels)
    truth, scores = np.array([x.quality for _, x in pairs]), np.array([r.score for r, _ in pairs])
    assert all(r.predicted == int(r.score >= 0.3) for r, _ in pairs)
    assert (np.array([r.predicted for r, _ in pairs]) == truth).mean() > 0.97 and area(scores, truth) > 0.98


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é ,.\n漢", max_size=12), max_size=6))
def test_word_hashes_depend_on_the_word_only(parts):
    text = " ".join(parts)
    words = toxicity.cleaned(text).split()
    assert np.concatenate(toxicity.word_buckets(text)).tolist() == [int(toxicity.hashed(w)[0]) for w in words]


def test_nets_travel_as_what_training_has_changed():
    net = toxicity.Classifier(seed=3)
    net.fit([np.arange(k, k + 9, dtype=np.int32) for k in range(40)], np.array([0.0, 1.0] * 20), epochs=2)
    net.calibrate(np.array([0.5, -1.0, 2.0]), np.array([1.0, 0.0, 1.0]))
    data = pickle.dumps(net)
    again = pickle.loads(data)
    assert len(data) < 20_000 and (again.embed == net.embed).all() and again.scale == net.scale
    texts = ["a b c", "", None, "d " * 500]
    assert again.scores(texts).tolist() == net.scores(texts).tolist()


def test_pieces_of_long_texts(monkeypatch):
    text = "idiot " + "word another " * 400
    whole = np.concatenate(toxicity.word_buckets(text))
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 50)
    pieces = toxicity.word_buckets(text)
    assert len(pieces) > 10 and np.concatenate(pieces).tolist() == whole.tolist()


def test_responses_are_convolutions():
    net = toxicity.Classifier()
    docs = [np.array([5, 9, 2], np.int32), np.zeros(0, np.int32), np.array([7], np.int32)]
    seq, start = toxicity.laid_out(docs)
    top = np.maximum.reduceat(net.responses(seq), start, axis=0)
    for k, doc in enumerate(docs):
        x = np.concatenate([np.zeros((2, toxicity.DIMENSIONS)), net.embed[doc], np.zeros((2, toxicity.DIMENSIONS))])
        for i, w in enumerate(toxicity.WIDTHS):
            windows = [sum(x[t + j] @ net.filters[i][j] for j in range(w)) for t in range(len(doc) + 2)]
            assert np.allclose(top[k, i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS], np.max(windows, axis=0), atol=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), min_size=1, max_size=12))
def test_isotonic_is_the_nearest_nondecreasing_sequence(points):
    v, w = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    got = quality.isotonic(v, w)
    assert (np.diff(got) >= -1e-12).all()
    # min-max formula of the isotonic fit
    mean = lambda i, j: (v[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    n = len(v)
    assert np.allclose(got, [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])


def test_partition_sums_are_the_whole_fit(spark):
    rng = np.random.default_rng(3)
    rows = [([float(x) for x in rng.normal(size=len(quality.STATISTICS))], float(rng.random() < 0.7), int(i % 4 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "stats array<double>, label double, part long")
    one, many = quality.fit(df.coalesce(1)), quality.fit(df.repartition(9))
    stats = np.array([r[0] for r in rows])
    assert np.allclose(one.raw(stats), many.raw(stats))
    z = one.features(stats)
    train = np.array([r[2] != 1 for r in rows])
    y = np.array([r[1] for r in rows])
    exact = np.linalg.solve(z[train].T @ z[train] / train.sum() + quality.RIDGE * np.eye(z.shape[1]), z[train].T @ y[train] / train.sum())
    assert np.allclose(one.ridge, exact)


def plain_statistics(text):
    """The statistics one by one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 17
    share = lambda chars: sum(raw.count(bytes([b])) for b in chars) / len(raw)
    words, lines = raw.lower().split(), raw.split(b"\n")
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\_=+", b"!?", b"|", b".,;:", b"\"'()/`-", b" \t", b"\n\r", bytes(range(128, 256))]
    m = max(1, len(words))
    top = max((words.count(w) for w in words), default=0)
    return [math.log1p(len(raw)), math.log1p(len(words)), min(len(raw) / m, 100), *map(share, groups), len(set(words)) / m, len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), top / m]


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aAbZ9 \n\t|!.,é漢#-'", max_size=60)))
def test_statistics_one_by_one(text):
    assert quality.statistics(text) == pytest.approx(plain_statistics(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), min_size=1, max_size=12), st.floats(0.01, 0.99))
def test_calibration_is_one_formula_at_all_sizes(points, prior):
    v, w = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    got = quality.calibrated(v, w, prior)
    assert (np.diff(got) >= -1e-12).all() and (got > 0).all() and (got < 1).all()
    many = quality.calibrated(v, w * 1e9, prior)
    assert np.allclose(many, quality.isotonic(v, w), atol=1e-6)


def test_quality_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "text " * i) for i in range(40)], "doc_id long, text string").withColumns({"score": F.lit("old"), "__stats": F.lit("s")})
    labels = spark.createDataFrame([(i, int(i > 20)) for i in range(40)], "doc_id long, quality int")
    got = quality.classify(docs, labels, docs.columns, prefix="q_")
    assert got.columns == [*docs.columns, "q_score"] and {r.score for r in got.collect()} == {"old"}


def test_model_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 1), (5, 1, 1), (6, 1, 1), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for marks in (none, one):
        got = toxicity.classify(docs, marks, "r_").collect()
        assert len(got) == 8 and len({r.r_score for r in got}) == 1 and got[0].score == 7 and not any(r.r_rejected for r in got)
        assert len(quality.classify(docs, marks, ["doc_id"]).collect()) == 8
    assert toxicity.classify(docs.limit(0), none, "r_").count() == 0 and quality.classify(docs.limit(0), one, ["doc_id"]).count() == 0
    stage = toxicity.stage(spark, docs, "/root/testdata/sf0.001")
    assert stage.columns == docs.columns
    small = spark.createDataFrame([(i, 0 if i % 2 else 1, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, "you idiot" if i % 2 else ("fine text " * (i % 7 + 1) if i else None)) for i in range(60)] + [(100, ""), (101, None)], "doc_id long, text string")
    tox = {r.doc_id: r for r in toxicity.classify(texts, small).collect()}
    assert all(0 <= r.score <= 1 for r in tox.values()) and tox[41].score > tox[42].score and tox[100].score == tox[101].score
    qual = {r.doc_id: r.score for r in quality.classify(texts, small, ["doc_id"]).collect()}
    assert qual[100] == qual[101] and all(0 <= s <= 1 for s in qual.values())


def test_thresholds_cover_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 100)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    # a tenth is of a language where all rows are toxic, its texts longer than any of the fit's sample
    rows = [(i, ("you idiot " if i % 3 == 0 else "fine text ") + "word " * (7500 if i % 20 < 2 else i % 5), "xx" if i % 20 < 2 else "en", int(i % 3 == 0 or i % 20 < 2)) for i in range(1, 3001)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for lang in ("en", "xx"):
        own = [(got[r[0]], r[3]) for r in rows if part(r[0]) == 1 and r[2] == lang]
        s, y = np.array([r.score for r, _ in own]), np.array([x for _, x in own])
        f1 = lambda t: 2 * (y * (s >= t)).sum() / max(1, (s >= t).sum() + y.sum())
        assert y.sum() >= toxicity.MIN_POSITIVE and f1(own[0][0].threshold) >= max(f1(v) for v in s) - 0.02


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=1, max_size=40))
def test_threshold_is_a_cut_of_nearly_best_f1(pairs):
    s, y = np.array([p[0] / 20 for p in pairs]), np.array([p[1] for p in pairs])
    bins = [(v, v, int((s == v).sum()), int(y[s == v].sum())) for v in np.unique(s)]
    f1 = lambda t: 2 * (y * (s >= t)).sum() / max(1, (s >= t).sum() + y.sum())
    got = toxicity.best_threshold(bins)
    assert got == 0.5 if not y.sum() else f1(got) >= max(f1(v) for v in s) - 0.01 - 1e-12


def test_filters_and_hashes_see_across_pieces(monkeypatch):
    net, rng = toxicity.Classifier(), np.random.default_rng(5)
    net.embed[:-1] += rng.normal(0, 1, net.embed[:-1].shape).astype(np.float32)
    texts = [" ".join("w%d" % w for w in rng.integers(0, 99, n)) for n in (0, 1, 2, 3, 40, 200)] + ["a " * 30 + "long" * 60 + " b", "x" * 999, None, "  " * 90, "ab " * 50]
    whole, buckets = net.pooled(texts), [np.concatenate(toxicity.word_buckets(t)).tolist() for t in texts]
    for size in (2, 7, 50):
        monkeypatch.setattr(toxicity, "PIECE_BYTES", size)
        assert [np.concatenate(toxicity.word_buckets(t)).tolist() for t in texts] == buckets
        assert np.allclose(net.pooled(texts), whole, atol=1e-4)
