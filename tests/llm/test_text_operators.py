"""Decontamination, token counts, SimHash: kernels and queries against brute force."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import common, decontamination, simhash, tokens

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def edge_docs(spark):
    long = "Alpha beta gamma. " * 60_000
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (3, long, "en"), (None, "Zürich ÉCOLE idiot", "de"), (4, " \t\n", "xx"), (5, "one", "en"), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(7), "n_words": F.lit("x"), "__contaminated": F.lit("y"), "size": F.lit(1), "file": F.lit("f"), "shard": F.lit(2), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})


# -- decontamination --------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def judged(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(13, len(v))
        for i in range(len(v) - k + 1) if v else []:
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "cé", "d1", "e"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(str(i), make(rng.choice([0, 1, 3, 12, 13, 14, 20]))) for i in range(12)] + [("12", None), ("3", "a B")]
    texts = [make(rng.choice([0, 1, 5, 40])) + (items[i % 12][1] or "") + make(3) for i in range(60)] + [None, "", "..."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    expected = {i: judged(t, items) for i, t in enumerate(texts)}
    for limit in (decontamination.SLICE_BYTES, 900):
        got = decontamination.scan(docs, benchmark, slice_bytes=limit, with_spans=True).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == expected
        for r in got:
            assert sum(len(words(r.text[s.start : s.end])) for s in r.hit_spans) == r.n_hit


def test_one_long_item_is_dealt_to_slices(spark):
    long = [f"w{i}" for i in range(3000)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (None, "w1 W2"), (2, "null item")], "item_id long, text string")
    texts = [" ".join(long[k : k + 60]) for k in range(0, 2900, 97)] + ["w1 w2", "w2 w1", "NULL, item"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit("x")).withColumn("row", F.lit(1))
    whole = sorted(map(str, decontamination.scan(docs, benchmark).collect()))
    assert whole == sorted(map(str, decontamination.scan(docs, benchmark, slice_bytes=40_000).collect()))
    got = {r.text: r for r in decontamination.scan(docs, benchmark, slice_bytes=40_000).collect()}
    assert got[texts[3]].n_hit == 60 and got["w1 w2"].n_items == 1 and got["w1 w2"].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got["NULL, item"].items_sha256 == hashlib.sha256(b"2").hexdigest() and not got["w2 w1"].contaminated


def test_decontamination_edges(spark):
    docs = edge_docs(spark)
    benchmark = spark.createDataFrame([(1, "alpha beta"), (None, "zürich École"), (2, ""), (2, "one")], "item_id long, text string")
    got = decontamination.scan(docs, benchmark, prefix="r_").collect()
    assert len(got) == 8 and {r.doc_id: r.r_contaminated for r in got} == {1: False, 2: False, 3: True, None: True, 4: False, 5: True, 6: False}
    assert [r.r_n_words for r in got if r.doc_id == 3] == [180_000] * 2
    null_item = [r for r in got if r.r_n_items and r.r_items_sha256 == hashlib.sha256(b"").hexdigest()]
    assert all(words("zürich École")[0] in words(r.text) for r in null_item)
    assert decontamination.scan(docs, benchmark.limit(0), prefix="r_").where("r_contaminated").count() == 0
    assert decontamination.scan(docs.limit(0), benchmark, prefix="r_").count() == 0


# -- tokens -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path(tokens.VOCABULARY), Tokenizer.from_file(public.path(tokens.VOCABULARY))


def test_token_counts_equal_the_library(spark, library):
    path, reference = library
    rng = random.Random(5)
    alphabet = "abcxyz ''stremlld 0123 éèÄßΣσ!?..,,\n\t漢字İ́\x1c ​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) + rng.choice(["", "<|startoftext|>", " <|endoftext|>x", "<|endoftext|"]) for _ in range(500)]
    texts += ["", None, "word " * 30_000, "x" * 5000, "IT'S <|endoftext|><|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    got = {r.doc_id: r for r in tokens.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(reference.encode(t or "", add_special_tokens=False).ids), t
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 2048)
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_token_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 20)
    counter = tokens.TokenCounter(json.load(open(library[0])))
    counter.count(" ".join(f"word{i}x" for i in range(500)))
    assert len(counter.words) <= 50 and len(counter.chunks) <= 20


def test_token_query_over_the_table(spark, library):
    got = tokens.query(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library[1].encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


# -- simhash ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, least):
    group = {p: {p} for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    lowest = lambda g: min((least[x] for x in g if least[x] is not None), default=None)
    return {p: lowest(group[p]) for p in prints}


def check_components(rows):
    least = {}
    for i, p in rows:
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    return slow_components(list(least), least)


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    expected = check_components(prints.items())
    got = {r.doc_id: r for r in simhash.query(spark, SF).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == {i: expected[p] for i, p in prints.items()}
    assert len({r.component_id for r in got.values()}) < len(got)


def test_links_are_complete_on_dense_and_chained_fingerprints():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for c in centres for _ in range(60)]
    chain = [centres[0] ^ np.uint64((1 << (2 * i)) - 1) for i in range(12)]
    fps = np.unique(np.array([*near, *chain, *rng.integers(0, 2**64, 300, dtype=np.uint64), 0, 1], np.uint64))
    pairs = simhash.verified(np.repeat(fps, 66), np.tile(np.arange(66, dtype=np.uint8), len(fps)))
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 4).all()
    up = {int(f): int(f) for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs.tolist():
        up[max(root(a), root(b))] = min(root(a), root(b))
    truth = slow_components([int(f) for f in fps], {int(f): int(f) for f in fps})
    assert {x: root(x) for x in up} == truth


def test_simhash_edges(spark):
    docs = edge_docs(spark)
    got = simhash.dedup(docs).collect()
    assert len(got) == 8
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fp == by_id[2].fp == by_id[4].fp == by_id[6].fp == 0
    assert by_id[1].component_id == by_id[6].component_id == 1 and by_id[3].component_id == 3
    kept = simhash.stage(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, None, 5], key=str)
    assert simhash.dedup(docs.limit(0)).count() == 0


def test_simhash_stage_decides_by_row(spark):
    words = lambda k: " ".join(f"w{k}x{i * i}" for i in range(60))
    rows = [(None, words(1)), (None, words(1)), (None, words(2)), (1, words(3)), (2, words(3)), (2, words(4)), (7, words(5)), (7, words(6)), (9, words(2))]
    kept = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, words(1)), (9, words(2)), (1, words(3)), (2, words(4)), (7, words(5)), (7, words(6))], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000 - i, 5001 - i) for i in range(40)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in common.components(df).collect()}
    expected = {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1400)} | {i: 4961 for i in range(4962, 5002)}
    assert got == expected
    assert common.components(df.limit(0)).count() == 0
