"""The pipeline: each stage against what its operator decides; the registered queries."""

import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F
from tessella.llm import decontamination, mixing, queries, simhash, toxicity
from tessella.llm.common import made, materialise, release, table

from .test_table_operators import copies_by_hand
from .test_text_operators import judged

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    decided = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, before, SF), f"test-{name}")
        ids = Counter(r.doc_id for r in docs.collect())
        if name == "toxicity":
            decided = {r.doc_id: 1 for r in toxicity.classify(before, table(spark, SF, "labels")).collect() if not r.rejected}
        elif name == "simhash":
            groups = simhash.dedup(before).collect()
            decided = {c: 1 for c in {r.component_id for r in groups}}
        elif name == "decontamination":
            decided = {r.doc_id: 1 for r in decontamination.scan(before, table(spark, SF, "benchmark")).collect() if not r.contaminated}
        elif name == "mixing":
            mixed = mixing.mix(before)
            decided = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
        assert ids == Counter(decided)
        if name != "sharding":
            assert docs.columns == before.columns
        else:
            assert docs.columns == [*before.columns, "shard", "version"]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.drop("shard", "version").collect())) == sorted(map(str, docs.drop("shard", "version").collect()))


def left_by_hand(rows, benchmark):
    """What SimHash and decontamination leave, by plain loops over all pairs of rows."""
    prints = [simhash.fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.BITS:
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    return [r for r in kept if not judged(r[1], benchmark)[-1]]


def test_stages_against_brute_force_with_odd_rows(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage = text(30)
    base = [text(rng.choice((1, 3, 40, 200))) for _ in range(120)]
    near = [b + " more" for b in base[:20] if len(b) > 500]
    rows = [(i, t, rng.choice(("a", "b", None))) for i, t in enumerate([*base, *near, f"x {passage} y", passage.upper(), "z " * 900 + passage])]
    rows += [(None, base[5], "a"), (3, base[7], "b"), (3, text(50), "b"), (None, "no id " + text(20), "c"), (900, None, "a"), (901, "", "a"), (5, base[5], "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "row": F.lit("old"), "digest": F.lit("old"), "shard": F.lit("old"), "score": F.lit("old")}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, at = table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        at[name] = Counter(tuple(r)[:8] for r in docs.collect())
    whole = [(*r, "en", *["old"] * 4) for r in rows]
    assert at["toxicity"] == Counter(whole)  # no labels: nothing is rejected
    clean = left_by_hand(whole, [("1", passage)])
    assert at["decontamination"] == Counter(clean) and len(clean) < len(rows) - 10
    mixed = sum((Counter({tuple(r): c * n}) for (*r, c), n in copies_by_hand(clean).items() if c), Counter())
    assert at["mixing"] == mixed == at["sharding"]
    empty = tmp_path / "empty"
    table(spark, str(tmp_path), "documents").limit(0).write.parquet(str(empty / "documents.parquet"))
    for name in ("benchmark", "labels"):
        table(spark, str(tmp_path), name).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_a_run_deletes_its_scratch_tables(spark):
    before = made()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    release(spark, before)
    assert made() == before


def test_registration():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
