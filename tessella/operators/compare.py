"""Comparison of results: as multisets, by key, by position; labels before and after; run metrics; text similarity; samples."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import quoted

from .windows import numbered


def decimals(expected: Column) -> Column:
    """Digits after the point of the expected value as written."""
    return F.length(F.regexp_extract(F.regexp_replace(expected.cast("string"), ",", ""), r"^[+-]?\d*\.(\d+)$", 1))


def same(expected: Column, actual: Column) -> Column:
    """Numbers are equal when both round, half up, to the decimals of the expected one; without decimals exactly. Other values
    are equal as trimmed text."""
    number = lambda c: F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("decimal(38,12)")
    e, a, d = number(expected), number(actual), decimals(F.trim(expected.cast("string")))
    scaled = lambda x: F.floor(F.abs(x) * F.pow(F.lit(10.0), d).cast("decimal(20,0)") + F.expr("0.5bd")) * F.signum(x)
    numeric = F.when(d == 0, e == a).otherwise(scaled(e) == scaled(a))
    return F.coalesce(numeric, F.trim(expected.cast("string")).eqNullSafe(F.trim(actual.cast("string"))))


def multiset(expected: DataFrame, actual: DataFrame, decimals: int | None = None) -> DataFrame:
    """Each differing row with its count on either side; floats rounded first if asked. One grouped pass, no row pairing."""
    def clean(df: DataFrame) -> DataFrame:
        if decimals is None:
            return df
        return df.select(*[F.round(quoted(f), decimals).alias(f) if t in ("double", "float") else quoted(f) for f, t in df.dtypes])

    both = clean(expected).withColumn("__side", F.lit(1)).unionByName(clean(actual).withColumn("__side", F.lit(0)))
    n = both.groupBy(*[quoted(f) for f in expected.columns]).agg(F.sum("__side").alias("expected"), F.sum(1 - F.col("__side")).alias("actual"))
    return n.where("expected <> actual")


def counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: matched, missing and extra rows."""
    both = expected.withColumn("__side", F.lit(1)).unionByName(actual.withColumn("__side", F.lit(0)))
    n = both.groupBy(*[quoted(f) for f in expected.columns]).agg(F.sum("__side").alias("e"), F.sum(1 - F.col("__side")).alias("a"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return n.agg(total(F.least("e", "a")).alias("matched"), total(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("missing"), total(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("extra"))


def keyed(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, status, wrong): missing, extra or wrong, with the names of the fields that differ."""
    fields = [c for c in expected.columns if c not in keys]
    e = expected.select(*[quoted(k) for k in keys], F.struct(*[quoted(f) for f in fields]).alias("e"))
    a = actual.select(*[quoted(k).alias(f"__{k}") for k in keys], F.struct(*[quoted(f) for f in fields]).alias("a"))
    both = e.join(a, reduce(Column.__and__, [quoted(k).eqNullSafe(quoted(f"__{k}")) for k in keys]), "full")
    wrong = F.filter(F.array(*[F.when(~same(F.col(f"e.{f}"), F.col(f"a.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.size(wrong) > 0, "wrong")
    out = both.select(*[F.coalesce(quoted(k), quoted(f"__{k}")).alias(k) for k in keys], status.alias("status"), F.when(status == "wrong", F.array_join(wrong, ",")).alias("wrong"))
    return out.where("status is not null")


def ordered(expected: DataFrame, actual: DataFrame, place: str) -> DataFrame:
    """Positional comparison by an ordinal field."""
    return keyed(expected, actual, [place])


def placed(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """df with each row's place, from 1, in the given order."""
    return numbered(df, order, "__row").withColumn(place, F.col("__row") + 1).drop("__row")


def transitions(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    a, b = before.select(key, F.col(label).alias("before")), after.select(key, F.col(label).alias("after"))
    return a.join(b, key, "full").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def run_metrics(results: DataFrame, category: str, label: str, seconds: str, right: str = "MATCH") -> DataFrame:
    """Per category and in total: questions, right answers, their share, mean and median time."""
    ok = F.sum(F.when(F.col(label) == right, 1).otherwise(0))
    n = F.count(F.lit(1))
    out = results.rollup(category).agg(n.alias("n"), ok.alias("right"), (ok / n).alias("share"), F.avg(seconds).alias("mean_s"), F.median(seconds).alias("median_s"))
    return out.withColumn(category, F.coalesce(category, F.lit("all")))


def systematic(df: DataFrame, every: int, start: int, order: list[str]) -> DataFrame:
    """Every n-th row from a start (1-based) in the given order."""
    rows = numbered(df, [F.col(c) for c in order], "__row")
    return rows.where((F.col("__row") >= start - 1) & ((F.col("__row") - (start - 1)) % every == 0)).select(*df.columns)


#: Shares of the combined score, and the least score of each label.
LEXICAL, TOPIC, INTENT = 0.50, 0.35, 0.15
LABELS = ((0.90, "near duplicate"), (0.75, "very similar"), (0.60, "similar"), (0.45, "somewhat similar"))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two lists; 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


#: Texts of a block of the left and of the right side: a task compares one block with another.
LEFT_BLOCK, RIGHT_BLOCK = 16, 4096


def similar(left: DataFrame, right: DataFrame, id: str, text: str, k: int = 3, topics: str | None = None, intents: str | None = None) -> DataFrame:
    """For each left text the k most similar right texts; each left text is compared with every right text, block by block.

    Lexical score: 0.65 of the sequence ratio and 0.35 of the words' Jaccard. With list columns of topics and intents the
    score is the weighted sum of the lexical score and their overlaps, and a label goes with it. A text without words has
    neither lexical score nor topic. The window's group limit keeps a task's k best of each left text before the shuffle.
    The work is the product of both sides: left is meant as a set of queries.
    """
    extra = [c for c in (topics, intents) if c]

    def words(df: DataFrame, side: str, block: int) -> DataFrame:
        clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
        out = df.select(F.col(id).alias(f"{side}_id"), clean.alias(side), F.array_distinct(F.split(clean, " ")).alias(f"{side}_words"), *[F.col(c).alias(f"{side}_{c}") for c in extra])
        return out.repartition(max(1, -(-df.count() // block)))

    full = words(left, "l", LEFT_BLOCK).crossJoin(words(right, "r", RIGHT_BLOCK).hint("shuffle_replicate_nl"))

    @F.pandas_udf("double")
    def ratio(a: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in a:
            yield pd.Series([SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y, strict=True)])

    worded = (F.col("l") != "") & (F.col("r") != "")
    shared = F.size(F.array_intersect("l_words", "r_words"))
    lexical = F.when(worded, 0.65 * ratio("l", "r") + 0.35 * shared / (F.size("l_words") + F.size("r_words") - shared)).otherwise(0.0)
    by = {name: overlap(F.col(f"l_{c}"), F.col(f"r_{c}")) if c else F.lit(0.0) for name, c in (("topic", topics), ("intent", intents))}
    by["topic"] = F.when(worded, by["topic"]).otherwise(0.0)
    scored = full.select("l_id", "r_id", lexical.alias("lexical"), *[v.alias(n) for n, v in by.items()])
    score = LEXICAL * F.col("lexical") + TOPIC * F.col("topic") + INTENT * F.col("intent") if extra else F.col("lexical")
    label = F.when((F.col("score") >= 0.35) & (F.col("topic") >= 0.35) & (F.col("intent") > 0), "related").otherwise("different")
    for least, name in reversed(LABELS):
        label = F.when(F.col("score") >= least, name).otherwise(label)
    w = Window.partitionBy("l_id").orderBy(F.desc("score"), "r_id")
    ranked = scored.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("label", label)
