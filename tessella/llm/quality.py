"""Quality: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

Each whole text gives a fixed list of statistics (STATISTICS). Standardised, they pass through COMPONENTS random cosines,
which approximate a Gaussian kernel. Every labelled row outside the held-out part takes part in the fit: each partition
sums its own normal equations (a matrix of COMPONENTS squared, of fixed size), TASKS tasks add these sums up, and only
their sums reach the driver. Rows of the calibration part (remainder 1) give an isotonic map from the raw score to the share
of quality: their raw scores are first counted into BINS equal bins, so pool-adjacent-violators works on a list of fixed
length. Each pooled block takes one further observation of the overall share, which keeps blocks of few rows off 0 and 1.

Defined cases: a null or empty text has all statistics zero and is scored like any other; a null doc_id is never held out;
without labels every score is 0.5, with labels of one class their smoothed share, and without rows for calibration the raw
score cut to 0 and 1; repeated rows score alike; other columns pass through, and `prefix` sets the score apart from a
column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialise, table
from .toxicity import fixed_product, held_out

STATISTICS = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "stop", "other_punctuation", "space", "newline", "non_ascii", "distinct_words", "distinct_lines", "line_length", "top_word"]
COMPONENTS, BANDWIDTH, RIDGE = 192, 3.0, 1e-3
TASKS, BINS = 64, 4096
#: Rows whose features are worked out at once.
BLOCK_ROWS = 1024
THRESHOLD = 0.3

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*@^~<>{}[]\\_=+",
    "bang": b"!?",
    "bar": b"|",
    "stop": b".,;:",
    "other_punctuation": b"\"'()/`-",
    "space": b" \t",
    "newline": b"\n\r",
    "non_ascii": bytes(range(128, 256)),
}
_CLASSES = np.zeros((256, len(_GROUPS)))
for _k, _bytes in enumerate(_GROUPS.values()):
    _CLASSES[list(_bytes), _k] = 1


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    words, lines = raw.lower().split(), raw.split(b"\n")
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    m = max(1, len(words))
    return [np.log1p(n), np.log1p(len(words)), min(n / m, 100.0), *shares.tolist(), len(count) / m, len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(count.values(), default=0) / m]


def statistics_column(docs: DataFrame, text: str = "text"):
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(t) for t in batch])

    return measure(F.col(text))


class Features:
    """Standardise, then cosines of random directions."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1)
        self.directions = rng.normal(0, 1 / BANDWIDTH, (len(mean), COMPONENTS - 1))
        self.phases = rng.uniform(0, 2 * np.pi, COMPONENTS - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """A row's features are sums of fixed order: they depend neither on its batch nor on the processor's product kernels."""
        out = np.ones((len(stats), COMPONENTS))
        for at in range(0, len(stats), BLOCK_ROWS):
            own = np.clip((stats[at : at + BLOCK_ROWS] - self.mean) / self.deviation, -8, 8)
            out[at : at + len(own), :-1] = np.sqrt(2 / (COMPONENTS - 1)) * np.cos(fixed_product(own, self.directions) + self.phases)
        return out


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to values in weighted squares: pool adjacent violators."""
    blocks: list[list[float]] = []  # value, weight, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def calibrated(shares: np.ndarray, weights: np.ndarray, prior: float) -> np.ndarray:
    """Isotonic shares, each block of equal ones drawn towards the prior by one observation, and made nondecreasing again."""
    fitted = isotonic(shares, weights)
    block = np.cumsum(np.concatenate([[0], fitted[1:] != fitted[:-1]]))
    mass = np.bincount(block, weights)[block]
    return isotonic((fitted * mass + prior) / (mass + 1), weights)


class Model:
    def __init__(self, features: Features | None, ridge: np.ndarray | None, at: np.ndarray, share: np.ndarray, constant: float):
        self.features, self.ridge, self.at, self.share, self.constant = features, ridge, at, share, constant

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fixed_product(self.features(stats), self.ridge[:, None])[:, 0]

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        out = np.interp(raw, self.at, self.share) if len(self.at) else np.clip(raw, 0, 1)
        return np.clip(out, 0, 1)


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in series]) if len(series) else np.zeros((0, len(STATISTICS)))


def fit(rows: DataFrame) -> Model:
    """rows(stats, label, part): every labelled row outside the held-out part, once."""
    spark = rows.sparkSession
    train, rest = rows.where("part <> 1"), rows.where("part = 1")
    each = range(len(STATISTICS))
    m = train.agg(F.count(F.lit(1)), F.avg("label"), *[f(F.get("stats", F.lit(k))) for f in (F.avg, F.stddev_pop) for k in each]).first()
    n, share = m[0], m[1]
    if not n:
        return Model(None, None, np.zeros(0), np.zeros(0), 0.5)
    constant = (n * share + 1) / (n + 2)
    if share in (0.0, 1.0):
        return Model(None, None, np.zeros(0), np.zeros(0), constant)
    mean, deviation = np.array(m[2:], np.float64).reshape(2, -1)
    features = Features(mean, deviation)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((COMPONENTS, COMPONENTS)), np.zeros(COMPONENTS)
        for batch in batches:
            z = features(_stack(batch["stats"]))
            a += z.T @ z
            b += z.T @ batch["label"].to_numpy(np.float64)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((COMPONENTS, COMPONENTS)), np.zeros(COMPONENTS)
        for batch in batches:
            for x, y in zip(batch["a"], batch["b"], strict=True):
                a += np.frombuffer(x).reshape(a.shape)
                b += np.frombuffer(y)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    shape = "a binary, b binary"
    parts = train.select("stats", "label").mapInPandas(sums, shape).repartition(TASKS).mapInPandas(added, shape)
    total = next(added(iter([parts.toPandas()])))  # TASKS rows of COMPONENTS squared numbers
    a, b = np.frombuffer(total["a"][0]).reshape(COMPONENTS, COMPONENTS), np.frombuffer(total["b"][0])
    ridge = np.linalg.solve(a / n + RIDGE * np.eye(COMPONENTS), b / n)
    model = Model(features, ridge, np.zeros(0), np.zeros(0), constant)
    binned = rest.select(F.col("label"), F.floor((F.least(F.lit(1.5), F.greatest(F.lit(-0.5), raw_column(model))) + 0.5) / 2 * BINS).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).orderBy("bin").collect()
    if binned:
        weight = np.array([r.n for r in binned], np.float64)
        model.at = (np.array([r.bin for r in binned]) + 0.5) / BINS * 2 - 0.5
        model.share = calibrated(np.array([r.share for r in binned], np.float64), weight, constant)
    return model


def raw_column(model: Model, stats: str = "stats"):
    @F.pandas_udf("double")
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(model.raw(_stack(s)))

    return raw(F.col(stats))


def score_column(model: Model, stats: str = "stats"):
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_stack(s)))

    return score(F.col(stats))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """Columns `keep` of docs (with doc_id) and prefix + score. The statistics are written once, so texts are read once."""
    name = fresh(docs, "__stats")
    stats = materialise(docs.select(*[F.col(f"`{c}`") for c in keep], statistics_column(docs, text).alias(name)), "quality")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    labelled = stats.select("doc_id", F.col(name).alias("stats")).join(marks, "doc_id")
    rows = materialise(labelled.select("stats", F.col("label").cast("double").alias("label"), (F.crc32(F.col("doc_id").cast("string")) % 5).alias("part")), "quality-labelled")
    return stats.select(*[F.col(f"`{c}`") for c in keep], score_column(fit(rows), name).alias(prefix + "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
