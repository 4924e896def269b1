"""Toxicity: a convolutional text classifier in numpy.

Words (runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased) are hashed into BUCKETS embeddings; filters
of 1, 2 and 3 words run over the sequence, each filter's maximum over the text feeds a logistic output. All weights start
from small random numbers and are learnt by gradients only: Adam on filters and outputs, Adagrad on the embeddings that a
batch's maxima touch, dropout on the pooled values. RESTARTS nets are trained and the one of least calibration loss stays.
A text's score is summed in a fixed order, so that it depends neither on the batch nor on the processor's product kernels.

Training takes a bounded sample, each net in a task of its own. The bounds are parameters: the first rows of each class in order of a
hash of doc_id and text, at most SAMPLE_PER_CLASS of them and SAMPLE_BYTES bytes of whole texts (a text over a quarter of
SAMPLE_BYTES can't be in the sample). A further sample of CALIBRATION_ROWS, in natural proportion and of as many bytes,
sets the scale of the score (Platt). Thresholds come from every labelled row of the calibration part, texts of any length
whole: Spark scores them and counts them by language and bin of the score's log-odds, and each language takes its best F1
between bins (languages with fewer than MIN_POSITIVE toxic rows take the common one). Scores read the text only; lang only
picks a threshold.

Defined cases: a null or empty text is scored by the biases alone; a null doc_id is never held out; a doc_id of several
documents labels each of them; without labels of both classes every score is the smoothed share of toxic labels and
nothing is rejected; repeated rows score alike; other columns pass through, and `prefix` sets the result's apart from
columns of the same name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, clear_prefix, drop_tables, materialise, table
from .decontamination import cleaned

BUCKETS = 1 << 20
DIMENSIONS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
SAMPLE_PER_CLASS, CALIBRATION_ROWS, SAMPLE_BYTES = 3000, 4000, 12 << 20
EPOCHS, BATCH_DOCS, RESTARTS, MIN_POSITIVE = 12, 32, 3, 20
DROPOUT, EMBED_RATE, EMBED_DECAY, RATE, DECAY = 0.2, 0.02, 1e-3, 0.01, 1e-4
#: Bins of the log-odds, which the scores' six digits keep within 14.6 of zero.
BINS_PER_LOGIT = 100
#: Bytes hashed and words pooled at once.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 1 << 15
_P = 0x100000001B3  # FNV-64's prime, odd, so that it has an inverse modulo 2**64


class Powers:
    """p**i and p**-i modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            n = max(n, 1 << 16)
            grow = lambda p: np.cumprod(np.array([1] + [p] * (n - 1), np.uint64), dtype=np.uint64)
            self.up, self.down = grow(_P), grow(pow(_P, -1, 1 << 64))
        return self.up, self.down


_POWERS = Powers()


def hashed(clean: bytes) -> np.ndarray:
    """Buckets of the words of cleaned bytes: polynomial hashes from one running sum."""
    a = np.frombuffer(b" " + clean + b" ", np.uint8)
    word = a != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.to(len(a))
    total = np.cumsum(a * up[: len(a)], dtype=np.uint64)
    h = (total[end - 1] - total[start - 1]) * down[start]
    return finished(h)


def finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
    return (h >> np.uint64(44)).astype(np.int32) % BUCKETS


def long_word(word: bytes) -> np.ndarray:
    """Bucket of one word, hashed piece by piece as hashed() does."""
    total, power = 0, 1
    up = _POWERS.to(PIECE_BYTES)[0][:PIECE_BYTES]
    for at in range(0, len(word), PIECE_BYTES):
        a = np.frombuffer(word, np.uint8, min(PIECE_BYTES, len(word) - at), at)
        total += power * int((a * up[: len(a)]).sum(dtype=np.uint64))
        power = power * pow(_P, PIECE_BYTES, 1 << 64) % (1 << 64)
    return finished(np.array([total % (1 << 64)], np.uint64))


def word_buckets(text: str | None) -> list[np.ndarray]:
    """The text's word buckets in pieces of at most PIECE_BYTES, cut between words; a longer word is a piece of its own."""
    clean, pieces, at = cleaned(text), [], 0
    while len(clean) - at > PIECE_BYTES:
        cut = clean.rfind(b" ", at + 1, at + PIECE_BYTES)
        if cut > 0:
            pieces.append(hashed(clean[at:cut]))
        else:
            cut = clean.find(b" ", at + PIECE_BYTES)
            cut = cut if cut > 0 else len(clean)
            pieces.append(long_word(clean[at:cut].strip(b" ")))
        at = cut
    return [*pieces, hashed(clean[at:])]


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Docs one after the other, two pads before each and after the last; where each doc's pads begin."""
    pad = np.full(max(WIDTHS) - 1, BUCKETS, np.int32)
    start = np.cumsum([0, *(len(d) + len(pad) for d in docs)])[:-1]
    return np.concatenate([x for d in docs for x in (pad, d)] + [pad]), start


def peaks(x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each column's maximum over each doc's rows, and the first row where it stands."""
    peak = np.maximum.reduceat(x, start, axis=0)
    doc = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
    at = np.zeros(peak.shape, np.int64)
    where, column = np.nonzero(x == peak[doc])
    at[doc[where[::-1]], column[::-1]] = where[::-1]
    return peak, at


def fixed_product(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights with the sums in one order whatever the processor: a row's result is its own in any batch."""
    out = x[:, :1] * weights[0]
    for k in range(1, len(weights)):
        out += x[:, k : k + 1] * weights[k]
    return out


class Classifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.standard_normal((BUCKETS + 1, DIMENSIONS), np.float32)
        self.embed *= np.float32(0.01)
        self.embed[BUCKETS] = 0
        self.filters = [rng.normal(0, 0.4 / np.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.shift, self.scale, self.seed = np.float32(0), (1.0, 0.0), seed

    def __getstate__(self) -> dict:
        """What training has changed: the other embeddings come from the seed again, so a net travels as a few megabytes."""
        moved = np.flatnonzero((self.embed != Classifier(self.seed).embed).any(axis=1))
        return self.__dict__ | {"embed": (moved, self.embed[moved])}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["seed"])
        at, rows = state.pop("embed")
        self.__dict__.update(state)
        self.embed[at] = rows

    def responses(self, seq: np.ndarray) -> np.ndarray:
        """(positions, filters) before bias, for every window's first position.

        Each bucket is multiplied with each row of the filters once, dimension by dimension, then gathered and added along the
        windows: sums of fixed order, so that a window's response doesn't depend on what stands around it in the batch.
        """
        n = len(seq) - max(WIDTHS) + 1
        buckets, at = np.unique(seq, return_inverse=True)
        words = self.embed[buckets]
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            part = out[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                product = fixed_product(words, self.filters[k][j])[at[j : j + n]]
                if j:
                    part += product
                else:
                    part[:] = product
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return fixed_product(np.maximum(pooled + self.bias, 0), self.out[:, None])[:, 0] + self.shift

    def pooled(self, texts) -> np.ndarray:
        """Largest response of each filter over each whole text."""
        out = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        held: list[np.ndarray] = []
        owner: list[int] = []
        pad = np.full(max(WIDTHS) - 1, BUCKETS, np.int32)

        def flush():
            end = np.cumsum([len(h) for h in held])
            start = end - [len(h) for h in held]
            spans = np.column_stack([start, end - len(pad)]).ravel()[:-1]  # windows across two parts belong to none
            np.maximum.at(out, owner, np.maximum.reduceat(self.responses(np.concatenate(held)), spans, axis=0)[::2])
            held.clear()
            owner.clear()

        words = 0
        for i, text in enumerate(texts):
            pieces, before = word_buckets(text), pad
            for k, piece in enumerate(pieces):
                part = np.concatenate([before, piece, pad] if k == len(pieces) - 1 else [before, piece])
                before = part[-len(pad) :]  # the next piece's first windows begin here
                if len(part) == len(pad):
                    continue
                held.append(part)
                owner.append(i)
                words += len(piece)
                if words >= PIECE_WORDS:
                    flush()
                    words = 0
        if held:
            flush()
        return out

    def scores(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        a, b = self.scale
        z = a * self.logit(self.pooled(texts)).astype(np.float64) + b
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)  # six digits, which bound the bins of the log-odds

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> None:
        """Gradient steps on weighted log-loss, both classes weighing the same; rates fall to zero over the epochs."""
        rng, n = np.random.default_rng(seed), len(docs)
        params = [*self.filters, self.bias, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        gathered = np.full((BUCKETS + 1, 1), 1e-6, np.float32)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        step = 0
        for epoch in range(epochs):
            order, pace = rng.permutation(n), 1 - epoch / epochs
            for i in range(0, n, BATCH_DOCS):
                own = order[i : i + BATCH_DOCS]
                seq, start = laid_out([docs[k] for k in own])
                x = self.responses(seq)
                peak, at = peaks(x, start)
                kept = (rng.random(peak.shape) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
                hidden = np.maximum(peak + self.bias, 0) * kept
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30)))
                error = ((p - labels[own]) * weight[own] / len(own)).astype(np.float32)
                back = error[:, None] * self.out * (hidden > 0) * kept
                grads, to, change = [], [], []
                for k, w in enumerate(WIDTHS):
                    g, t = back[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS]
                    grad = np.empty_like(self.filters[k])
                    for j in range(w):
                        ids = seq[t + j]
                        grad[j] = np.einsum("bf,bfd->df", g, self.embed[ids])
                        to.append(ids.ravel())
                        change.append((g[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIMENSIONS))
                    grads.append(grad)
                grads += [back.sum(axis=0), error @ hidden]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    g = g + DECAY * q
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
                self.shift -= np.float32(0.05 * pace * error.sum())
                ids, inverse = np.unique(np.concatenate(to), return_inverse=True)
                g = np.zeros((len(ids), DIMENSIONS), np.float32)
                np.add.at(g, inverse, np.concatenate(change))
                gathered[ids] += (g * g).mean(axis=1, keepdims=True)
                self.embed[ids] -= EMBED_RATE * pace * (g / np.sqrt(gathered[ids])) + EMBED_DECAY * self.embed[ids]
                self.embed[BUCKETS] = 0

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Platt's scale by Newton steps with smoothed targets."""
        pos, neg = labels.sum(), (1 - labels).sum()
        if not pos or not neg:
            return
        target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * logits).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = np.array([[(w * logits * logits).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum()]])
            move = np.linalg.solve(h + 1e-9 * np.eye(2), g)
            move *= min(1, 2 / max(np.abs(move).max(), 1e-9))
            a, b = a - move[0], b - move[1]
        self.scale = (float(max(a, 1e-3)), float(b))

    def loss(self, logits: np.ndarray, labels: np.ndarray) -> float:
        """Mean log-loss at the calibrated scale."""
        a, b = self.scale
        z = np.clip(a * logits + b, -30, 30)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z)) if len(z) else 0.0


def best_threshold(bins: list, default: float = 0.5) -> float:
    """The threshold nearest to the default among those whose F1 is within 0.01 of the best.

    Bins (least, most, rows, toxic) don't overlap; a threshold lies between neighbouring ones, so that its F1 is exact.
    """
    bins = sorted(bins, reverse=True)
    least, most, rows, toxic = np.array(bins, np.float64).reshape(-1, 4).T
    if not toxic.sum():
        return default
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(rows) + toxic.sum())
    good = np.flatnonzero(f1 >= f1.max() - 0.01)
    below = np.append(most[1:], 0)[good]
    cut = np.clip(default, (below + least[good]) / 2, least[good])
    return float(cut[np.abs(cut - default).argmin()])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """Rows (doc_id, label, part) outside the held-out part; rows of part 1 are for calibration."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return rows.withColumn("part", part())


def part():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def with_lang(docs: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select("doc_id", F.col("text"), lang.cast("string").alias("lang"))


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Bounded rows (doc_id, t, text, label, part) for the fit: the first rows of each class and of the calibration part.

    Order is by a hash of doc_id and text. Lengths and hashes are joined first, and only the chosen rows' texts travel:
    at most 2 * SAMPLE_PER_CLASS + CALIBRATION_ROWS rows of 3 * SAMPLE_BYTES bytes. Equal rows count once.
    """
    known = docs.where("doc_id is not null").where(~held_out()).select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    known = known.where(F.col("size") <= SAMPLE_BYTES // 4).groupBy("doc_id", "t").agg(F.max("size").alias("size"))
    rows = materialise(known.join(labelled(labels, label), "doc_id").withColumn("h", F.xxhash64("doc_id", "t")), "toxicity-known")
    order = ["h", "doc_id", "t"]

    def first(few: DataFrame, count: int) -> DataFrame:
        few = few.orderBy(*order).limit(count)  # at most `count` rows, without texts, in the window below
        before = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return few.withColumn("bytes", before).where(F.col("bytes") <= SAMPLE_BYTES).drop("bytes")

    picked = [first(rows.where((F.col("part") != 1) & (F.col("label") == k)), SAMPLE_PER_CLASS) for k in (0, 1)]
    picked.append(first(rows.where(F.col("part") == 1), CALIBRATION_ROWS))
    ids = picked[0].unionByName(picked[1]).unionByName(picked[2]).select("doc_id", "t", "label", "part")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(ids), ["doc_id", "t"])
    return texts.groupBy("doc_id", "t").agg(F.any_value("text").alias("text"), F.max("label").alias("label"), F.max("part").alias("part"))


def histogram(docs: DataFrame, labels: DataFrame, label: str, score, calibration: bool = True) -> list:
    """Rows (lang, least, most, rows, toxic) by language and bin over all labelled rows of the calibration part, or of all parts.

    Lang is null in the rows over all languages; a language of its own has MIN_POSITIVE toxic rows. Texts are scored before
    the join, so that they aren't shuffled. The collected rows are at most the bins times the languages.
    """
    texts, marks = with_lang(docs).where("doc_id is not null").where(~held_out()), labelled(labels, label)
    if calibration:
        texts, marks = texts.where(part() == 1), marks.where("part = 1")
    scored = texts.select("doc_id", "lang", score.alias("score")).join(marks.select("doc_id", "label"), "doc_id")
    odds = F.least(F.greatest("score", F.lit(5e-7)), F.lit(1 - 5e-7))
    bins = scored.groupBy("lang", F.floor(F.log(odds / (1 - odds)) * BINS_PER_LOGIT).alias("bin")).agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("toxic"))
    bins = materialise(bins, "toxicity-bins")
    enough = bins.where("lang is not null").groupBy("lang").agg(F.sum("toxic").alias("all")).where(F.col("all") >= MIN_POSITIVE).select("lang")
    every = bins.groupBy("bin").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))
    shape = ["lang", "least", "most", "rows", "toxic"]
    return bins.join(enough, "lang").select(*shape).unionByName(every.withColumn("lang", F.lit(None).cast("string")).select(*shape)).collect()


def trained(rows: DataFrame) -> Classifier:
    """The net of least calibration loss of RESTARTS, each of which is fitted on the whole sample in a task of its own.

    The driver gets the losses and the best net only.
    """

    def fit(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        k, own = int(key[0]), own.sort_values(["doc_id", "t"])
        train, rest = own[own["part"] != 1], own[own["part"] == 1]
        rest = rest if len(rest) else train
        z, texts = rest["label"].to_numpy(np.float64), list(rest["text"])
        net = Classifier(seed=7 + k)
        net.fit([np.concatenate(word_buckets(t)) for t in train["text"]], train["label"].to_numpy(np.float64), seed=11 + k)
        logits = net.logit(net.pooled(texts)).astype(np.float64)
        net.calibrate(logits, z)
        return pd.DataFrame({"k": [k], "loss": [net.loss(logits, z)], "net": [pickle.dumps(net)]})

    copies = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(RESTARTS)])))
    nets = materialise(copies.groupBy("k").applyInPandas(fit, "k int, loss double, net binary"), "toxicity-nets")
    best = nets.select("k", "loss").orderBy("loss", "k").first()  # RESTARTS rows
    net = nets.where(F.col("k") == best.k).select("net").first().net
    drop_tables(nets)
    return pickle.loads(net)


class Model:
    """Classifier or constant, and a threshold for each language; fitted on a sample."""

    def __init__(self, rows: DataFrame):
        seen = {(r.train, r.label): r.n for r in rows.groupBy((F.col("part") != 1).alias("train"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.prior = float((sum(n for (_, label), n in seen.items() if label) + 1) / (sum(seen.values()) + 2))
        self.net, self.thresholds, self.default = None, {}, float("inf")
        if (True, 0) in seen and (True, 1) in seen:
            self.default = 0.5
            self.net = trained(rows)

    def set_thresholds(self, bins: list) -> None:
        own: dict[str | None, list] = {}
        for r in bins:
            own.setdefault(r.lang, []).append((r.least, r.most, r.rows, r.toxic))
        cuts = {lang: best_threshold(rows) for lang, rows in own.items()}
        self.default = cuts.pop(None, self.default)
        self.thresholds = cuts

    def threshold(self, lang):
        out = F.lit(self.default)
        for k, v in sorted(self.thresholds.items()):
            out = F.when(lang.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
        return out


def score_column(spark: SparkSession, model: Model, text: str = "text"):
    bounded_batches(spark)
    if model.net is None:
        return F.lit(model.prior)
    shared = spark.sparkContext.broadcast(model.net)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.scores(list(batch)))

    return scores(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
    """docs with score, threshold (its language's) and rejected."""
    rows = materialise(sample(docs, labels, "toxic"), "toxicity-sample")
    model = Model(rows)
    drop_tables(rows)
    score = score_column(docs.sparkSession, model)
    if model.net is not None:
        model.set_thresholds(histogram(docs, labels, "toxic", score) or histogram(docs, labels, "toxic", score, calibration=False))
    out = docs.withColumn(prefix + "score", score)
    out = out.withColumn(prefix + "threshold", model.threshold(F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")))
    return out.withColumn(prefix + "rejected", F.col(prefix + "score") >= F.col(prefix + "threshold"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents below their language's threshold, with their columns."""
    prefix = clear_prefix(docs, "score", "threshold", "rejected")
    return classify(docs, table(spark, sf_dir, "labels"), prefix).where(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")
