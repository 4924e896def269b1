"""URL filter: rules first, then the ratio of two character language models, with DataFrame and SQL functions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule wins. URLs that a rule decides are the models' examples, allowed and blocked, each as often as it occurs. A model
is a variable-order Markov model over the characters of host and path: the probability after a context of k characters
is (count + STRENGTH * the probability after k - 1) / (context's count + STRENGTH), from order 0 to ORDER. Counts of both
models are exact, in a table by n-gram that grows with the input. A position's ratio depends on its n-gram of order ORDER
only, so the ratios are worked out once an n-gram and joined to the positions: few n-grams are broadcast, of more only
those that hold a share of all positions, and the rest is joined by shuffle. A url's score is its log-likelihood
difference a character. A fifth of the distinct examples,
held out of the counts, sets the threshold: the cut of least balanced error.

Defined cases: a null url or one without :// has empty host and path, and is scored as such; repeated rows have the same
verdict; without examples of both kinds the threshold allows all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, materialise, table

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
ORDER, STRENGTH, ALPHABET = 3, 2.0, 96
FOLDS, BINS_PER_NAT, BINS, TASK_URLS = 5, 50, 500, 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule's name and verdict, null where none fits. Rules are a short list: one branch each."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rh, rp, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """For each character and the end: it and the ORDER characters before it."""
    chars = F.concat(F.array_repeat(F.lit("^"), ORDER), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$")))
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def counted(positions: DataFrame) -> DataFrame:
    """Each n-gram of order ORDER at any position: its positions, and its counts in the allowed and the blocked examples."""
    example = lambda k: F.sum(F.when((F.col("verdict") == k) & ~F.col("held"), F.col("n")).otherwise(0))
    return positions.groupBy("gram").agg(F.count(F.lit(1)).alias("positions"), example("allow").alias("allow"), example("block").alias("block"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """Rows (gram, positions, ratio): for each n-gram of order ORDER the difference of its last character's log-probabilities."""
    kinds = ("allow", "block")
    sums = [F.sum(k).alias(k) for k in kinds]
    levels = [counts]  # n-grams of the orders 0 to ORDER
    for _ in range(ORDER):
        levels.insert(0, materialise(levels[0].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*sums), "url-grams"))
    total = levels[0].agg(*sums).first()
    p = levels[0].select("gram", *[((F.col(k) + 0.5) / (F.lit(float(total[k] or 0)) + 0.5 * ALPHABET)).alias(f"p_{k}") for k in kinds])
    for k in range(1, ORDER + 1):
        context, lower = F.substring("gram", 1, k), F.expr("substring(gram, 2)")
        contexts = materialise(levels[k].groupBy(context.alias("context")).agg(*[F.sum(v).alias(f"c_{v}") for v in kinds]), "url-contexts")
        joined = levels[k].withColumns({"context": context, "lower": lower}).join(bounded(contexts), "context").join(bounded(p.withColumnRenamed("gram", "lower")), "lower")
        p = joined.select("gram", *(["positions"] if k == ORDER else []), *[((F.col(v) + STRENGTH * F.col(f"p_{v}")) / (F.col(f"c_{v}") + STRENGTH)).alias(f"p_{v}") for v in kinds])
        p = materialise(p, "url-model")
    return p.select("gram", "positions", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def looked_up(positions: DataFrame, ratios: DataFrame) -> DataFrame:
    """Rows (id, ratio): one for each position. Fewer than BROADCAST_ROWS n-grams can hold more than one in BROADCAST_ROWS positions."""
    known = ratios.select("gram", "ratio")
    size = ratios.agg(F.count(F.lit(1)).alias("n"), F.sum("positions").alias("positions")).first()
    if size.n <= BROADCAST_ROWS:
        return positions.join(F.broadcast(known), "gram").select("id", "ratio")
    often = F.col("positions") * BROADCAST_ROWS > size.positions
    near = positions.join(F.broadcast(ratios.where(often).select("gram", "ratio")), "gram", "left")
    far = near.where("ratio is null").select("id", "gram").join(ratios.where(~often).select("gram", "ratio").hint("merge"), "gram")
    return near.where("ratio is not null").select("id", "ratio").unionByName(far.select("id", "ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the cut of least balanced error over the held-out examples, nearest to zero; null without both kinds.

    A cut lies between neighbouring bins that hold examples (or beyond the outermost ones), where it is nearest to zero.
    """
    held = scored.where("held and verdict is not null")
    bins = held.groupBy(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * BINS_PER_NAT))).cast("int").alias("bin")).agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allow"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("block"))
    last = bins.agg((F.max("bin") + 1).alias("bin"), F.lit(0).cast("long").alias("allow"), F.lit(0).cast("long").alias("block")).where("bin is not null")
    order, every = Window.orderBy("bin"), Window.partitionBy()  # at most 2 * BINS + 2 rows
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    error = F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.nullif(F.sum("allow").over(every), F.lit(0)) + 1 - F.coalesce(F.sum("block").over(below), F.lit(0)) / F.nullif(F.sum("block").over(every), F.lit(0))
    low = F.coalesce(F.lag("bin").over(order) + 1, F.lit(-BINS - 1))
    cuts = bins.unionByName(last).select((F.greatest(low, F.least(F.col("bin"), F.lit(0))) / BINS_PER_NAT).alias("cut"), error.alias("error"))
    return cuts.agg(F.min_by("cut", F.struct("error", F.abs("cut"))).alias("cut"), F.max("error").alias("error")).select(F.when(F.col("error").isNotNull(), F.col("cut")).alias("cut"))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score): one for each row of pages."""
    split = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    distinct = split.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    columns = {"rule": name, "verdict": verdict, "held": F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == 0, "id": F.monotonically_increasing_id()}
    distinct = materialise(distinct.withColumns(columns), "urls")
    tasks = max(1, -(-distinct.count() // TASK_URLS))
    positions = distinct.repartition(tasks, "id").select("id", "n", "verdict", "held", F.explode(grams(F.concat("host", "path"))).alias("gram"))
    ratios = log_ratios(materialise(counted(positions), "url-counts"))
    scores = looked_up(positions.select("id", "gram"), ratios).groupBy("id").agg(F.avg("ratio").alias("score"))
    scored = materialise(distinct.join(scores, "id"), "url-scores")
    cut = materialise(threshold(scored), "url-threshold")
    decided = scored.select("host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") >= F.coalesce(cut.scalar(), F.lit(float("-inf"))), "allow").otherwise("block")).alias("verdict"))
    return split.join(decided, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
