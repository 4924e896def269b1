"""SimHash near-dedup by multi-index hashing.

A text is lower-cased (A-Z only), cut at white space into words and into word shingles, repeats included; a bit of the
64-bit fingerprint is 1 if it is set in over half the shingles' XXH64 values. Two fingerprints link at BITS or fewer
differing bits.

Index: a fingerprint is cut into two halves. Where two fingerprints differ in at most 4 bits, one half differs in at most
2, and then the balls of radius 1 around the two halves meet. So each distinct fingerprint is entered in a table under the
33 members of either half's ball, the tables' buckets are fetched, and the complete distance of the members is verified.
Within a bucket of many members a breadth-first search links them by a spanning tree, not by all pairs.

Entries travel as blocks of bytes (9 bytes an entry), dealt by a hash of the bucket; a task gets about TASK_BYTES of them.
Equal fingerprints are one entry, so a group of copies of any size costs one.

Defined cases: a null or blank text has fingerprint zero, which links like any other; a null doc_id counts for no
component's least id (a component of such rows only has a null component_id); repeated rows share their component; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, clear_prefix, components, materialise, table

SHINGLE = 4
BITS = 4
TASK_BYTES = 16 << 20
#: Distinct fingerprints whose entries are made and sorted at once.
BATCH = 20_000
#: Buckets up to this size are verified pair by pair, larger ones by search.
SMALL = 32

_BALL = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
#: XXH64's own second prime, used to spread buckets over tasks.
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many big-endian hashes set each bit, high bit first; bytes of 255 rows are summed eight at a time."""
    bits = np.unpackbits(hashes.view(np.uint8)).view(np.uint64).reshape(-1, 8)
    whole = len(bits) // 255 * 255
    lanes = bits[:whole].reshape(-1, 255, 8).sum(axis=1)
    rest = bits[whole:].sum(axis=0, keepdims=True)
    return np.concatenate([lanes, rest]).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, n)
    first, last = (ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), 50_000):
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(first[i : i + 50_000], last[i : i + 50_000], strict=True)], ">u8")
        total += bit_counts(hashes)
    return int(np.packbits(2 * total > len(first)).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE):
    """A Column: the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return prints(F.col(text))


def _buckets(prints: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The bucket that each fingerprint's entry number `which` (0 to 65) stands in."""
    high = which < 33
    half = np.where(high, prints >> np.uint64(32), prints & np.uint64(0xFFFFFFFF)) ^ _BALL[which % 33]
    return np.where(high, half | np.uint64(1 << 32), half)


def _enter(tasks: int):
    """fp rows -> rows (task, fps, entries): the blocks of entries."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.arange(66, dtype=np.uint8)
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held)
            for i in range(0, len(fps), BATCH):
                part = np.repeat(fps[i : i + BATCH], 66)
                entry = np.tile(which, len(part) // 66)
                task = ((_buckets(part, entry) * _MIX) >> np.uint64(33)) % np.uint64(tasks)
                order = np.argsort(task, kind="stable")
                cut = np.searchsorted(task[order], np.arange(tasks + 1, dtype=np.uint64))
                part, entry = part[order], entry[order]
                own = [k for k in range(tasks) if cut[k] < cut[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([part[cut[k] : cut[k + 1]].tobytes() for k in own], pa.binary()), pa.array([entry[cut[k] : cut[k + 1]].tobytes() for k in own], pa.binary())],
                    ["task", "fps", "entries"],
                )

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= BATCH:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return blocks


def near(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def spanning(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Breadth-first trees over distinct fingerprints, as pairs."""
    pairs, rest = [], fps
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            hit = near(rest, x, bits)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                pairs += [(int(x), int(y)) for y in found]
                queue.extend(found)
    return pairs


def verified(fps: np.ndarray, entries: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Linked pairs (n, 2) among the entries of one task: all of small buckets, trees of large ones."""
    buckets = _buckets(fps, entries)
    order = np.argsort(buckets, kind="stable")
    fps, buckets = fps[order], buckets[order]
    start = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    length = np.diff(np.append(start, len(buckets)))
    found = [np.zeros((0, 2), np.uint64)]
    shared = np.repeat((length > 1) & (length <= SMALL), length)
    small, where = fps[shared], buckets[shared]
    for step in range(1, SMALL):
        same = where[step:] == where[:-step]
        if not same.any():
            break
        a, b = small[:-step][same], small[step:][same]
        ok = near(a, b, bits)
        found.append(np.stack([a[ok], b[ok]], axis=1))
    for s, n in zip(start[length > SMALL], length[length > SMALL], strict=True):
        found.append(np.array(spanning(fps[s : s + n], bits), np.uint64).reshape(-1, 2))
    return np.unique(np.concatenate(found), axis=0)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of linked fingerprints among distinct(fp long), enough of them to connect all that link."""
    if bits > 4:
        raise ValueError("two halves with balls of radius 1 find up to 4 differing bits")
    tasks = max(1, -(-distinct.count() * 66 * 9 // TASK_BYTES))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(f, np.uint64), np.frombuffer(e, np.uint8)) for b in batches for f, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if held:
            pairs = verified(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), bits).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return distinct.mapInArrow(_enter(tasks), "task int, fps binary, entries binary").repartitionById(tasks, F.col("task")).mapInArrow(verify, "a long, b long")


def leaders(prints: DataFrame, least: Column, bits: int = BITS) -> DataFrame:
    """Rows (fp, leader): for each fingerprint the least value over its component, where least is an aggregate by minimum."""
    classes = materialise(prints.groupBy("fp").agg(least.alias("least")), "simhash-classes")
    nodes = components(links(classes.select("fp"), bits), "simhash-links")
    roots = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    linked = roots.join(classes, roots.node == classes.fp).select("fp", "root", "least")
    lead = linked.groupBy("root").agg(F.min("least").alias("component"))
    groups = classes.join(linked.join(lead, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("leader"))
    # written, so that both sides of the next join come straight from exchanges and a hot fingerprint's rows can be split
    return materialise(groups, "simhash-groups")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, fp long, component_id) for each document."""
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text, shingle).alias("fp")), "simhash")
    groups = leaders(prints, F.min("doc_id"), bits)
    return prints.join(groups, "fp", "left").select("doc_id", "fp", F.col("leader").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, of the least doc_id (rows without an id last), then of the least row number."""
    row = clear_prefix(docs, "row") + "row"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = materialise(numbered.select("doc_id", F.col(row).alias("row"), fingerprints(numbered, "text", SHINGLE).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    gone = prints.join(leaders(prints, first), "fp").where("row <> leader.row").select(F.col("row").alias(row))
    kept = numbered.join(materialise(gone, "simhash-gone"), row, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
