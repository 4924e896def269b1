"""Vector code compression: each vector becomes a code of one codebook index for each of its parts.

Components become integers floor(SCALE * x) and vectors are cut into PARTS consecutive parts. Equal parts at one position are
one weighted row; Lloyd's rounds run over these distinct rows only, whose nearest entries numpy finds in tasks, and a task
sends one sum for each entry and component. Codes and errors of the distinct rows are then joined back to the vectors: rows
that hold more than a thousandth of a position's vectors (a thousand a position at most, so that they may be broadcast) are
looked up in place, the others by a shuffle, so that no part that many vectors share is one task. Only codebooks, of ENTRIES
rows of one vector's numbers each, are on the driver.

Integers are exact throughout; sums are decimals. A tie goes to the lower index, an entry without rows stays as it is.

Defined cases: a null vector, and one with null or non-finite components, is dropped; shorter vectors are filled up with
zeros to the longest one's length, and all to a multiple of PARTS; components beyond the bound that keeps a vector's error
within 62 bits (2**28 for 16 components, 2**27 for 64) count as that bound; the first codebook takes ids in ascending order,
nulls last, rows of one id in the order of their integers; fewer vectors than ENTRIES give fewer entries; repeated rows are
rows of their own; a label's error is over all rows of the label, null labels together, and stops at 2**63 - 1; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A key of more than this share of all rows, and of HEAVY_ROWS rows, is looked up in place.
HEAVY_SHARE, HEAVY_ROWS = 1000, 10_000
#: Numbers compared at once in a task.
AT_ONCE = 1 << 21
_TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Coded:
    """rows: vec_id, label, codes (a list of indexes), error. books: (part, entry, component) integers."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decoded(self, scale: float = SCALE) -> DataFrame:
        """rows with `approximation`, the vector that the code stands for: each component at the middle of its step."""
        spark = self.rows.sparkSession
        books = F.broadcast(spark.createDataFrame([(self.books.tolist(),)], "__books array<array<array<long>>>"))  # one row, as large as the codebooks
        parts = F.transform("codes", lambda c, i: F.get(F.get("__books", i), c))
        near = F.transform(F.flatten(parts), lambda x: (x + F.lit(0.5)) / F.lit(float(scale)))
        return self.rows.join(books).withColumn("approximation", near).drop("__books")


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return v.isNotNull() & ~bad


def integers(embeddings: DataFrame, id: str, vector: str, label: str, parts: int, scale: float) -> tuple[DataFrame, int, int]:
    """Rows (row, vec_id, label, parts list of lists of ints), their number and the length of a part."""
    v = F.col(vector).cast("array<double>")
    rows = embeddings.select(F.col(id).alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where(usable(F.col("v")))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, -(-(longest or 0) // parts))
    bound = 1 << int(math.log2(math.sqrt(2**61 / (width * parts))))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))), F.lit(bound)), F.lit(-bound)).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("w", i * width + 1, F.lit(width)))
    cells = rows.withColumn("w", filled).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", cut.alias("parts"))
    return materialise(cells, "codes-parts"), n, width


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the first of equals."""
    code, error = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    step = max(1, AT_ONCE // book.size)
    for at in range(0, len(v), step):
        d = ((v[at : at + step, None, :] - book[None]) ** 2).sum(axis=2)
        code[at : at + step] = d.argmin(axis=1)
        error[at : at + step] = d.min(axis=1)
    return code, error


def assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, ...]:
    """part, values, count, code and error of a batch of distinct rows (part, values, n)."""
    part, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(len(part), books.shape[2])
    code, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        code[own], error[own] = nearest(v[own], books[p])
    return part, v, n, code, error


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry is the floor of its rows' weighted mean, by component."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)
    width = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            part, v, n, code, _ = assigned(batch, shared.value)
            x = np.column_stack([n, v * n[:, None]]) if len(n) and int(n.max()) * int(np.abs(v).max(initial=1)) * len(n) < 1 << 62 else np.column_stack([n.astype(object), v.astype(object) * n[:, None]])
            keys, inverse = np.unique(part.astype(np.int64) * (1 << 32) + code, return_inverse=True)
            s = np.zeros((len(keys), width + 1), x.dtype)
            np.add.at(s, inverse, x)
            for k, row in zip(keys.tolist(), s.tolist(), strict=True):
                held = total.setdefault((k >> 32, k & 0xFFFFFFFF), [0] * (width + 1))
                held[:] = [a + b for a, b in zip(held, row, strict=True)]
        rows = [(p, c, j, Decimal(s)) for (p, c), values in total.items() for j, s in enumerate(values)]
        if rows:
            types = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "code", "j", "s"])

    summed = distinct.mapInArrow(sums, "part int, code int, j int, s decimal(38,0)").groupBy("part", "code", "j").agg(F.sum("s").alias("s"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in summed.collect():  # no more rows than the codebooks have numbers and entries
        found.setdefault((r.part, r.code), {})[r.j] = int(r.s)
    out = books.copy()
    for (p, c), s in found.items():
        out[p, c] = [s[j + 1] // s[0] for j in range(width)]
    return out


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with lookup's columns; lookup has one row a key, and `n`, the key's number of rows of `total` in its group.

    Keys of many rows, HEAVY_SHARE a group at most, are broadcast; rows of the others meet theirs in a shuffle.
    """
    heavy = F.col("n") > max(HEAVY_ROWS, total // HEAVY_SHARE)
    named = lookup.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in lookup.columns if c not in keys])
    extra = [c for c in lookup.columns if c not in (*keys, "n")]
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(named[f"__{k}"])
    if not lookup.where(heavy).limit(1).count():
        return rows.join(named, on).select(*rows.columns, *extra)
    tried = rows.join(F.broadcast(named.where(heavy)), on, "left")
    hit = tried.where("n is not null").select(*rows.columns, *extra)
    rest = tried.where("n is null").select(*rows.columns)
    return hit.unionByName(rest.join(named.where(~heavy), on).select(*rows.columns, *extra))


def compress(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Coded:
    """Codes and errors of all usable vectors, and the codebooks they refer to."""
    bounded_batches(embeddings.sparkSession, 8192)
    cells, n, width = integers(embeddings, id, vector, label, parts, scale)
    first = cells.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = np.array([r.parts for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    exploded = cells.select("row", "vec_id", "label", F.posexplode("parts").alias("part", "values"))
    distinct = materialise(exploded.groupBy("part", "values").agg(F.count(F.lit(1)).alias("n")), "codes-distinct")
    if n:
        for _ in range(rounds):
            books = moved(distinct, books)
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, code, error = assigned(batch, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array(error, pa.int64())], ["part", "values", "n", "code", "err"])

    assigned_rows = distinct.mapInArrow(final, "part int, values array<int>, n long, code int, err long")
    found = materialise(assigned_rows, "codes-found")
    met = looked_up(exploded, found, ["part", "values"], n)
    codes = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda s: s["code"])
    rows = met.groupBy("row", "vec_id", "label").agg(codes.alias("codes"), F.sum("err").alias("error")).drop("row")
    return Coded(rows, books)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Rows with label_error, the error summed over all rows of equal labels."""
    rows = materialise(coded, "codes-rows")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("long")
    sums = materialise(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), total.alias("label_error")), "codes-labels")
    return looked_up(rows, sums, [label], rows.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    found = with_label_error(coded.rows)
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    return f"""
a{k} as (select c.vec_id, c.p, min(struct_pack(d := list_sum(list_transform(list_zip(c.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := b.k)) as m
  from cells c join b{k} b on b.p = c.p group by 1, 2)"""


def _books(k: int) -> str:
    return f"""
s{k} as (select a.p, a.m.k as k, j, sum(c.v[j]) as s, count(*) as n from a{k} a join cells c on c.vec_id = a.vec_id and c.p = a.p, (select unnest(range(1, 5)) as j) group by 1, 2, 3),
b{k + 1} as (select b.p, b.k, list(coalesce(cast((s.s - ((s.s % s.n) + s.n) % s.n) // s.n as bigint), b.e[j]) order by j) as e
  from b{k} b cross join (select unnest(range(1, 5)) as j) left join s{k} s using (p, k, j) group by 1, 2)"""


#: For vectors of 64 components with distinct ids, as the tables have them.
SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (select vec_id, p, w[p * 4 + 1 : p * 4 + 4] as v from kept, (select unnest(range(0, 16)) as p)),
b0 as (select p, k, v as e from cells join (select vec_id, row_number() over (order by vec_id) - 1 as k from kept qualify k < 64) using (vec_id)),{_round(0)},{_books(0)},{_round(1)},{_books(1)},{_round(2)},
f as (select vec_id, string_agg(printf('%02x', m.k), '' order by p) as code, cast(sum(m.d) as bigint) as error from a2 group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(e, ','), ',' order by p, k)) from b2) as codebooks_sha256
from f join kept using (vec_id)
"""
