"""Tolerant comparison of multisets: a largest matching of expected and actual rows that are equal within the expected decimals.

An expected number with d decimals takes every actual number that rounds, half up, to it: an interval; one without decimals takes
itself; other values take equal trimmed text. Equality within decimals isn't transitive, so rows can't just be counted by value.

A field whose expected numbers all have the same number of decimals is an exact field: both sides are rounded to it. Equal
rows are one with a count. Exact fields make blocks, and in a block each mixed field cuts the rows into islands, runs of values
that no interval spans a gap of. What is left is matched by island: with one mixed field islands of one
interval and one value are pairs and one-sided islands have none, natively, and the others are matched by a sweep that gives each actual value
to the open interval that ends first, which is optimal on a line and holds one interval for each number of decimals at most;
with several by augmenting paths over the island's distinct rows, which one task holds.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import groupby, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.values import quoted

#: Decimals that are looked at; numbers with more are rounded to so many.
DECIMALS = 12
_WHOLE = "decimal(38,0)"


def _text(name: str) -> Column:
    return F.trim(quoted(name).cast("string"))


def _number(name: str) -> Column:
    return F.regexp_replace(_text(name), ",", "").try_cast(f"decimal(38,{DECIMALS})")


def _decimals(name: str) -> Column:
    """Digits after the point of a number as written; null for other text."""
    digits = F.length(F.regexp_extract(F.regexp_replace(_text(name), ",", ""), r"^[+-]?\d*\.(\d+)$", 1))
    return F.when(_number(name).isNotNull(), F.least(digits, F.lit(DECIMALS)))


def _power(exponent: Column) -> Column:
    """10 to the exponent, exactly."""
    return F.rpad(F.lit("1"), exponent + 1, "0").cast(_WHOLE)


def _units(name: str) -> Column:
    """The number in units of the last decimal looked at."""
    return (_number(name) * F.lit(10**DECIMALS).cast("decimal(13,0)")).cast(_WHOLE)


def rounded(name: str, digits: int) -> Column:
    """Half up to so many digits, as a whole number of that digit's units."""
    step = 10 ** (DECIMALS - digits)
    u = _units(name)
    return (F.signum(u) * F.floor((F.abs(u) + F.lit(step // 2)) / F.lit(step))).cast(_WHOLE) if step > 1 else u


def _exact(name: str, digits: int | None) -> Column:
    """A field's value as far as the comparison sees it: a number rounded, or text."""
    key = F.concat(F.lit("t"), _text(name))
    return key if digits is None else F.when(_number(name).isNotNull(), F.concat(F.lit("n"), (_units(name) if digits == 0 else rounded(name, digits)).cast("string"))).otherwise(key)


def _bounds(name: str) -> tuple[Column, Column]:
    """First and last actual value, in units, that an expected number takes."""
    d, u = _decimals(name), _units(name)
    half = F.when((d == 0) | (d == DECIMALS), F.lit(0).cast(_WHOLE)).otherwise((F.lit(5).cast("decimal(1,0)") * _power(F.greatest(F.lit(DECIMALS - 1) - d, F.lit(0)))).cast(_WHOLE))
    near, far = F.abs(u) - half, F.abs(u) + F.greatest(half - 1, F.lit(0).cast(_WHOLE))
    low = F.when(u > 0, near).when(u < 0, -far).otherwise(-far)
    return low.cast(_WHOLE), F.when(u > 0, far).when(u < 0, -near).otherwise(far).cast(_WHOLE)


def _side(df: DataFrame, fields: list[str], digits: dict[str, int | None], mixed: list[str], expected: bool) -> DataFrame:
    """Distinct rows: block, for each mixed field text, low, high and decimals, the count n, and the least row that it stands for."""
    exact = [f for f in fields if f not in mixed]
    columns = [F.to_json(F.array(*[_exact(f, digits[f]) for f in exact]), {"ignoreNullFields": "false"}).alias("block") if exact else F.lit("").alias("block")]
    for i, f in enumerate(mixed):
        low, high = _bounds(f) if expected else (_units(f), _units(f))
        number = _number(f).isNotNull()
        columns += [F.when(~number, _text(f)).alias(f"t{i}"), low.alias(f"low{i}"), high.alias(f"high{i}"), (_decimals(f) if expected else F.lit(None)).cast("int").alias(f"d{i}"), number.alias(f"number{i}")]
    row = F.struct(*[quoted(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    made = df.select(*columns, row.alias("row"))
    return made.groupBy(*[c for c in made.columns if c != "row"]).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).withColumn("expected", F.lit(expected))


def _islands(rows: DataFrame, mixed: int) -> DataFrame:
    """rows with `island` fields: two rows in different islands of a field can't be equal."""
    keys = ["block"]
    for i in range(mixed):
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        w = Window.partitionBy(*keys, f"number{i}", F.when(~F.col(f"number{i}"), F.col(f"t{i}"))).orderBy(low.asc_nulls_first(), high.asc_nulls_first())
        before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(before.isNull() | (low > before), 1).otherwise(0)
        marked = rows.withColumn("__new", fresh).withColumn("__at", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        name = F.when(F.col(f"number{i}"), F.concat(F.lit("n"), F.col("__at").cast("string"))).otherwise(F.concat(F.lit("t"), F.coalesce(F.concat(F.lit("="), F.col(f"t{i}")), F.lit(""))))
        rows = marked.withColumn(f"island{i}", name).drop("__new", "__at")
        keys.append(f"island{i}")
    return rows


def sweep(rows: Iterator[tuple[int, int, bool, int]]) -> Iterator[tuple[int, int]]:
    """(row's place, rows of it that are matched) for rows (low, high, expected, n) in the order of low, intervals first.

    Each value goes to the open interval that ends first; an interval is told when it is used up or its end has passed.
    """
    heap: list[list[int]] = []  # high, place, left, all
    for place, (low, high, expected, n) in enumerate(rows):
        while heap and heap[0][0] < low:
            _, at, left, whole = heapq.heappop(heap)
            yield at, whole - left
        if expected:
            heapq.heappush(heap, [high, place, n, n])
            continue
        left = n
        while left and heap:
            take = min(left, heap[0][2])
            left -= take
            heap[0][2] -= take
            if not heap[0][2]:
                _, at, _, whole = heapq.heappop(heap)
                yield at, whole
        yield place, n - left
    for _, at, left, whole in heap:
        yield at, whole - left


def augmented(cells: list[tuple[tuple, int]], points: list[tuple[tuple, int]]) -> tuple[list[int], list[int]]:
    """Matched numbers of weighted boxes ((low, high) by field) and points (value by field): a largest flow by shortest paths."""
    by_shape: dict[tuple, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, (box, _) in enumerate(cells):
        widths = tuple(None if isinstance(b, str) or b is None else b[1] - b[0] for b in box)
        by_shape[widths][tuple(b if isinstance(b, str) or b is None else b[0] for b in box)].append(k)
    starts = {w: [sorted({key[i] for key in held}) if x is not None else None for i, x in enumerate(w)] for w, held in by_shape.items()}
    edges: list[list[int]] = [[] for _ in cells]
    for p, (point, _) in enumerate(points):
        for widths, held in by_shape.items():
            ways = []
            for value, width, first in zip(point, widths, starts[widths], strict=True):
                if width is None:
                    ways.append([value])
                elif isinstance(value, str) or value is None:
                    ways.append([])
                else:
                    ways.append([x for x in _near(first, value - width, value)])
            for key in product(*ways):
                for k in held.get(key, ()):
                    edges[k].append(p)
    need, room = [n for _, n in cells], [n for _, n in points]
    flow: dict[tuple[int, int], int] = defaultdict(int)
    into: list[set[int]] = [set() for _ in points]
    while True:
        came: dict[int, int] = {}  # point -> cell that reached it
        via: dict[int, int] = {k: -1 for k, n in enumerate(need) if n}  # cell -> point that gives way
        queue, end = deque(via), None
        while queue and end is None:
            k = queue.popleft()
            for p in edges[k]:
                if p in came:
                    continue
                came[p] = k
                if room[p]:
                    end = p
                    break
                for other in into[p]:
                    if other not in via and flow[other, p]:
                        via[other] = p
                        queue.append(other)
        if end is None:
            break
        path, p = [], end
        while p != -1:
            k = came[p]
            path.append((k, p, via[k]))
            p = via[k]
        take = min([room[end], need[path[-1][0]], *[flow[k, q] for k, _, q in path if q != -1]])
        for k, p, q in path:
            flow[k, p] += take
            into[p].add(k)
            if q != -1:
                flow[k, q] -= take
        room[end] -= take
        need[path[-1][0]] -= take
    return [n - left for (_, n), left in zip(cells, need, strict=True)], [n - left for (_, n), left in zip(points, room, strict=True)]


def _near(values: list[int], low: int, high: int) -> list[int]:
    from bisect import bisect_left, bisect_right

    return values[bisect_left(values, low) : bisect_right(values, high)]


def matching(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (row, expected, n, matched): each distinct row, of which side, how many there are and how many have a partner.

    `row` has the fields as text, f0, f1, ...; of rows that the comparison can't tell apart the least stands for all.
    """
    fields = expected.columns
    told = expected.agg(*[f(_decimals(x)).alias(f"{n}{i}") for i, x in enumerate(fields) for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    digits = {x: told[f"a{i}"] for i, x in enumerate(fields)}
    mixed = [x for i, x in enumerate(fields) if told[f"a{i}"] != told[f"b{i}"]]
    rows = _side(expected, fields, digits, mixed, True).unionByName(_side(actual.select(*[quoted(f) for f in fields]), fields, digits, mixed, False))
    if not mixed:
        w = Window.partitionBy("block")
        other = F.coalesce(F.sum(F.when(~F.col("expected"), F.col("n"))).over(w), F.lit(0)), F.coalesce(F.sum(F.when(F.col("expected"), F.col("n"))).over(w), F.lit(0))
        return rows.select("row", "expected", "n", F.least("n", F.when(F.col("expected"), other[0]).otherwise(other[1])).alias("matched"))
    keys = ["block", *[f"island{i}" for i in range(len(mixed))]]
    cut = _islands(rows, len(mixed))
    shape = T.StructType([*[f for f in cut.schema if f.name in ("row", "expected", "n")], T.StructField("matched", T.LongType())])
    if len(mixed) == 1:
        flat = cut.select("row", "expected", "n", *keys, "low0", "high0").repartition(*keys)
        island = Window.partitionBy(*keys)
        of = lambda side: F.count(F.when(F.col("expected") == side, 1)).over(island)
        told = flat.withColumns({"__expected": of(True), "__actual": of(False), "__all": F.sum("n").over(island)})
        lone, pair = F.least("__expected", "__actual") == 0, (F.col("__expected") == 1) & (F.col("__actual") == 1)
        # an island of one interval and one value is a pair; both branches take the same columns, so that the exchange is shared
        met = F.when(lone | (F.col("low0") > F.col("high0")), 0).otherwise(F.least(F.col("n"), F.col("__all") - F.col("n"))).cast("long")
        plain = told.where(lone | pair).select("row", "expected", "n", met.alias("matched"))
        swept = told.where(~(lone | pair)).select("row", "expected", "n", *keys, "low0", "high0").sortWithinPartitions(*keys, "low0", F.desc("expected"), "high0")
        return plain.unionByName(swept.mapInPandas(_swept, shape))
    return cut.groupBy(*keys).applyInPandas(_flowed(len(mixed)), shape)


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for b in batches for r in b.itertuples(index=False))
    held = []
    for _, island in groupby(rows, lambda r: (r.block, r.island0)):
        known: dict[int, tuple] = {}

        def told(island=island, known=known):
            for place, r in enumerate(island):
                known[place] = (r.row, r.expected, r.n)
                number = not (r.low0 is None or pd.isna(r.low0))
                yield (int(r.low0), int(r.high0), r.expected, int(r.n)) if number else (0, 0, r.expected, int(r.n))

        for place, matched in sweep(told()):
            held.append((*known.pop(place), matched))
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=["row", "expected", "n", "matched"])
                held = []
    if held:
        yield pd.DataFrame(held, columns=["row", "expected", "n", "matched"])


def _flowed(mixed: int):
    def flow(island: pd.DataFrame) -> pd.DataFrame:
        cells, points = island[island["expected"]], island[~island["expected"]]

        def box(r: dict, i: int, whole: bool):
            if not r[f"number{i}"]:
                return r[f"t{i}"]
            return (int(r[f"low{i}"]), int(r[f"high{i}"])) if whole else int(r[f"low{i}"])

        told = lambda frame, whole: [(tuple(box(r, i, whole) for i in range(mixed)), int(r["n"])) for r in frame.to_dict("records")]
        a, b = augmented(told(cells, True), told(points, False))
        return pd.concat([cells[["row", "expected", "n"]].assign(matched=a), points[["row", "expected", "n"]].assign(matched=b)])

    return flow


def counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: matched, missing and extra rows of a largest matching."""
    m = matching(expected, actual)
    total = lambda c, side: F.coalesce(F.sum(F.when(F.col("expected") == side, c)), F.lit(0)).cast("long")
    left = F.col("n") - F.col("matched")
    return m.agg(total(F.col("matched"), True).alias("matched"), total(left, True).alias("missing"), total(left, False).alias("extra"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows without a partner: the fields as text, status (missing or extra) and how many of them."""
    m = matching(expected, actual).where("n > matched")
    return m.select(*[F.col(f"row.f{k}").alias(f) for k, f in enumerate(expected.columns)], F.when(F.col("expected"), "missing").otherwise("extra").alias("status"), (F.col("n") - F.col("matched")).alias("n"))
