"""Conversation structure repair: the cheapest edits that give a conversation the roles `(system? (user assistant)+)?`.

Rows are kept, reroled to user or assistant, deleted (blank rows and repeats must be), and empty user or assistant rows are
inserted. A search node is (rows consumed, state of the roles so far); A* pops nodes by (cost + heuristic, audit), the audit
being the edits' initials so far. The heuristic is the suffix sum of what every continuation pays: mandatory deletions, and 3
for each truncated row, which either stays (3) or goes (4). It is consistent, so the first goal popped is the cheapest repair
and, of equally cheap ones, the one with the ASCII-least audit.

A conversation of up to LONG_ROWS rows and LONG_BYTES bytes is solved whole, streaming through a task that is sorted by
conversation. A longer one, be it a third of all rows, is range-partitioned by turn and cut into segments of LONG_ROWS places;
each segment is solved from each state to each state, and neighbouring tables of (cost, audit) are combined, FAN at a time,
until one is left. Only its SHA-256, which has no parallel form, and its repaired rows need a task that all its rows stream
through, sorted, a batch at a time.

Defined cases: a null conv_id is a conversation; null roles and texts are one space; null turns come first; rows of one turn
are in the order of role and text by code point; a null or other role has an initial that no pattern takes; a conversation
whose rows are all dropped has zeros, an empty audit and the hash of the empty string; repeated rows and long texts are
repaired whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded, bounded_batches, materialise, table

LONG_ROWS, LONG_BYTES = 1 << 10, 16 << 20
#: Tables of neighbouring segments that are combined at once.
FAN = 16
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant; what comes next, and its state.
STATES, ENDS = 4, (0, 3)
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
NAMES = {"u": "user", "a": "assistant"}

#: A row as the search sees it: initial of its role, whether it is truncated; or the number of rows that must be deleted.
Item = tuple[str, bool] | int


# -- search -----------------------------------------------------------------------------------------------------------


def suffix_sums(items: list[Item]) -> list[int]:
    """What any repair still pays from each place on."""
    sums = [0] * (len(items) + 1)
    for i in range(len(items) - 1, -1, -1):
        item = items[i]
        sums[i] = sums[i + 1] + (DELETE * item if isinstance(item, int) else TRUNCATED * item[1])
    return sums


def search(items: list[Item], start: int = 0, ends: tuple[int, ...] = ENDS, first: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from `start` to each end state that is reached, or to the first of them alone."""
    least, n = suffix_sums(items), len(items)
    heap, settled, found = [(least[0], "", 0, start)], set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and state in ends:
            found[state] = f, audit
            if first or len(found) == len(ends):
                break
        cost = f - least[i]
        item = items[i] if i < n else None
        if isinstance(item, int):  # an insert before it costs as much after it, where the audit is less
            heapq.heappush(heap, (f, audit + "D" * item, i + 1, state))
            continue
        role, after = NEXT[state]
        heapq.heappush(heap, (cost + INSERT + least[i], audit + "I", i, after))
        if item:
            initial, truncated = item
            rest = cost + least[i + 1]
            stay = rest + TRUNCATED * truncated
            heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, state))
            if initial == role:
                heapq.heappush(heap, (stay, audit + "K", i + 1, after))
            else:
                heapq.heappush(heap, (stay + REROLE, audit + "R", i + 1, after))
            if initial == "s" and state == 0:
                heapq.heappush(heap, (stay, audit + "K", i + 1, 1))
    return found


def replayed(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """The repaired (role, text, edit)s of rows (role, text); rows after the audit's end don't matter."""
    state, it = 0, iter(rows)
    for edit in audit:
        role, text = next(it) if edit != "I" else ("", "")
        if edit == "D":
            continue
        want, after = NEXT[state]
        if edit == "K" and state == 0 and role[:1] == "s":
            after = 1
        yield (role if edit == "K" else NAMES[want]), text, edit
        state = after


def digest(rows: Iterable[tuple[str, str, str]]) -> str:
    h, between = hashlib.sha256(), b""
    for role, text, _ in rows:
        h.update(between + role.encode() + b":" + text.encode())
        between = b"\n"
    return h.hexdigest()


# -- rows -------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n): the contract's damage by crc32 of `conv_id:turn`; n copies are left, 0 to 2."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def by_group(df: DataFrame, keys: list[str], order: list[Column], kernel: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], shape: T.StructType) -> DataFrame:
    """kernel(key, rows) for each group, whose rows stream in order; they are shuffled by the keys, and what it yields goes out in batches."""
    bounded_batches(df.sparkSession)
    at = [df.columns.index(k) for k in keys]
    to = to_arrow_schema(shape)
    key = itemgetter(*at) if len(at) > 1 else lambda row: (row[at[0]],)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held: list[tuple] = []
        size = 0
        for k, group in groupby(rows, key):
            for out in kernel(k, group):
                held.append(out)
                size += sum(len(x) for x in out if isinstance(x, str))
                if len(held) >= 1000 or size > LONG_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(to.names, x, strict=True)) for x in held], to)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(to.names, x, strict=True)) for x in held], to)

    sort = [F.col(k).asc_nulls_first() for k in keys]
    return df.repartition(*keys).sortWithinPartitions(*sort, *order).mapInArrow(run, shape)


def _turns(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "text", *more)]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "place long, role string, text string, edit string"


def _shape(conversations: DataFrame, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), *T._parse_datatype_string(columns).fields])


def judged(rows: list[tuple[str, str]]) -> tuple[list[Item], int, int, int, int]:
    """A short conversation's items, and how many rows are blank, repeats and truncated, and adjacent ones illegal."""
    items: list[Item] = []
    seen: set[tuple[str, str]] = set()
    blank = repeats = cut = illegal = 0
    before = None
    for row in rows:
        role, text = row
        stripped = text.rstrip(SPACE)
        if not stripped:
            blank += 1
            items.append(1)
        elif row in seen:
            repeats += 1
            items.append(1)
        else:
            truncated = stripped[-1] not in ".!?"
            cut += truncated
            items.append((role[:1], truncated))
        seen.add(row)
        if before is not None and before + role[:1] not in LEGAL:
            illegal += 1
        before = role[:1]
    return items, blank, repeats, cut, illegal


def _whole(group: Iterator[tuple]) -> tuple[list[tuple[str, str]], list[int], tuple]:
    rows, turns = [], []
    for _, turn, role, text, n in group:
        rows += [(role, text)] * n
        turns += [turn] * n
    return rows, turns, judged(rows)


def _report(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    rows, turns, (items, *counts) = _whole(group)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = min(search(items).values())
    yield (*key, gaps, *counts, cost, audit, digest(replayed(rows, audit)))


def _rows(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    rows, _, (items, *_) = _whole(group)
    _, audit = min(search(items).values())
    for place, row in enumerate(replayed(rows, audit)):
        yield (*key, place, *row)


# -- long conversations -----------------------------------------------------------------------------------------------

#: A segment's counts, the initials of its first and last row, and its table of (cost, audit) from state to state.
SEGMENT = "place long, blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<long>, audits array<string>"


def _solved(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    items: list[Item] = []
    counts = [0, 0, 0, 0]
    head = tail = None
    for _, _, _, initial, fault, n in group:
        initial = initial or ""
        forced = n if fault in ("blank", "duplicate") else n - 1
        if forced < n:
            items.append((initial, fault == "truncated"))
            counts[2] += fault == "truncated"
        if forced:
            items.append(forced)
            counts[0 if fault == "blank" else 1] += forced
        counts[3] += n - 1 + (tail is not None and tail + initial not in LEGAL)
        head, tail = initial if head is None else head, initial
    costs, audits = [], []
    for start in range(STATES):
        found = search(items, start, tuple(range(STATES)), first=False)
        for end in range(STATES):
            cost, audit = found.get(end, (None, None))
            costs.append(cost)
            audits.append(audit)
    yield (*key, *counts, head, tail, costs, audits)


def _combined(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    """Neighbouring segments as one: the least (cost, audit) over all states between them."""
    total = None
    for _, _, _, *counts, head, tail, costs, audits in group:
        if total is None:
            total = counts, head, tail, costs, audits
            continue
        counts0, head0, tail0, costs0, audits0 = total
        summed = [a + b for a, b in zip(counts0, counts, strict=True)]
        summed[3] += tail0 + head not in LEGAL
        best = []
        for start in range(STATES):
            for end in range(STATES):
                ways = [(costs0[4 * start + m] + costs[4 * m + end], m) for m in range(STATES) if costs0[4 * start + m] is not None and costs[4 * m + end] is not None]
                least = min((c for c, _ in ways), default=None)
                best.append((least, min((audits0[4 * start + m] + audits[4 * m + end] for c, m in ways if c == least), default=None)))
        total = summed, head0, tail, [c for c, _ in best], [a for _, a in best]
    counts, head, tail, costs, audits = total
    yield (*key, *counts, head, tail, costs, audits)


def _long_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, n, pos): equal ones are one, and `pos` ascends in a conversation's order.

    Ranges are cut by turn, role and the text's beginning, so that a conversation spans as many tasks as it needs.
    """
    equal = rows.where("n > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 256)]
    ordered = equal.repartitionByRange(*keys).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_turns())
    return materialise(ordered.withColumn("pos", F.monotonically_increasing_id()), "conversations-long")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, segment, pos, initial, fault, n). A row is a repeat unless it is the first of its role and text, which a
    join by the first one's place finds, however many rows say the same."""
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("d")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = F.when(stripped == "", "blank").when(F.substring(stripped, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    small = rows.select("conv_id", F.floor(F.col("pos") / LONG_ROWS).alias("segment"), "pos", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n")
    marked = small.join(firsts, "pos", "left").withColumn("fault", F.when((F.col("fault") != "blank") & F.col("first").isNull(), "duplicate").otherwise(F.col("fault")))
    return marked.select("conv_id", "segment", "pos", "initial", "fault", "n")


def _plans(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of long conversations."""
    shape = _shape(rows, SEGMENT)
    solved = materialise(by_group(_faults(rows), ["conv_id", "segment"], [F.col("pos")], _solved, shape), "conversations-segments")
    places = solved.select("conv_id", "place", (F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1).cast("long").alias("at"))  # a row a segment
    names = [f.name for f in shape]
    both = solved.join(places.withColumnRenamed("conv_id", "__c").withColumnRenamed("place", "__p"), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("place") == F.col("__p")))
    current, last = both.withColumn("place", F.col("at")).select(*names), places.agg(F.max("at")).first()[0] or 0
    while last:
        last //= FAN
        up = current.withColumn("fan", F.floor(F.col("place") / FAN)).select("conv_id", "fan", *names[1:])
        current = by_group(up, ["conv_id", "fan"], [F.col("place")], _combined, shape)
    ends = F.array_sort(F.filter(F.array(*[F.struct(F.get("costs", F.lit(e)).alias("cost"), F.get("audits", F.lit(e)).alias("audit")) for e in ENDS]), lambda s: s["cost"].isNotNull()))
    return current.withColumn("best", F.get(ends, F.lit(0))).select("conv_id", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def _streamed(key: tuple, group: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """The repaired rows of a long conversation, whose first row carries the audit."""
    audit = next(group)[-1]
    yield from replayed(((role, text) for _, _, role, text, n, _ in group for _ in range(n)), audit)


def _long_digest(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    yield (*key, digest(_streamed(key, group)))


def _long_repaired(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
    for place, row in enumerate(_streamed(key, group)):
        yield (*key, place, *row)


@dataclass(frozen=True)
class Repair:
    """report: a row for each conversation. rows(): the repaired rows (conv_id, place, role, text, edit)."""

    report: DataFrame
    _short: DataFrame
    _long: tuple[DataFrame, DataFrame] | None

    def rows(self) -> DataFrame:
        shape = _shape(self.report, ROWS)
        out = by_group(self._short, ["conv_id"], _turns(), _rows, shape)
        return out if self._long is None else out.unionByName(by_group(_with_audit(*self._long), ["conv_id"], [F.col("pos")], _long_repaired, shape))


def _with_audit(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Long conversations' rows after one that carries the audit."""
    heads = plans.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    return heads.unionByName(rows.select("conv_id", "pos", "role", "text", F.col("n").cast("long").alias("n"), F.lit(None).cast("string").alias("audit")))


def repair(rows: DataFrame) -> Repair:
    """Repair conversations given as rows (conv_id, turn, role, text, n), of which n copies stand; 0 only names the conversation."""
    rows = rows.select("conv_id", "turn", "role", "text", F.col("n").cast("long").alias("n"))
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("n", F.lit(1))).alias("rows"), F.sum(F.col("n") * F.octet_length("text")).alias("bytes"))
    large = materialise(sizes.where((F.col("rows") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("conv_id"), "conversations-sizes")
    shape = _shape(rows, REPORT)
    if not large.limit(1).count():
        return Repair(by_group(rows, ["conv_id"], _turns(), _report, shape), rows, None)
    ids = bounded(large.withColumnRenamed("conv_id", "__large"))
    same = F.col("conv_id").eqNullSafe(F.col("__large"))
    short = rows.join(ids, same, "left_anti")
    own = _long_rows(rows.join(ids, same, "left_semi"))
    plans = materialise(_plans(own), "conversations-plans")
    gaps = own.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")).withColumnRenamed("conv_id", "__g")
    hashes = by_group(_with_audit(own, plans), ["conv_id"], [F.col("pos")], _long_digest, _shape(rows, "repaired_sha256 string")).withColumnRenamed("conv_id", "__h")
    found = plans.join(gaps, F.col("conv_id").eqNullSafe(F.col("__g"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("__h"))).select(*[f.name for f in shape])
    named = large.withColumnRenamed("conv_id", "__large").join(found, F.col("__large").eqNullSafe(F.col("conv_id")), "left")  # all of its rows may be dropped
    zeros = [F.coalesce(F.col(f.name), F.lit(hashlib.sha256().hexdigest() if f.name == "repaired_sha256" else "" if f.name == "audit" else 0)).alias(f.name) for f in shape.fields[1:]]
    long = named.select(F.col("__large").alias("conv_id"), *zeros)
    return Repair(by_group(short, ["conv_id"], _turns(), _report, shape).unionByName(long), short, (own, plans))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).report


def _least(*ways: tuple[str, str, str]) -> str:
    """Least of (cost, audit) structs; a way is (state, further cost, further edit)."""
    return "list_min([" + ", ".join(f"case when {s} is not null then struct_pack(c := {s}.c + {c}, a := {s}.a || {e}) end" for s, c, e in ways) + "])"


#: A layer for each row: the least (cost, audit) by state, inserts first.
SQL = f"""
with recursive k as (select *, ' ' as gap, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as id from conversations),
h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(list_transform(range(1, len(id) + 1), lambda i: cast(ascii(id[i]) as bigint)),
  lambda crc, b: list_reduce(range(0, 8), lambda c, i: xor(c // 2, (c % 2) * 3988292384), xor(crc, b)), cast(4294967295 as bigint))) % 20 as d from k),
m as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when d = 3 then [0, 1] else [0] end) as copy from h where d <> 0),
n as (select *, row_number() over w as i, lag(left(role, 1)) over w as before, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from m window w as (partition by conv_id order by turn nulls first, role, text, copy)),
f as (select *, left(role, 1) as x, case when body = '' then 'blank' when again then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from n),
g as (select *, fault in ('blank', 'duplicate') as must, case when fault = 'truncated' then {TRUNCATED} else 0 end as t from f),
step as (
  select conv_id, 0::bigint as i, struct_pack(c := 0::bigint, a := '') as s0, null::struct(c bigint, a varchar) as s1, null::struct(c bigint, a varchar) as s2, null::struct(c bigint, a varchar) as s3 from (select distinct conv_id from g)
  union all
  select conv_id, i,
    {_least(("t0", str(DELETE), "'D'"))},
    {_least(("t1", str(DELETE), "'D'"), ("(case when not must and x = 's' then t0 end)", "t", "'K'"))},
    {_least(("t2", str(DELETE), "'D'"), *[(f"(case when not must then {s} end)", f"t + case when x = 'u' then 0 else {REROLE} end", "case when x = 'u' then 'K' else 'R' end") for s in ("t0", "t1", "t3")])},
    {_least(("t3", str(DELETE), "'D'"), ("(case when not must then t2 end)", f"t + case when x = 'a' then 0 else {REROLE} end", "case when x = 'a' then 'K' else 'R' end"))}
  from (select *, {_least(("s3", "0", "''"), ("t2", str(INSERT), "'I'"))} as t3 from (
    select g.*, s0 as t0, s1 as t1, s3, {_least(("s2", "0", "''"), *[(s, str(INSERT), "'I'") for s in ("s0", "s1", "s3")])} as t2
    from step join g on g.conv_id is not distinct from step.conv_id and g.i = step.i + 1))),
last as (select conv_id, {_least(("s0", "0", "''"), ("s3", "0", "''"), ("s2", str(INSERT), "'I'"), *[(s, str(2 * INSERT), "'II'") for s in ("s0", "s1", "s3")])} as best
  from step qualify row_number() over (partition by conv_id order by i desc) = 1),
e as (select conv_id, best.a as audit, unnest(range(1, len(best.a) + 1)) as j from last),
o as (select conv_id, j, audit[j] as edit, count(*) filter (where audit[j] <> 'I') over (partition by conv_id order by j) as i, count(*) filter (where audit[j] <> 'D') over (partition by conv_id order by j) as place from e),
r as (select o.*, g.role, g.text, max(case when place = 1 and edit = 'K' and x = 's' then 1 else 0 end) over (partition by o.conv_id) as s from o left join g on g.conv_id is not distinct from o.conv_id and g.i = o.i),
q as (select conv_id, string_agg(case when edit = 'K' then role when (place - s) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by j) as whole from r where edit <> 'D' group by 1),
z as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where i > 1 and before || x not in ('su', 'ua', 'au')) as illegal from g group by 1)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
  cast(coalesce(illegal, 0) as bigint) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join z on z.conv_id is not distinct from c.conv_id left join last on last.conv_id is not distinct from c.conv_id left join q on q.conv_id is not distinct from c.conv_id
"""
