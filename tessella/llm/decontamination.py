"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

A text is lower-cased (A-Z only), its words are runs of ASCII letters, digits and non-ASCII characters. An item's windows
are its runs of 13 words; an item of 1 to 12 words is one window; an item without words has none. The automaton holds
every distinct window, spaces around it, and scans each normalised text once.

Defined cases: a null or empty text has no words, no hits and the digest of the empty string; a null item text has no
windows; a null item_id is an item of its own that is counted but not listed; rows of the benchmark with the same item_id
are one item; repeated documents are judged alike; an empty benchmark hits nothing. Extra columns pass through; where their
names clash with the result's, `prefix` sets the latter apart (`stage` finds one itself).

Size: windows are held in the workers' memory. They are dealt by their hash, whatever items they are of, into slices of
about SLICE_BYTES, so one broadcast is bounded and a worker holds one slice's automaton. A benchmark beyond one slice is
scanned slice after slice over numbered rows; a scan writes only the rows that it hits.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, clear_prefix, drop_tables, fresh, materialise, table

WINDOW = 13
SLICE_BYTES = 64 << 20
#: The least share of hit words that contaminates a text, as a divisor: n_hit / n_words >= 1 / SHARE.
SHARE = 20

_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PARTIAL = "n_words long, starts array<int>, ends array<int>, items array<string>"
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def cleaned(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z lower-cased and every other non-word byte a space; byte offsets stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN)


def windows(text: str | None, size: int = WINDOW) -> Iterator[bytes]:
    words = cleaned(text).split()
    return (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1) if words else 0))


class Matcher:
    """The automaton of one slice; built in each worker from the broadcast pairs of a window and an item."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        import ahocorasick

        owners: dict[bytes, set[str | None]] = {}
        for window, item in pairs:
            owners.setdefault(bytes(window), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            key = f" {w.decode('latin-1')} "
            self.automaton.add_word(key, (len(key), w.count(b" ") + 1, tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray, set[str | None]]:
        """Number of words; first and past-last word of each hit run, runs merged; items found."""
        words = cleaned(text).split()
        if not words or self.empty:
            return len(words), _NONE, _NONE, set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), _NONE, _NONE, set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        begin = np.searchsorted(spaces, [end - v[0] + 1 for end, v in found])
        return len(words), *merged(begin, begin + np.array([v[1] for _, v in found])), {i for _, v in found for i in v[2]}


_NONE = np.zeros(0, np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open runs as disjoint runs in order."""
    if not len(starts):
        return _NONE, _NONE
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def spans(text: str, starts, ends) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    if not len(starts):
        return []
    clean, raw = cleaned(text), text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", clean)]
    chars = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(chars(at[s][0]), chars(at[e - 1][1])) for s, e in zip(starts, ends, strict=True)]


def verdict(n: int, starts, ends, items: set[str | None]) -> tuple:
    hit = int(np.sum(np.asarray(ends, np.int64) - np.asarray(starts, np.int64)))
    listed = ",".join(sorted(i for i in items if i is not None))
    return n, hit, len(items), hashlib.sha256(listed.encode("utf-8", "surrogatepass")).hexdigest(), hit > 0 and SHARE * hit >= n


_MATCHERS: dict[int, tuple] = {}


def _matcher(shared) -> Matcher:
    """The worker's automaton of a broadcast; the entry holds the broadcast, so its id stays its own. Another one replaces it."""
    if id(shared) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[id(shared)] = (shared, Matcher(shared.value))
    return _MATCHERS[id(shared)][1]


def window_table(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct rows (window, item) of a benchmark(item_id, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                found = windows(text, size)
                while part := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame({"window": part, "item": item})

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    return materialise(named.mapInPandas(cut, "window binary, item string").distinct(), "benchmark-windows")


def _hits(texts: DataFrame, shared) -> DataFrame:
    """Rows (row, starts, ends, items) of the texts(row, text) that one slice hits."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _matcher(shared)
        for batch in batches:
            found = [(row, *m.find(t)[1:]) for row, t in zip(batch["row"], batch["text"], strict=True)]
            found = [(row, starts, ends, list(items)) for row, starts, ends, items in found if len(starts)]
            yield pd.DataFrame(found, columns=["row", "starts", "ends", "items"])

    return texts.mapInPandas(look, "row long, starts array<int>, ends array<int>, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", prefix: str = "", window: int = WINDOW, with_spans: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, and hit_spans (character offsets) if asked for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = window_table(benchmark, window)
    count = max(1, -(-(pairs.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0) // slice_bytes))

    def share(k: int):
        own = pairs.where(F.pmod(F.xxhash64("window"), F.lit(count)) == k)
        return spark.sparkContext.broadcast([(r.window, r["item"]) for r in own.collect()])

    shape = RESULT + (", hit_spans array<struct<start:int,end:int>>" if with_spans else "")
    names = [x.split()[0] for x in re.sub(r"<.*>", "", shape).split(", ")]

    def final(t: str | None, n: int, starts, ends, items: set[str | None]) -> tuple:
        row = verdict(n, starts, ends, items)
        return (*row, [{"start": s, "end": e} for s, e in spans(t or "", starts, ends)]) if with_spans else row

    judged = fresh(docs, "__judged")
    if count == 1:
        shared = share(0)

        @F.pandas_udf(shape)
        def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            m = _matcher(shared)
            for batch in texts:
                yield pd.DataFrame([final(t, *m.find(t)) for t in batch], columns=names)

        out = docs.withColumn(judged, judge(F.col(text)))
    else:
        row, hits = (fresh(docs, c) for c in ("__row", "__hits"))
        rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
        texts = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
        found = [materialise(_hits(texts, share(k)), "decontamination-hits") for k in range(count)]
        every = reduce(DataFrame.unionByName, found).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("starts", "ends", "items")).alias(hits))  # at most one a slice

        @F.pandas_udf(shape)
        def join(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
            def one(t: str | None, own) -> tuple:
                own = [] if own is None else list(own)
                flat = lambda k: np.concatenate([_NONE, *[np.asarray(h[k], np.int64) for h in own]])
                return final(t, len(cleaned(t).split()), *merged(flat("starts"), flat("ends")), {i for h in own for i in h["items"]})

            return pd.DataFrame([one(t, h) for t, h in zip(texts, hits, strict=True)], columns=names)

        out = rows.join(materialise(every, "decontamination-found"), row, "left").withColumn(judged, join(F.col(text), F.col(hits)))
        drop_tables(pairs, *found)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{judged}.{c}").alias(prefix + c) for c in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't contaminated, with their columns."""
    prefix = clear_prefix(docs, *[c.split()[0] for c in RESULT.split(", ")])
    return scan(docs, table(spark, sf_dir, "benchmark"), prefix=prefix).where(~F.col(f"{prefix}contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts, and the hit passages' character offsets in the original text as start-end, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"), with_spans=True)
    offsets = F.array_join(F.transform("hit_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.withColumn("hit_offsets", offsets).drop("text", "hit_spans")


SQL = r"""
with words as (
  select doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents)),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
wins as (
  select distinct cast(item_id as varchar) as item, least(len(w), 13) as k, list_slice(w, i, i + least(len(w), 13) - 1) as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct k from wins),
grams as (
  select doc_id, k, i, list_slice(w, i, i + k - 1) as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k)),
found as (select g.doc_id, g.k, g.i, wins.item from grams g join wins on g.k = wins.k and g.win = wins.win),
places as (select distinct doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from found)),
hit as (select doc_id, count(*) as n_hit from places group by doc_id),
runs as (select doc_id, min(p) as a, max(p) as b from (select doc_id, p, p - row_number() over (partition by doc_id order by p) as run from places) group by doc_id, run),
gaps as (select doc_id, list_transform(regexp_split_to_array(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: length(x)) as g, list_transform(w, lambda x: length(x)) as n from words semi join hit using (doc_id)),
marks as (select doc_id, string_agg(cast(list_sum(g[1:a]) + coalesce(list_sum(n[1:a - 1]), 0) as bigint) || '-' || cast(list_sum(g[1:b]) + list_sum(n[1:b]) as bigint), ',' order by a) as hit_offsets from runs join gaps using (doc_id) group by doc_id),
who as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, item from found) group by doc_id)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(hit_offsets, '') as hit_offsets
from words left join hit using (doc_id) left join who using (doc_id) left join marks using (doc_id)
"""
