"""WARC archives: write captures, read them back, and merge their index into one globally ordered capture history.

Writing is JVM-side: a record is one string (WARC header, HTTP header, payload) and the text writer ends it with the
blank lines that WARC asks for, so each task writes gzipped archives to any file system. Records are written by classes of
size, so that an archive of any class holds about FILE_BYTES at most, or one record that is larger.
Of captures with equal payloads of at least MIN_BYTES bytes the one with the least id is a response, the others are
revisit records without payload that refer to it.

Reading parses an archive record by record and yields its index entries sorted: a run. The runs are range-partitioned by
(URL key, timestamp, id); within each range a loser tree merges the ascending runs that arrive, so the index comes out in
global order. A range holds about RANGE_ROWS entries; one URL with many captures is cut by its timestamps.

Defined cases: a null payload is empty; a null url is written as urn:none; line breaks in a url are percent-encoded; of
equal payloads without any id all are responses; repeated ids that are the least are all responses; an empty table gives
no archives and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, bounded_batches, materialise, scratch, table

MIN_BYTES = 0
FILE_BYTES, RANGE_ROWS = 64 << 20, 100_000
#: Upper bounds of a record's payload in all classes of size but the last.
CLASSES = (32 << 10, 1 << 20, 32 << 20)
#: Captures without a time of their own are dated from here, a second for each id.
EPOCH = 1_704_067_200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, ts string, id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def base32_sha1(data: Column) -> Column:
    """Four groups of 40 bits, eight base-32 digits each."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, id: str, url: str, payload: str, ts: str | None = None) -> DataFrame:
    """Rows (id, uri, ts, payload, digest)."""
    data = F.coalesce(F.col(payload), F.lit(""))
    when = F.col(ts) if ts else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(id), F.lit(0)) % (1 << 30))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("urn:none")), "\r", "%0D"), "\n", "%0A")
    return pages.select(F.col(id).cast("long").alias("id"), uri.alias("uri"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), data.alias("payload"), base32_sha1(data.cast("binary")).alias("digest"))


def records(found: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Rows (size, record): the payloads' bytes and the WARC records without the blank lines at their end."""
    size = F.octet_length("payload")
    groups = found.where(size >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = bounded(materialise(groups, "warc-groups"))
    judged = found.join(firsts, "digest", "left").withColumn("revisit", F.coalesce((size >= min_bytes) & ~F.col("first").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.lit(False)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uuid = lambda x: F.regexp_replace(F.md5(x.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), line("Content-Length", size.cast("string")), F.lit("\r\n"))
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(size)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uuid(F.coalesce(F.col("id").cast("string"), F.concat("digest", "uri")))),
        line("WARC-Date", F.col("ts")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", uuid(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)), line("X-Refers-To-Capture", F.col("first").cast("string")))).otherwise(""),
        F.coalesce(line("X-Capture", F.col("id").cast("string")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return judged.withColumn("http", http).select(size.alias("size"), F.concat(head, "http", F.when(F.col("revisit"), "").otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", ts: str | None = None, min_bytes: int = MIN_BYTES) -> None:
    """Archives of all pages in a folder; one of its folders for each class of size that occurs."""
    found = captures(pages, id, url, payload, ts)
    size = F.octet_length("payload")
    most = found.agg(F.max(size)).first()[0]
    if most is None:
        records(found, min_bytes).select("record").write.text(folder)
        return
    made, low = records(found, min_bytes), 0
    for high in (*CLASSES, None):
        own = made.where(F.col("size") >= low) if high is None else made.where((F.col("size") >= low) & (F.col("size") < high))
        out = own.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        out = out.option("maxRecordsPerFile", max(1, FILE_BYTES // high) if high else 1).option("zlib.compress.level", "BEST_SPEED")
        out.text(f"{folder}/size={low}")
        low = high
        if high is None or most < high:
            break


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and block of each record of a gzipped archive."""
    at = 0
    with gzip.open(io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"no WARC record at {at}")
            size, head = len(line), {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name] = value.strip()
                size += len(line)
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"the record at {at} has another length than it says")
            size += 2 + len(block) + 4
            yield at, size, head, block
            at += size


def url_key(uri: str) -> str:
    """Host labels from the top level down, then the rest, lower-cased."""
    host, slash, rest = uri.partition("://")[2].lower().partition("/")
    return ",".join(reversed(host.split("."))) + ")" + slash + rest if host else uri.lower()


def entries(archive: str, content: bytes) -> list[tuple]:
    """An archive's index entries, sorted."""
    found = []
    for at, size, head, block in parse(content):
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head["WARC-Type"] == "revisit"
        told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != told or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{archive}: the payload at {at} differs from its digest")
        number = lambda k: int(head[k]) if k in head else None
        uri = head["WARC-Target-URI"]
        found.append((url_key(uri), head["WARC-Date"], number("X-Capture"), uri, told, digest, head["WARC-Type"], number("X-Refers-To-Capture"), archive, at, size))
    return sorted(found, key=order)


def order(entry: tuple) -> tuple:
    return entry[0].encode("utf-8", "surrogatepass"), entry[1], entry[2] is not None, entry[2] or 0


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge ascending runs: inner nodes hold the losers of their matches, so each entry costs one path of matches to the root."""
    k = len(runs)
    if not k:
        return
    place = [0] * k
    keys = [(0, *order(r[0])) if r else (1,) for r in runs]  # (1,) is greater than any entry's key
    tree = [-1] * k

    def play(i: int) -> None:
        winner, node = i, (i + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return
            if (keys[tree[node]], tree[node]) < (keys[winner], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for i in range(k):
        play(i)
    while keys[top := tree[0]] != (1,):
        yield runs[top][place[top]]
        place[top] += 1
        keys[top] = (0, *order(runs[top][place[top]])) if place[top] < len(runs[top]) else (1,)
        winner, node = top, (top + k) // 2
        while node:
            if (keys[tree[node]], tree[node]) < (keys[winner], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_NAMES)
    return frame.astype({"id": "Int64", "refers_to": "Int64"})


def _tuples(frame: pd.DataFrame) -> Iterator[tuple]:
    clean = lambda x: None if pd.isna(x) else int(x)
    for r in frame.itertuples(index=False, name=None):
        yield (*r[:2], clean(r[2]), *r[3:7], clean(r[7]), *r[8:])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"], strict=True):
            yield _frame(entries(archive, content))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs: list[list[tuple]] = []
    for batch in batches:
        for entry in _tuples(batch):
            if not runs or order(runs[-1][-1]) > order(entry):
                runs.append([])
            runs[-1].append(entry)
    held = []
    for entry in loser_tree(runs):
        held.append(entry)
        if len(held) == 10_000:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The archives' index entries in global order of URL key, timestamp and id; `archive` is a path within the folder."""
    bounded_batches(spark, 1)  # an archive at a time
    within = F.substring_index("path", f"/{folder.rstrip('/').rpartition('/')[2]}/", -1)
    runs = materialise(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(within.alias("path"), "content").mapInPandas(_read, INDEX), "warc-runs")
    bounded_batches(spark)
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, "urlkey", "ts", F.col("id").asc_nulls_first()).mapInPandas(_merge, INDEX)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return index(spark, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, cast(strlen(body) as bigint) as payload_bytes, min(page_id) over (partition by hex) as first,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast((cast('0x' || substr(hex, cast(1 + 10 * (i // 8) as int), 10) as bigint) >> cast(35 - 5 * (i % 8) as int)) & 31 as int) + 1, 1)), '') as payload_digest
  from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d
"""
