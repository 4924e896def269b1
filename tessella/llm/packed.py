"""Token-id files of patched frame-of-reference blocks.

Documents are range-partitioned by doc_id, encoded, and written as segments of up to SEGMENT_BYTES of ids, in ascending order.
A segment is one record of a file:

    "PFOR", blocks, directory, block index, footer, line feed (the record's end in Spark's text writer)
    block      base u32, width u8, count - 1 u8, exceptions u8, 0 u8; then the low `width` bits of each value less the base,
               value by value from the lowest bit on; the exceptions' places u8; the exceptions' bits above `width` u32
    directory  doc_id i64 of each document, null flags u8, ids u64 of each document
    index      first byte u64 of each block, counted from the segment's begin
    footer     bytes from the segment's begin to the directory u64, documents u64, blocks u64, ids u64, partition u32,
               number in the partition u32, crc32 of all before u32, "pfor"

A block holds BLOCK consecutive ids, across documents; the last of a segment may hold fewer. Its width holds the values up to
the PERCENTILE-th; greater ones are exceptions. All numbers are little-endian. By the block index any range of ids is read
without those before it (`Segment.ids`).

Words are encoded by the tokenizers library, once each: texts are cut where two words of this vocabulary's pattern surely meet,
the distinct pieces of some MB of text are looked up in a bounded cache, and the words that it lacks go to the file's model in one
call. A text in which lower case, composition or white space are less simple, or with a special token's string, goes to the library whole.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows of one doc_id follow one another in the
order of a hash of the text, equal rows in any; long texts are encoded whole and a segment holds at least one document; no
documents give no files; other columns aren't written.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import bounded_batches, materialise, scratch, table

VOCABULARY, END = "word_bpe_49k.json", 2
BLOCK, PERCENTILE = 128, 90
#: Bytes of unpacked ids of a segment, segments of a file, and bytes of text of a partition.
SEGMENT_BYTES, FILE_SEGMENTS, PARTITION_BYTES = 4 << 20, 8, 64 << 20
#: Blocks packed or unpacked at once.
AT_ONCE = 2048
CACHE_PIECES = 300_000
#: Characters of texts that are encoded at once.
PART_CHARS = 1 << 20
#: A longer piece is encoded anew each time.
CACHED_CHARS = 40
MAGIC, FOOTER = b"PFOR", struct.Struct("<QQQQIII4s")
_HEAD = np.dtype([("base", "<u4"), ("width", "u1"), ("last", "u1"), ("exceptions", "u1"), ("zero", "u1")])


# -- blocks -----------------------------------------------------------------------------------------------------------


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # exact below 2**53


def pack(values: np.ndarray) -> list[bytes]:
    """The blocks of uint32 values, in order."""
    out: list[bytes] = []
    for at in range(0, len(values), BLOCK * AT_ONCE):
        part = values[at : at + BLOCK * AT_ONCE]
        full = len(part) // BLOCK
        if full:
            out += _packed(part[: full * BLOCK].reshape(full, BLOCK))
        if full * BLOCK < len(part):
            out += _packed(part[full * BLOCK :][None])
    return out


def _packed(rows: np.ndarray) -> list[bytes]:
    n = rows.shape[1]
    base = rows.min(axis=1)
    above = rows - base[:, None]
    place = -(-n * PERCENTILE // 100) - 1
    width = bit_length(np.partition(above, place, axis=1)[:, place])
    out: list[bytes] = [b""] * len(rows)
    for w in map(int, np.unique(width)):
        own = np.flatnonzero(width == w)
        d, held = above[own], (n * w + 7) // 8
        low = _joined_bits(d, w)
        high = d >> np.uint32(w) if w < 32 else np.zeros_like(d)
        block, spot = np.nonzero(high)
        much = high[block, spot].astype("<u4").tobytes()
        ends = np.searchsorted(block, np.arange(len(own) + 1))
        head = np.zeros(len(own), _HEAD)
        head["base"], head["width"], head["last"], head["exceptions"] = base[own], w, n - 1, np.diff(ends)
        heads, spots = head.tobytes(), spot.astype(np.uint8).tobytes()
        for i, (k, a, b) in enumerate(zip(own.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            out[k] = heads[8 * i : 8 * i + 8] + low[held * i : held * i + held] + spots[a:b] + much[4 * a : 4 * b]
    return out


def _spans(w: int) -> Iterator[tuple[int, int, int, bool]]:
    """Of eight values of w bits, which are w bytes: each one's number, 64-bit word, shift in it, whether it goes on in the next."""
    for j in range(8):
        yield j, j * w // 64, j * w % 64, j * w % 64 + w > 64


def _joined_bits(values: np.ndarray, w: int) -> bytes:
    """The low w bits of each row's values, in whole bytes a row."""
    rows, n = values.shape
    eights = -(-n // 8)
    low = np.zeros((rows, eights * 8), np.uint64)
    low[:, :n] = values & np.uint32((1 << w) - 1)
    low = np.ascontiguousarray(low.reshape(-1, 8).T)
    words = np.zeros((-(-w // 8), rows * eights), "<u8")
    for j, k, shift, more in _spans(w) if w else ():
        words[k] |= low[j] << np.uint64(shift)
        if more:
            words[k + 1] |= low[j] >> np.uint64(64 - shift)
    raw = np.ascontiguousarray(words.T).view(np.uint8).reshape(rows * eights, -1)[:, :w] if w else np.zeros((rows * eights, 0), np.uint8)
    return raw.reshape(rows, eights * w)[:, : (n * w + 7) // 8].tobytes()


def _taken_bits(data: bytes, rows: int, n: int, w: int) -> np.ndarray:
    """The values that _joined_bits has joined, as uint32."""
    if not w:
        return np.zeros((rows, n), np.uint32)
    eights = -(-n // 8)
    raw = np.zeros((rows, eights * w), np.uint8)
    raw[:, : (n * w + 7) // 8] = np.frombuffer(data, np.uint8).reshape(rows, -1)
    wide = np.zeros((rows * eights, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = raw.reshape(-1, w)
    words = np.ascontiguousarray(wide.view("<u8").T)
    out = np.empty((rows * eights, 8), np.uint32)
    for j, k, shift, more in _spans(w):
        value = words[k] >> np.uint64(shift)
        if more:
            value |= words[k + 1] << np.uint64(64 - shift)
        out[:, j] = value & np.uint64((1 << w) - 1)
    return out.reshape(rows, eights * 8)[:, :n]


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at these places, in order."""
    raw = np.frombuffer(data, np.uint8)
    parts = [_unpacked(data, raw, starts[at : at + AT_ONCE]) for at in range(0, len(starts), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _unpacked(data: bytes, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    starts = starts.astype(np.int64)
    head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    size = head["last"].astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], np.uint32)
    shape = head["width"].astype(np.int64) * 256 + head["last"]
    for s in np.unique(shape):
        own, w, n = np.flatnonzero(shape == s), int(s) // 256, int(s) % 256 + 1
        begin, held = starts[own] + _HEAD.itemsize, (n * w + 7) // 8
        values = _taken_bits(b"".join([data[b : b + held] for b in begin.tolist()]), len(own), n, w)
        more = head["exceptions"][own].astype(np.int64)
        if more.any():
            block = np.repeat(np.arange(len(own)), more)
            turn = np.arange(len(block)) - np.repeat(np.cumsum(more) - more, more)
            spots = raw[begin[block] + held + turn]
            at = begin[block] + held + more[block] + 4 * turn
            much = raw[at[:, None] + np.arange(4)].view("<u4")[:, 0]
            values[block, spots] |= much << np.uint32(w)
        out[first[own][:, None] + np.arange(n)] = values + head["base"][own][:, None]
    return out


# -- segments ---------------------------------------------------------------------------------------------------------


def segment(docs: list[tuple[int | None, bytes]], partition: int, number: int) -> bytes:
    """One record, without the line feed: documents as (doc_id, ids as little-endian uint32)."""
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    blocks = pack(ids)
    starts = len(MAGIC) + np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    directory = [
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
        np.array([d is None for d, _ in docs], "u1").tobytes(),
        np.array([len(x) // 4 for _, x in docs], "<u8").tobytes(),
        starts[:-1].tobytes(),
    ]
    body = b"".join([MAGIC, *blocks, *directory])
    return body + FOOTER.pack(int(starts[-1]), len(docs), len(blocks), len(ids), partition, number, zlib.crc32(body), MAGIC.lower())


class Segment:
    """A record that has been read: doc_ids (None for null), ids by document, any range of ids."""

    def __init__(self, data: bytes):
        at, docs, blocks, self.n_ids, self.partition, self.number, crc, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC.lower() or zlib.crc32(memoryview(data)[: -FOOTER.size]) != crc:
            raise ValueError("not a whole segment of packed ids")
        self.data = data
        doc_ids, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "u1", docs, at + 8 * docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(doc_ids, null, strict=True)]
        self.sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks, at + 17 * docs)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from start up to end, by the blocks that hold them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        first, last = start // BLOCK, -(-end // BLOCK)
        return unpack(self.data, self.starts[first:last])[start - first * BLOCK : max(start, end) - first * BLOCK]


def segments(content: bytes) -> Iterator[Segment]:
    """A file's segments, the last one first: a footer tells where its segment begins."""
    end = len(content)
    while end:
        end -= 1  # the line feed
        at, docs, blocks = struct.unpack_from("<QQQ", content, end - FOOTER.size)
        begin = end - FOOTER.size - 8 * blocks - 17 * docs - at
        if begin < 0 or content[end : end + 1] != b"\n":
            raise ValueError("not a file of packed ids")
        yield Segment(content[begin:end])
        end = begin


# -- encoding ---------------------------------------------------------------------------------------------------------


#: Kinds of a plain text's bytes; what begins with C2, and the signs of multiplication and division, may be of several.
WHITE, LETTER, DIGIT, SIGN, APOSTROPHE, MIXED = range(6)


def byte_kinds() -> np.ndarray:
    kind = np.full(256, SIGN, np.uint8)
    kind[[*b" \t\n\v\f\r"]], kind[[*b"0123456789"]], kind[ord("'")] = WHITE, DIGIT, APOSTROPHE
    kind[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), 0xC3, 0xC4, 0xC5]] = LETTER
    kind[0xC2] = MIXED
    return kind


def kind_borders() -> np.ndarray:
    """Whether two words, or a word and white space, surely meet between bytes of two kinds."""
    cut = ~np.eye(6, dtype=bool)
    cut[DIGIT, DIGIT] = True
    cut[APOSTROPHE, LETTER] = cut[APOSTROPHE, SIGN] = cut[SIGN, APOSTROPHE] = False
    cut[MIXED, 1:] = cut[1:, MIXED] = False
    return cut.ravel()


KINDS, BORDERS = byte_kinds(), kind_borders()


def pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Plain texts in lower case, cut between the pattern's words as far as bytes tell; the number of pieces before each text and of all."""
    lower = pc.utf8_lower(pa.array(texts, pa.string()))
    ends = np.frombuffer(lower.buffers()[1], np.int32, len(texts) + 1) if texts else np.zeros(1, np.int32)
    if not ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8, ends[-1])
    kind = KINDS[data]
    if len(more := np.flatnonzero((data & 0xC0) == 0x80)):  # second bytes
        kind[more] = kind[more - 1]
        sign = more[(data[more - 1] == 0xC3) & ((data[more] == 0x97) | (data[more] == 0xB7))]
        kind[sign] = kind[sign - 1] = MIXED
    cut = np.ones(len(data) + 1, bool)
    np.take(BORDERS, kind[:-1] * np.uint8(6) + kind[1:], out=cut[1:-1])
    cut[ends] = True
    begin = np.flatnonzero(cut).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), lower.buffers()[2]), np.searchsorted(begin, ends)


class Encoder:
    """Texts -> their ids as little-endian uint32, with a bounded cache of pieces."""

    #: Lower case goes letter by letter here and nothing composes with its neighbours: ASCII, Latin-1 and Extended-A, but
    #: U+0130, and but the separators that not all take as white space.
    plain = re.compile("[\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u017f]*").fullmatch

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(spec)
        split, letters = parts["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or not split["invert"] or letters["type"] != "ByteLevel" or letters["add_prefix_space"] or letters["use_regex"]:
            raise ValueError("unsupported pre-tokenizer")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = model_alone(parts["model"])
        vocabulary, suffix = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what the cache held when it was last full

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words of the pattern, in one call of the library: the last id of each word, and no other, ends a word."""
        if not words:
            return []
        ids = np.array(self.model.encode_batch_fast([spelt(" ".join(words))], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):
            return list(map(self.whole, words))  # a vocabulary that lacks some bytes
        data = ids.tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def keep(self, found: dict[str, bytes]) -> None:
        found = {p: ids for p, ids in islice(found.items(), CACHE_PIECES) if len(p) <= CACHED_CHARS}
        if len(self.cache) + len(found) > CACHE_PIECES:
            self.before, self.cache = self.cache, {}
        self.cache.update(found)

    def found(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct pieces; new words of all of them are encoded at once."""
        out = list(map(self.cache.get, distinct))
        again: dict[str, bytes] = {}
        words: list[str] = []
        others: list[str] = []
        for piece in [p for p, ids in zip(distinct, out, strict=True) if ids is None]:
            if (ids := self.before.get(piece)) is not None:
                again[piece] = ids
            elif piece.isalpha():
                words.append(piece)
            else:
                others.append(piece)
        new = dict(zip(words, self.words(words), strict=True))
        if others:
            apart = [self.pattern.findall(p) for p in others]
            more = list({w for ws in apart for w in ws} - new.keys())
            known = new | dict(zip(more, self.words(more), strict=True))
            new |= {p: b"".join([known[w] for w in ws]) for p, ws in zip(others, apart, strict=True)}
        if again or new:
            new |= again
            out = [new[p] if ids is None else ids for p, ids in zip(distinct, out, strict=True)]
            self.keep(new)
        return out

    def joined(self, parts: list[str]) -> list[bytes]:
        """The parts' ids, each distinct piece of all of them looked up once."""
        plain = [self.plain(p) is not None and not any(m in p for m in self.marks) for p in parts]
        cut, upto = pieces([p for p, own in zip(parts, plain, strict=True) if own])
        coded = cut.dictionary_encode()
        found = self.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = coded.indices.to_numpy()
        sizes = size[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat((np.cumsum(size) - size)[index] - ends[:-1], sizes)
        place += np.arange(len(place))
        data = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        spans = pairwise((4 * ends[upto]).tolist())
        return [data[slice(*next(spans))] if own else self.whole(p) for p, own in zip(parts, plain, strict=True)]

    def batch(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids, worked out for about PART_CHARS characters at once."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > PART_CHARS:
                yield from self.joined(held)
                held, size = [], 0
            if len(text) > PART_CHARS:
                ends = [0]
                while ends[-1] < len(text):
                    ends.append(cut(text, ends[-1]))
                yield b"".join(self.joined([text[a:b]])[0] for a, b in pairwise(ends))
            else:
                held.append(text)
                size += len(text)
        yield from self.joined(held)


def byte_alphabet() -> tuple[np.ndarray, np.ndarray]:
    """The library's spelling of each byte in UTF-8, and how much of it counts: printable Latin-1 bytes are themselves, others U+0100 on; a space stays."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    letters = [chr(b if b in own else next(rest)) for b in range(256)]
    letters[0x20] = " "
    spelling = np.array([[*c.encode("utf-8").ljust(2)] for c in letters], np.uint8)
    return spelling, np.array([[True, len(c.encode("utf-8")) == 2] for c in letters])


SPELLING, COUNTS = byte_alphabet()


def spelt(words: str) -> str:
    """Words in the byte alphabet; spaces stay."""
    raw = np.frombuffer(words.encode("utf-8"), np.uint8)
    return SPELLING[raw][COUNTS[raw]].tobytes().decode("utf-8")


def model_alone(spec: dict) -> Tokenizer:
    """The file's model for words that are normalised, cut and spelt in the byte alphabet, without the library's own cache: no word comes twice."""
    if spec["type"] != "BPE" or spec.get("dropout") or not spec.get("end_of_word_suffix"):
        raise ValueError("unsupported model")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    options = {k: spec[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if spec.get(k)}
    out = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **options))
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


def cut(text: str, at: int) -> int:
    """Where a part of about PART_CHARS ends: after a space or a line feed, at which no word spans two parts."""
    if len(text) - at <= PART_CHARS:
        return len(text)
    for space in (" ", "\n"):
        if (end := text.rfind(space, at, at + PART_CHARS)) > at:
            return end + 1
    ends = [e for e in (text.find(space, at + PART_CHARS) for space in (" ", "\n")) if e >= 0]
    return min(ends) + 1 if ends else len(text)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


# -- files ------------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode docs, an `end` id after each, and write their segments to the folder in ascending order of doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = ["d", F.xxhash64("t"), "row"]  # a hot doc_id, and equal rows, are dealt to several partitions too
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    mark, limit = struct.pack("<I", end), SEGMENT_BYTES

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, number = _encoder(shared.value), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(held, partition, number)], pa.binary())], ["segment"])

        doc_ids: deque[int | None] = deque()  # of the texts that are read but not encoded

        def texts() -> Iterator[str | None]:
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    doc_ids.append(d)
                    yield t.as_py()

        for ids in encode.batch(texts()):
            ids += mark
            if held and size + len(ids) > limit:
                yield flush()
                held, size, number = [], 0, number + 1
            held.append((doc_ids.popleft(), ids))
            size += len(ids)
        if held:
            yield flush()

    made = ordered.mapInArrow(pieces, "segment binary")
    made.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)


FOUND = "partition long, number long, place long, doc_id long, begin long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _ENCODERS.clear()  # the worker may have written before
    for batch in batches:
        for content in batch.column(0):
            for s in segments(content.as_py()):
                ids = s.ids().astype("<u4", copy=False)
                end = np.cumsum(s.sizes)
                begin = end - s.sizes
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                n = len(crc)
                columns = [np.full(n, s.partition), np.full(n, s.number), np.arange(n), pa.array(s.doc_ids, pa.int64()), begin, s.sizes, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in FOUND.split(", ")])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the folder's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files are decoded once. Only sums travel on: one for each segment, and one for each partition in the window over all.
    """
    bounded_batches(spark, 1)  # a file at a time
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("content")
    found = materialise(files.mapInArrow(_read, FOUND), "packed-found")
    bounded_batches(spark)
    sums = found.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("partition").orderBy("number")
    within = sums.select("partition", "number", (F.sum("n").over(upto) - F.col("n")).alias("within"))
    totals = sums.groupBy("partition").agg(F.sum("n").alias("n"))
    before = totals.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("before"))  # a row a partition
    offsets = within.join(before, "partition").select("partition", "number", (F.col("within") + F.col("before")).alias("before"))
    return found.join(F.broadcast(offsets), ["partition", "number"]).select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "packed-ids")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return read(spark, folder)
