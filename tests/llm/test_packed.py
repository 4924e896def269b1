"""Token-id files: blocks and segments round trip, ids equal the library's, documents in order."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import common, packed

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(packed.VOCABULARY)
with open(PATH, encoding="utf-8") as f:
    PATTERN = regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.just(7)), max_size=700))
def test_blocks_round_trip(values):
    x = np.array(values, np.uint32)
    blocks = packed.pack(x)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    assert packed.unpack(b"".join(blocks), starts).tolist() == values
    assert len(blocks) == -(-len(x) // packed.BLOCK)


def test_width_is_that_of_the_percentile():
    x = np.array([5 + k % 8 for k in range(116)] + [5 + (1 << 31)] * 12, np.uint32)
    (block,) = packed.pack(x)
    head = np.frombuffer(block[:8], packed._HEAD)[0]
    assert (head["base"], head["width"], head["last"], head["exceptions"]) == (5, 3, 127, 12)
    assert len(block) == 8 + 128 * 3 // 8 + 12 * 5
    assert len(packed.pack(np.full(128, 9, np.uint32))[0]) == 8


def test_segments_round_trip_and_ranges():
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(0, 60_000, n).astype("<u4").tobytes()) for i, n in enumerate(rng.integers(0, 900, 40))]
    content = packed.segment(docs, 3, 0) + b"\n" + packed.segment(docs[:1], 3, 1) + b"\n"
    second, first = packed.segments(content)
    whole = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    assert first.ids().tolist() == whole.tolist() and first.doc_ids == [d for d, _ in docs] and (second.partition, second.number) == (3, 1)
    for a, b in ((0, 0), (0, 1), (127, 129), (300, 4000), (len(whole) - 3, len(whole))):
        assert first.ids(a, b).tolist() == whole[a:b].tolist()
    broken = bytearray(content)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        list(packed.segments(bytes(broken)))
    with pytest.raises((ValueError, packed.struct.error)):
        list(packed.segments(content[:-9]))


def test_ids_equal_the_library_s(library, monkeypatch):
    encode = packed.Encoder(library.to_str())
    rng = random.Random(4)
    odd = ["a.", "A.b!", "it's", "'s.", "É́tion", "x= ̸y", "ΑΣ", "İx", "ﬁ", "5.,", "?!", "a_.", "a\x1cb", "a\x85b", "a\xa0b", "<|endoftext|>", "x<|startoftext|>y", "日本。", "😀.", "ß", "µ.", "½?", "²!", " ", "don't,", "ŉ", "ſ"]
    texts = ["".join(rng.choice(odd + ["Word", "word,", "die"]) + rng.choice([" ", "\n", "", "  "]) for _ in range(rng.randrange(9))) for _ in range(1500)]
    texts += [chr(c) + "b." + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += [" ".join(texts[k : k + 60]) for k in range(0, 1500, 60)]
    monkeypatch.setattr(packed, "PART_CHARS", 300)
    monkeypatch.setattr(packed, "CACHE_PIECES", 700)
    for t, ids in zip(texts * 2, encode.batch(texts * 2), strict=True):  # the second time from the cache
        assert ids == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


class Counted:
    """A tokenizer that notes how many times it is called."""

    def __init__(self, of, calls):
        self.of, self.calls = of, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.of, name)


def test_new_words_of_many_texts_take_one_call_or_two(library):
    encode, calls = packed.Encoder(library.to_str()), []
    for name, held in list(vars(encode).items()):
        if isinstance(held, Tokenizer):
            setattr(encode, name, Counted(held, calls))
    texts = [f"Word{'abcdefgh'[k % 8] * 3}, it's 4{k % 7}.{k % 10} x{'!?;-+'[k % 5] * (k % 4)} ({k % 3}) déjà" for k in range(400)]
    got = list(encode.batch(texts))
    assert len(calls) <= 2  # a call for each sign, digit and contraction before
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encode.batch(texts)) == got and len(calls) <= 2


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZsé×÷ªµ²½©\xa0ŉſÿ '.,!_7\n\t\x0b\x00\x7f"), max_size=24), max_size=5))
def test_pieces_are_cut_where_words_meet(texts):
    cut, upto = packed.pieces(texts)
    assert len(upto) == len(texts) + 1
    for k, t in enumerate(texts):
        own = cut.slice(upto[k], upto[k + 1] - upto[k]).to_pylist()
        assert "".join(own) == t.lower()
        assert [w for p in own for w in PATTERN.findall(p)] == PATTERN.findall(t.lower())


@pytest.mark.parametrize("n", [1, 7, 8, 100, 128])
def test_bits_of_any_width(n):
    rng = np.random.default_rng(n)
    for w in range(33):
        x = rng.integers(0, 1 << 32, (3, n), np.uint32)
        data = packed._joined_bits(x, w)
        low = x & np.uint32((1 << w) - 1)
        assert data == b"".join(sum(int(v) << (w * i) for i, v in enumerate(row)).to_bytes((n * w + 7) // 8, "little") for row in low)
        assert packed._taken_bits(data, 3, n, w).tolist() == low.tolist()


def expected(library, rows):
    out, start = [], 0
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packed.END]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_edges(spark, library, monkeypatch):
    monkeypatch.setattr(packed, "SEGMENT_BYTES", 4000)
    monkeypatch.setattr(packed, "PARTITION_BYTES", 300_000)
    long = "Alpha béta, gamma. " * 60_000
    texts = [(5, None), (3, ""), (None, "null id"), (4, long), (9, "one"), (9, "one"), (9, "one"), (-2, "less"), (7, "two words")] + [(100 + i, "many words, " * (i % 50)) for i in range(400)]
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "row": F.lit(1), "start": F.lit(2.0)}).repartition(3)
    folder = common.scratch(spark, "packed-test")
    packed.write(docs, folder, PATH)
    got = packed.read(spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(library, sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert spark.read.format("binaryFile").load(folder).where("length > 0").count() > 3
    empty = common.scratch(spark, "packed-empty")
    packed.write(docs.limit(0), empty, PATH)
    assert packed.read(spark, empty).count() == 0


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = packed.query(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(library, sorted(map(tuple, rows)))
