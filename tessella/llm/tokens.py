"""Token counts by heap-and-linked-list byte-pair merging over a public tokenizer file.

The text is normalised as the file says (NFC, white space, lower case letter by letter), cut into words by its pattern and
spelt in its byte alphabet. In each word the adjacent pair of lowest rank, leftmost first, is popped from a heap and
merged in a doubly linked list, until no pair has a rank. A word's count is its initial symbols minus its merges: no
identifier is ever made. The strings of special tokens inside a text count as one token each.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows and long texts are counted whole; other
columns pass through, those named n_bytes, n_tokens or over_limit are replaced. Counts of words are kept in a bounded cache in each worker; a full cache starts anew.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE_WORDS, CACHE_CHUNKS = 700_000, 250_000
#: A word longer than this is counted anew each time, so that the cache stays small.
CACHED_CHARS = 40


def byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordCounts(dict):
    """word -> number of tokens."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("unsupported byte-pair model")
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.end, self.letters = model.get("end_of_word_suffix") or "", byte_alphabet()

    def merge(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        n, rank = len(symbols), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if j < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = k = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                if (s := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := left[i]) >= 0 and (s := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (s, h))
            merges += 1
        return n - merges

    def __missing__(self, word: str) -> int:
        n = self.merge(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


class ChunkCounts(dict):
    """Run of characters without white space -> number of tokens; no word of the pattern spans white space."""

    def __init__(self, words: WordCounts, pattern: regex.Pattern):
        super().__init__()
        self.words, self.pattern = words, pattern

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.words.__getitem__, self.pattern.findall(chunk)))
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = n
        return n


#: str.split() also splits at these, which the pattern takes as symbols.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


class TokenCounter:
    def __init__(self, spec: dict):
        self.words = WordCounts(spec)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, _ = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError("unsupported normaliser or pre-tokenizer")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.chunks = ChunkCounts(self.words, self.pattern)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.marks = [t["content"] for t in spec["added_tokens"]]

    def piece(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
        text = text.lower()
        if _SEPARATORS.search(text):
            return sum(map(self.words.__getitem__, self.pattern.findall(text)))
        return sum(map(self.chunks.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(m in text for m in self.marks):
            return sum(map(self.piece, self.special.split(text))) + len(self.special.findall(text))
        return self.piece(text)


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(spec: str) -> TokenCounter:
    if spec not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[spec] = TokenCounter(json.loads(spec))
    return _COUNTERS[spec]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; vocabulary is the path of a tokenizer file on the driver (a few MB)."""
    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(shared.value)
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.col(text))})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY)).drop("text")
