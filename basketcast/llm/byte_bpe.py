"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A text is split by the vocabulary's pattern; each distinct word starts as its single
bytes, and the adjacent pair of lowest rank (the leftmost of equals) is merged until no
pair has a rank.  The ids of a text are its words' ids in order; decoding concatenates
the byte strings of the ids.

``encode`` keeps the rank map and a bounded memory of words in each task, so a word is
folded once for most of its occurrences and nothing is shuffled.  ``fold_words`` is the
same fold as Spark higher-order functions over a literal rank map (README: figures).

Null and empty texts give no ids.  Rows are encoded one by one, so ties and repeated ids
need no rule; an empty frame gives an empty result.  A word of any length is folded
with a heap in O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.llm.text import id_text, map_rows

SHORT_WORD = 48
MEMORY_WORDS = 300_000
_TWO_SPACES = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT_WORD:
        return _fold_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    rank = ranks.get
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs and a linked list of parts."""
    n = len(word)
    part = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (r, i, part[i], part[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or part[i] != a or part[j] != b:
            continue  # one of the two has been merged meanwhile
        part[i], part[j] = a + b, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        after[j] = n
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[p] for p in part if p]


class Bpe:
    """Encoder and decoder of whole texts for one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= MEMORY_WORDS:
                self.words.clear()
            ids = np.asarray(fold(word.encode("utf-8", "surrogatepass"), self.ranks), dtype="<u4").tobytes()
            if len(word) <= SHORT_WORD:
                self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a space and what follows it up to the next single space."""
        ids = self.chunks.get(chunk)
        if ids is None:
            if len(self.chunks) >= MEMORY_WORDS:
                self.chunks.clear()
            ids = b"".join(map(self.word, self.split(" " + chunk)))
            if len(chunk) <= SHORT_WORD:
                self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _TWO_SPACES.search(text):
            return b"".join(map(self.word, self.split(text)))
        # no match of the pattern spans a single space between two other characters
        first, *rest = text.split(" ")
        known, chunk = self.chunks.get, self.chunk
        return b"".join([*map(self.word, self.split(first)), *[known(c) or chunk(c) for c in rest]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) of every whole text."""
    return map_rows(id_text(docs, id_col, text_col), lambda i, t: (i, bpe(ranks_path, pattern).encode(t)),
                    "doc_id long, ids binary", [("doc_id", pa.int64()), ("ids", pa.binary())])


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of every row of ``doc_id, ids``."""
    return map_rows(encoded.select("doc_id", "ids"), lambda i, x: (i, bpe(ranks_path, pattern).decode(x or b"")),
                    "doc_id long, bytes binary", [("doc_id", pa.int64()), ("bytes", pa.binary())])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding, then decoding of the ids."""

    def one(doc_id, text):
        coder = bpe(ranks_path, pattern)
        ids = coder.encode(text)
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return map_rows(id_text(docs, id_col, text_col), one,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


def rank_lookup(ranks: dict[bytes, int], buckets: int = 4096) -> list[dict[str, int]]:
    """The rank map as ``buckets`` small maps by the CRC-32 of the token, keyed by its hex
    digits: Spark scans a map value from its start, so a lookup must scan a few entries only."""
    out: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        out[zlib.crc32(token) % buckets][token.hex().upper()] = rank
    return out


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = 4096) -> DataFrame:
    """``word, ids`` of distinct words: the fold in Spark higher-order functions.

    The parts of a word are hex strings of its bytes; each of ``length - 1`` steps of an
    ``aggregate`` merges the adjacent pair of lowest rank, if there is one.
    """
    spark = words.sparkSession
    maps = rank_lookup(ranks, buckets)
    table = spark.createDataFrame([(maps,)], "maps array<map<string,int>>")  # a literal of the vocabulary's size

    def rank(maps: Column, part: Column) -> Column:
        at = F.pmod(F.crc32(F.unhex(part)), F.lit(buckets)).cast("int")
        return F.try_element_at(F.get(maps, at), part)

    def step(maps: Column, parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.size(parts) - 1),
                            lambda x, i: F.struct(rank(maps, F.concat(x, F.get(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        at = best["i"]
        merged = F.concat(F.slice(parts, 1, at), F.array(F.concat(F.get(parts, at), F.get(parts, at + 1))),
                          F.slice(parts, at + 3, F.size(parts)))
        return F.when((F.size(parts) > 1) & best.isNotNull(), merged).otherwise(parts)

    source = words.select(F.col(word_col).alias("word")).where(F.octet_length("word") > 0).distinct()
    joined = source.join(F.broadcast(table))  # one row: the literal rank map
    parts = F.transform(F.sequence(F.lit(0), F.octet_length("word") - 1),
                        lambda i: F.substring(F.hex(F.col("word").cast("binary")), i * 2 + 1, F.lit(2)))
    rounds = F.sequence(F.lit(1), F.octet_length("word"))
    whole = rank(F.col("maps"), F.hex(F.col("word").cast("binary")))
    folded = F.aggregate(rounds, parts, lambda acc, _: step(F.col("maps"), acc))
    ids = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda p: rank(F.col("maps"), p)))
    return joined.select("word", ids.alias("ids"))
