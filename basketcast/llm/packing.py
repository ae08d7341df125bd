"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents of an input partition form one stream of tokens in their order, each
document closed by an end id.  The stream is cut into windows of at most
``window`` tokens; a window's cost is its padding (none if its length is a power of
two) plus a penalty for the cut that ends it: none at a document's end, ``soft`` at a
sentence's end, ``hard`` elsewhere (offered only inside sentences of over ``window/8``
tokens).  With ``f(j)`` the least cost of the stream up to cut j,

    f(j) = penalty(j) + window - j + min { f(i) + i : j - window <= i < j },

and the minimum over the sliding range is the head of a monotone queue, so a cut
costs O(1); windows of a power of two tokens are looked up by their start.

Memory is bounded by ``block`` tokens: a full block is solved, all its windows but a
rest of under one window are emitted, and the rest opens the next block.  Nothing is
shuffled.  Null and empty texts are a single end id.  Repeated ids are packed row by
row.  An empty frame gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from basketcast.llm.text import columns_of, id_text, rows_out
from basketcast.llm.tokens import json_tokenizer

_TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(at: list[int], penalty: list[int], window: int, end: int | None = None) -> list[int]:
    """Ends of the windows of least total cost over the ascending cut positions ``at``
    (> 0, gaps of at most ``window``).  With ``end`` the last window must end there,
    else at whichever cut of the last ``window`` tokens costs least per the objective."""
    f, back = {0: 0}, {}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + i, i), rising in both
    powers = [1 << k for k in range(5, window.bit_length()) if 1 << k < window]
    known = f.get
    for j, extra in zip(at, penalty, strict=True):
        while queue[0][1] < j - window:
            queue.popleft()
        head, i = queue[0]
        best, source = head + window - j, i
        for p in powers:
            other = known(j - p)
            if other is not None and other < best:
                best, source = other, j - p
        best += extra
        f[j], back[j] = best, source
        best += j
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j))
    if end is None:  # an open end: leave the rest to the next block
        last = at[-1]
        end = min((j for j in at if j > last - window), key=lambda j: (f[j] * 1.0 / j, -j))
    cuts = []
    while end:
        cuts.append(end)
        end = back[end]
    return cuts[::-1]


class Packer:
    """Turns a stream of documents into pieces, block by block."""

    def __init__(self, sentence_end: np.ndarray, window: int, soft: int, hard: int, block: int, first_sequence: int):
        self.sentence_end, self.window, self.soft, self.hard, self.block = sentence_end, window, soft, hard, block
        self.sequence = first_sequence
        self.docs: list[tuple[int, int, np.ndarray, int]] = []  # id, ids before, rest of the ids, all ids
        self.held = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        # a document longer than a block is fed in parts, so a block stays bounded
        for at in range(0, len(ids), self.block):
            part = ids[at:at + self.block]
            self.docs.append((doc_id, at, part, len(ids)))
            self.held += len(part)
            if self.held >= self.block:
                yield from self.flush(final=False)

    def _cut_points(self) -> tuple[list[int], list[int]]:
        at, cost = [], []
        base, step = 0, max(1, self.window // 32)
        for _, start, ids, total in self.docs:
            ends = np.flatnonzero(self.sentence_end[ids]) + 1
            last = len(ids)
            marks = np.append(ends[ends < last], last)
            kinds = np.full(len(marks), self.soft)
            kinds[-1] = 0 if start + last == total else self.hard
            gaps = np.diff(marks, prepend=0)
            wide = np.flatnonzero(gaps > self.window // 8)
            if len(wide):  # a long sentence may be cut inside
                inside = np.concatenate([np.arange(marks[k] - gaps[k] + step, marks[k], step) for k in wide])
                marks = np.concatenate([marks, inside])
                kinds = np.concatenate([kinds, np.full(len(inside), self.hard)])
                order = np.argsort(marks, kind="stable")
                marks, kinds = marks[order], kinds[order]
            at += (marks + base).tolist()
            cost += kinds.tolist()
            base += last
        return at, cost

    def flush(self, final: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        at, cost = self._cut_points()
        cuts = choose_cuts(at, cost, self.window, at[-1] if final else None)
        docs, k, begin = deque(self.docs), 0, 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc_id, start, ids, total = docs.popleft()
                take = min(len(ids), cut - begin)
                piece = ids[:take].astype("<u4")
                yield (doc_id, start, take, zlib.crc32(piece.tobytes()), total, self.sequence, offset)
                if take < len(ids):
                    docs.appendleft((doc_id, start + take, ids[take:], total))
                begin += take
                offset += take
            self.sequence += 1
        self.docs = list(docs)
        self.held = sum(len(d[2]) for d in self.docs)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, window: int = 2048, end_id: int = 1, soft: int = 2,
         hard: int = 8, block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer_path`` is a byte-level BPE file of the tokenizers library, present on
    every machine; ``sequence_id`` is unique over all partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = json_tokenizer(tokenizer_path, pattern)
        ends = np.zeros(tokenizer.size, dtype=bool)
        for i, b in tokenizer.bytes_of.items():
            ends[i] = any(c in b for c in b".!?\n")
        packer = Packer(ends, window, soft, hard, block, TaskContext.get().partitionId() << 36)
        tail = np.array([end_id], dtype="<u2")
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                rows += packer.add(doc_id, np.concatenate([tokenizer.ids(text), tail]))
            if rows:
                yield rows_out(rows, _TYPES)
                rows = []
        rows += packer.flush(final=True)
        yield rows_out(rows, _TYPES)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
