"""Exact dedup by composable polynomial fingerprints, verified chunk by chunk.

A byte string's fingerprint is its length and its value as a polynomial at fixed bases
modulo two primes.  The fingerprint of a concatenation follows from its parts:
``H(xy) = H(x) * base^len(y) + H(y)``, so a document is hashed in chunks that need not
be read together, and the chunk values combine by that length-shifted sum.  Documents
with equal fingerprints are then compared chunk by chunk: per (fingerprint, chunk
number) the smallest and the largest chunk must be the same bytes.  Groups that fail
(a collision) are told apart by SHA-256, so no result rests on the fingerprint alone.

Texts count as equal after each run of space, tab, line feed, vertical tab, form feed
and carriage return is one space.  Nulls are empty texts, all equal to each other.
Of equal texts the smallest id stays; rows that repeat an id with the same text are
one group, and each of them carries the same ``keep_id`` (``kept`` is true for the rows
with that id).  A null id sorts last: a group of null ids only has a null ``keep_id``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.text import columns_of, id_text, rows_out
from basketcast.session import cut_lineage, materialize

PRIMES = (2147483647, 2147483629)  # largest two primes below 2^31: products fit 64 bits
BASES = (1103515245, 1566083941)
CHUNK_BYTES = 65536
KEY = ["n_bytes", "fp1", "fp2"]
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(text: str) -> bytes:
    return _SPACE.sub(b" ", text.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=4)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """``base^(n-1) ... base^0`` modulo ``prime``."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:  # doubling: base^(done+i) = base^done * base^i
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out[::-1].copy()


def chunk_hash(chunk: bytes, which: int) -> int:
    """Polynomial value of one chunk (at most ``CHUNK_BYTES``)."""
    powers = _powers(BASES[which], PRIMES[which], CHUNK_BYTES)
    data = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return int(np.dot(data, powers[CHUNK_BYTES - len(data):]) % np.uint64(PRIMES[which])) if len(data) else 0


def combine(left: int, right: int, right_len: int, which: int) -> int:
    """Value of a concatenation from the values of its parts."""
    return (left * pow(BASES[which], right_len, PRIMES[which]) + right) % PRIMES[which]


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)] or [b""]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """``(length, value at prime 1, value at prime 2)``."""
    h = [0, 0]
    for part in chunks(data):
        for w in (0, 1):
            h[w] = combine(h[w], chunk_hash(part, w), len(part), w)
    return len(data), h[0], h[1]


_FP_TYPES = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
             ("text_sha256", pa.string())]
_CHUNK_TYPES = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
                ("chunk_no", pa.int64()), ("chunk", pa.binary())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            data = normalise(text)
            rows.append((doc_id, *fingerprint(data), hashlib.sha256(data).hexdigest()))
        yield rows_out(rows, _FP_TYPES)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            data = normalise(text)
            fp = fingerprint(data)
            for no, part in enumerate(chunks(data)):
                rows.append((doc_id, *fp, no, part))
                held += len(part)
                if held > 8 << 20:
                    yield rows_out(rows, _CHUNK_TYPES)
                    rows, held = [], 0
        yield rows_out(rows, _CHUNK_TYPES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, fp1, fp2, text_sha256`` of every row's normalised text."""
    return id_text(docs, id_col, text_col).mapInArrow(
        _fingerprints, "doc_id long, n_bytes long, fp1 long, fp2 long, text_sha256 string")


def collided(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Fingerprints whose member documents differ in some chunk.

    ``members`` are the ``(doc_id, n_bytes, fp1, fp2)`` rows of groups of two and more.
    Chunks meet per (fingerprint, chunk number); the minimum and maximum are taken
    map-side first, so copies do not travel.
    """
    _, _, ids = materialize(members.select("doc_id").distinct())
    again = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    rows = again.mapInArrow(_chunk_rows, "doc_id long, n_bytes long, fp1 long, fp2 long, chunk_no long, chunk binary")
    return (rows.groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
            .where(F.col("lo") != F.col("hi")).select(*KEY).distinct())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    source = id_text(docs, id_col, text_col)
    marks = cut_lineage(fingerprints(source))
    groups = (marks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
              .where("group_size > 1"))
    groups, n_groups, side = materialize(groups)
    if n_groups:
        members = marks.join(side.select(*KEY), KEY, "left_semi")
        bad, n_bad, bad_side = materialize(collided(source, members))
        if n_bad:  # different texts behind one fingerprint: SHA-256 tells them apart
            marks = cut_lineage(marks.join(bad_side.withColumn("_bad", F.lit(True)), KEY, "left")
                                .withColumn("_sub", F.when(F.col("_bad"), F.col("text_sha256")).otherwise(F.lit("")))
                                .drop("_bad"))
            groups = (marks.groupBy(*KEY, "_sub")
                      .agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
                      .where("group_size > 1"))
            _, _, side = materialize(groups)
            return _result(marks.join(side, [*KEY, "_sub"], "left"))
    return _result(marks.join(side, KEY, "left"))


def _result(joined: DataFrame) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
