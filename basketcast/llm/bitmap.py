"""Broadcast membership filters of a fixed size, built by Spark.

A bitmap of ``bits`` bits holds the hashes of 64-bit keys.  Tasks set bits, the parts of
their bitmaps are joined by part number, and the driver receives ``bits`` bits and no
key.  A filter lets some other keys through, more as it fills, and misses none, so what
follows it must not rely on what it lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketcast.llm.shingles import mix
from basketcast.llm.text import columns_of, rows_out

BITS = 1 << 23
_PART = 1 << 14  # bytes of a part
JOIN_TASKS = 16
_TYPES = [("part", pa.int32()), ("packed", pa.binary())]


def bit_of(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def long_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def key_filter(keys: DataFrame, bits: int = BITS):
    """Broadcast array of one flag per bit, over all columns (64-bit, not null) of ``keys``."""
    names = keys.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, dtype=np.uint8)
        for batch in batches:
            for name in names:
                flags[bit_of(long_column(batch, name), bits)] = 1
        packed = np.packbits(flags)
        parts = ((p, packed[p * _PART:(p + 1) * _PART]) for p in range(-(-len(packed) // _PART)))
        yield rows_out([(p, x.tobytes()) for p, x in parts if x.any()], _TYPES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(*columns_of(batch, "part", "packed"), strict=True):
                more = np.frombuffer(x, dtype=np.uint8)
                parts[p] = parts[p] | more if p in parts else more
        yield rows_out([(p, x.tobytes()) for p, x in parts.items()], _TYPES)

    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, packed binary"
    # few parts of a fixed size: some tasks are enough
    joined = keys.mapInArrow(mark, schema).repartition(n, "part").coalesce(min(n, JOIN_TASKS)).mapInArrow(join, schema)
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in joined.toLocalIterator():
        packed[row["part"] * _PART:row["part"] * _PART + len(row["packed"])] = np.frombuffer(row["packed"], dtype=np.uint8)
    return spark.sparkContext.broadcast(np.unpackbits(packed).astype(bool))
