"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every (record key, shard) pair gets a score ``-weight / ln(u)`` from a uniform hash
``u``; the shard with the largest score takes the record.  Adding a shard can only
take records over (its score beats the old maximum or it does not), so a change of
the shard count moves nothing between the shards that stay.

Slots number the rows of a shard from 0 without gaps.  A shard holds a growing share
of the corpus, so it is never one window group: rows are dealt evenly over
``slot_groups`` groups per shard by their position in the input, each group is
numbered on its own, and the groups' counts (shards x slot_groups rows, a bound set by
parameters) give each group's first slot.

Nulls: a null key hashes like any other value (all null keys share a shard), a null
text has no bytes.  Repeated keys share a shard and get slots of their own.  An empty
frame gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.session import cut_lineage


def score(key: Column, shard: int, weight: float) -> Column:
    """Rendezvous score of ``shard`` for ``key``: the larger the better."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard))), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.log(uniform)


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard of largest score; equal scores go to the higher shard number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")
    scored = [F.struct(score(key, j, w).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights)]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["j"]


def shard_records(docs: DataFrame, weights: list[float], added_weight: float = 1.0, key_col: str = "doc_id",
                  text_col: str = "text", slot_groups: int = 1024) -> DataFrame:
    """Place every row: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    ``weights`` has one entry per shard; ``grown_shard`` is the shard after one more of
    ``added_weight`` joins.  ``size`` is the text's UTF-8 bytes plus 1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.col(key_col)
    placed = docs.select(
        key.alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous_shard(key, weights).alias("shard"),
        rendezvous_shard(key, [*weights, added_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # the input position decides slots, so it is written once and never recomputed
    placed = cut_lineage(placed.withColumn("_group", F.pmod("_at", F.lit(slot_groups)).cast("int")))
    counts = placed.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_group").orderBy("_at")
    return (placed.withColumn("_rank", F.row_number().over(within))
            .join(F.broadcast(first), ["shard", "_group"])  # at most shards x slot_groups rows
            .select("key", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard"))
