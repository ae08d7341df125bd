"""Row positions without a single-task window.

``row_number() over (partition by g order by o)`` sends a whole group to one task.
When a group can hold a large share of all rows, ``position_within`` numbers the
rows instead with one range shuffle: range partitioning splits a hot group over
many tasks, each row's index inside its task comes from
``monotonically_increasing_id`` after a sort, and per-task group counts (a table
of at most tasks + groups rows) are summed into offsets and broadcast back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketcast.session import broadcast_if_small, cut_lineage


def position_within(df: DataFrame, part_cols: list[str], order_cols: list[str], out: str = "pos",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``out``: 0-based position of the row inside its ``part_cols`` group by ``order_cols``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*part_cols, *order_cols]
    # written before it is counted: the counts and the numbered rows read the same files, so a
    # lost executor cannot make them see different ranges
    ranged = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_mid", F.monotonically_increasing_id()))
    spans = ranged.groupBy("_pid", *part_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = broadcast_if_small(offsets)
    return (ranged.join(offsets, ["_pid", *part_cols])
                  .withColumn(out, F.col("_offset") + F.col("_mid") - F.col("_first"))
                  .drop("_pid", "_mid", "_first", "_offset"))
