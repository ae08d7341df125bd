"""Sales history by month: written once, read by time range, period and product category."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.session import broadcast_if_small

MONTH = "SaleMonth"


def write_history(tx: DataFrame, path: str, files_per_month: int = 8) -> str:
    """Transactions as Parquet in one folder per month (``yyyy-MM``; rows without a date have a folder of their own).

    A month's rows are dealt by a hash of the transaction over ``files_per_month`` tasks, so neither a busy month nor
    many input partitions make one huge or many small files.
    """
    if files_per_month < 1:
        raise ValueError("files_per_month must be at least 1")
    months = tx.withColumn(MONTH, F.date_format("Date", "yyyy-MM"))
    dealt = months.repartition(MONTH, F.pmod(F.xxhash64("TransactionID", "ProductID"), F.lit(files_per_month)))
    dealt.write.mode("errorifexists").partitionBy(MONTH).parquet(path)
    return path


def read_history(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The rows from ``start`` to ``end`` (both included, either may be open); only folders of those months are read.
    Rows without a date are in no bounded range."""
    rows = spark.read.parquet(path)
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be after end")
    if start is not None:
        rows = rows.where((F.col(MONTH) >= start.strftime("%Y-%m")) & (F.col("Date") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col(MONTH) <= end.strftime("%Y-%m")) & (F.col("Date") <= F.lit(end)))
    return rows


def in_periods(history: DataFrame, periods: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of the named periods, with ``period``. ``periods`` is ``(period, SaleMonth)``: a month may belong
    to several. Which folders are read follows from the names when the query runs (dynamic partition pruning)."""
    chosen = periods.where(F.col("period").isin(list(wanted))).select("period", MONTH).distinct()
    return history.join(F.broadcast(chosen), MONTH)  # at most months x wanted names


def with_category(tx: DataFrame, dimension: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``tx`` with ``Category`` from ``dimension`` ``(ProductID, Category)``, one row per product; only the
    wanted categories when given. Products without a category are kept, with null, only when none are named."""
    lookup = dimension.groupBy("ProductID").agg(F.min("Category").alias("Category"))
    if wanted is not None:
        return tx.join(broadcast_if_small(lookup.where(F.col("Category").isin(list(wanted)))), "ProductID")
    return tx.join(broadcast_if_small(lookup), "ProductID", "left")
