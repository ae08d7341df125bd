"""Uploads as a file stream.

The reference has no streaming operator: every analysis starts from one uploaded
file. This module only lets that upload step run on files as they arrive: the
same stateless cleaning is applied to a file stream, and daily sales are kept as
a running aggregate. Mining, forecasting and inventory stay batch operators over
the accumulated tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketcast.operators.clean import normalize_transactions, rename_columns
from basketcast.operators.daily import daily_sales


def transaction_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """Cleaned transactions from files arriving in ``path`` (a transaction id column is
    required: the id synthesis needs a global row order a stream does not have)."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = rename_columns(reader.format(fmt).load(path))
    if "TransactionID" not in raw.columns:
        raise ValueError("a stream needs a transaction id column")
    return normalize_transactions(raw)


def daily_sales_stream(tx_stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running daily sales; with a watermark on ``Date`` closed days can be emitted in append mode."""
    stream = tx_stream
    if watermark:
        stream = stream.withColumn("_ts", F.col("Date").cast("timestamp")).withWatermark("_ts", watermark)
        return stream.groupBy("_ts", "ProductID").agg(F.sum("Quantity").alias("Quantity")) \
                     .select(F.col("_ts").cast("date").alias("Date"), "ProductID", "Quantity")
    return daily_sales(stream)
