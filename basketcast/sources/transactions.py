"""Transaction sources: file scans picked by extension, and the test-table view."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("csv", "parquet")


def file_format(path: str) -> str:
    """Format by the extension of a file, folder or glob (``sales/*.csv``); a path without a
    known one needs ``fmt``."""
    ext = os.path.basename(path.rstrip("/")).rsplit(".", 1)[-1].lower()
    if ext not in SUPPORTED:
        raise ValueError(f"cannot tell the format of {path!r}: name it with fmt, one of {', '.join(SUPPORTED)}")
    return ext


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Scan a file, a folder (partitioned or not) or a glob. CSV columns are read as strings;
    typing happens in cleaning."""
    fmt = (fmt or file_format(path)).lower()
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"format {fmt!r} is not one of {', '.join(SUPPORTED)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tpch_lines(spark: SparkSession, sf_dir: str, product_col: str = "p_brand") -> DataFrame:
    """Order lines of the test tables with the columns the transaction view needs.

    ``lineitem`` joins ``orders`` on the order key and ``part`` on the part key; the
    columns are pruned so the scans read only what is used.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", F.expr(product_col).alias("_product"), "p_retailprice")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .join(pt, li.l_partkey == pt.p_partkey)
              .select("l_orderkey", "l_linenumber", "o_orderdate", "_product", "l_quantity", "p_retailprice"))


def tpch_transactions(spark: SparkSession, sf_dir: str, product_col: str = "p_brand") -> DataFrame:
    """Fixture view ``transactions(TransactionID, Date, ProductID, Quantity, Price)``."""
    return tpch_lines(spark, sf_dir, product_col).select(
        F.col("l_orderkey").cast("string").alias("TransactionID"),
        F.col("o_orderdate").cast("date").alias("Date"),
        F.col("_product").alias("ProductID"),
        F.col("l_quantity").alias("Quantity"),
        F.col("p_retailprice").alias("Price"),
    )
