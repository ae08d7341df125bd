"""Basket lines, product list, upload statistics, preview and the sparse basket encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basket_lines(tx: DataFrame) -> DataFrame:
    """Net quantity per (transaction, product), keeping only positive totals."""
    return (tx.groupBy("TransactionID", "ProductID")
              .agg(F.sum("Quantity").alias("Quantity"))
              .filter(F.col("Quantity") > 0))


def product_list(tx: DataFrame) -> DataFrame:
    return tx.select("ProductID").distinct()


def dataset_stats(tx: DataFrame) -> DataFrame:
    """Transactions, products, first and last date, rows and columns, in one aggregate."""
    return tx.agg(
        F.count_distinct("TransactionID").alias("n_transactions"),
        F.count_distinct("ProductID").alias("n_products"),
        F.min("Date").alias("min_date"),
        F.max("Date").alias("max_date"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("n_columns", F.lit(len(tx.columns)))


def preview(tx: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in an explicit order (a top-k, not a full sort)."""
    order = order or ["TransactionID", "ProductID", "Date", "Quantity"]
    return tx.orderBy(*order).limit(n)


def basket_encoding(lines: DataFrame) -> DataFrame:
    """Sparse one-hot basket matrix: one row per (basket, product) cell that is true.

    The dense baskets x products matrix of the reference is kept in coordinate form,
    so no basket is ever collected into one array.
    """
    return lines.select("TransactionID", "ProductID").distinct()
