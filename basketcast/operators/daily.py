"""Daily sales and period aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.operators.clean import filter_products

PERIODS = ("day", "week", "month")


def daily_sales(tx: DataFrame) -> DataFrame:
    """Total quantity per (Date, ProductID). After this step a product's series has at
    most one row per calendar day, which bounds every per-product window below."""
    return tx.groupBy("Date", "ProductID").agg(F.sum("Quantity").alias("Quantity"))


def sales_trend(tx: DataFrame, products=None, period: str = "week") -> DataFrame:
    """Quantity per period start and product; weeks start on Monday."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    data = filter_products(tx, products)
    if period == "day":
        start = F.col("Date")
    else:
        start = F.date_trunc(period, F.col("Date")).cast("date")
    return data.groupBy(start.alias("Date"), "ProductID").agg(F.sum("Quantity").alias("Quantity"))


def sales_trend_stats(trend: DataFrame) -> DataFrame:
    """Mean, median, min, max and total of the period sums per product (mean, median to 2 places)."""
    return trend.groupBy("ProductID").agg(
        F.bround(F.avg("Quantity"), 2).alias("Mean"),
        F.bround(F.median("Quantity"), 2).alias("Median"),
        F.min("Quantity").alias("Min"),
        F.max("Quantity").alias("Max"),
        F.sum("Quantity").alias("Total"),
    )


def top_products(tx: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` products with the largest total quantity (ties by id)."""
    totals = tx.groupBy("ProductID").agg(F.sum("Quantity").alias("total_quantity"))
    return totals.orderBy(F.col("total_quantity").desc(), F.col("ProductID").asc()).limit(n)


def product_history(daily: DataFrame, products=None) -> DataFrame:
    return filter_products(daily, products)


def demand_stats(hist: DataFrame) -> DataFrame:
    """Mean, sample std, max and min of Quantity per product over the rows given."""
    return hist.groupBy("ProductID").agg(
        F.avg("Quantity").alias("mean"),
        F.stddev_samp("Quantity").alias("std"),
        F.max("Quantity").alias("max"),
        F.min("Quantity").alias("min"),
    )
