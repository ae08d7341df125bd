"""Inputs every registered query shares, built with Spark from the test tables.

* transactions: ``lineitem ⋈ orders ⋈ part`` with one of ``p_brand`` / ``p_type`` as
  the product;
* rules: mined from those transactions with explicit thresholds (the reference's
  defaults give no rule on these tables);
* a deterministic stand-in forecast (each product's mean daily quantity on the same
  weekday, for the 30 days after the data), so inventory and report operators can be
  checked against SQL; the boosted-tree forecast itself is checked by rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.operators.clean import normalize_transactions
from basketcast.operators.daily import daily_sales
from basketcast.operators.forecast import future_grid
from basketcast.operators.rules import mine_rules
from basketcast.session import cut_lineage
from basketcast.sources.transactions import tpch_transactions

BRAND = "p_brand"
TYPE = "p_type"
# Thresholds for the test tables (support, confidence, lift).
BRAND_RULES = (0.01, 0.1, 1.0)
TYPE_RULES = (0.01, 0.1, 1.0)
HORIZON = 30


def transactions(spark: SparkSession, sf_dir: str, product: str = BRAND) -> DataFrame:
    return normalize_transactions(tpch_transactions(spark, sf_dir, product))


def mined(spark: SparkSession, sf_dir: str, product: str = BRAND) -> tuple[DataFrame, DataFrame]:
    support, confidence, lift = BRAND_RULES if product == BRAND else TYPE_RULES
    return mine_rules(transactions(spark, sf_dir, product), support, confidence, lift)


def rules(spark: SparkSession, sf_dir: str, product: str = BRAND) -> DataFrame:
    return mined(spark, sf_dir, product)[1]


def daily_table(spark: SparkSession, sf_dir: str, product: str = BRAND) -> DataFrame:
    """The daily table, written once: dates, products, forecasts and features all follow from it."""
    return cut_lineage(daily_sales(transactions(spark, sf_dir, product)))


def stand_in_forecast(spark: SparkSession, sf_dir: str, product: str = BRAND, daily: DataFrame | None = None) -> DataFrame:
    """``(Date, ProductID, Predicted_Quantity)``: the product's mean daily quantity on that weekday
    (over all days if it never sold on one)."""
    daily = daily_table(spark, sf_dir, product) if daily is None else daily
    by_day = daily.groupBy("ProductID", F.weekday("Date").alias("_dow")).agg(F.avg("Quantity").alias("_on_day"))
    overall = daily.groupBy("ProductID").agg(F.avg("Quantity").alias("_on_all"))
    grid = future_grid(daily, horizon=HORIZON).withColumn("_dow", F.weekday("Date"))
    return (grid.join(overall, "ProductID").join(by_day, ["ProductID", "_dow"], "left")
            .select("Date", "ProductID", F.coalesce("_on_day", "_on_all").alias("Predicted_Quantity")))
