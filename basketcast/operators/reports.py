"""Report tables that combine rules with a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketcast.functions.metrics import rule_order
from basketcast.operators.rule_views import rules_with_product
from basketcast.session import materialize


def rounded(df: DataFrame, decimals: int = 2, cols: list[str] | None = None) -> DataFrame:
    """Display rounding of numeric columns, half to even like Python's ``round``."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    targets = set(cols) if cols is not None else numeric
    return df.select(*[F.bround(c, decimals).alias(c) if c in targets and c in numeric else F.col(c)
                       for c in df.columns])


def top_forecast_products(forecast: DataFrame, n: int = 10) -> DataFrame:
    totals = forecast.groupBy("ProductID").agg(F.sum("Predicted_Quantity").alias("main_product_forecast"))
    return totals.orderBy(F.col("main_product_forecast").desc(), F.col("ProductID").asc()).limit(n)


def combined_insights(rules: DataFrame, forecast: DataFrame, n_products: int = 10, n_rules: int = 3) -> DataFrame:
    """For the ``n_products`` products with the largest total forecast, their top
    ``n_rules`` rules by lift with the product among the antecedents."""
    top = top_forecast_products(forecast, n_products)
    prank = F.row_number().over(Window.orderBy(F.col("main_product_forecast").desc(), F.col("ProductID").asc()))
    # at most n_products rows, read twice: checkpointed and counted once, then broadcast
    _, _, top = materialize(top.withColumn("product_rank", prank))
    per = rules_with_product(rules, "antecedents").join(top.select("ProductID"), "ProductID", "left_semi")
    rrank = F.row_number().over(Window.partitionBy("ProductID").orderBy(*rule_order("lift")))
    per = per.withColumn("rule_rank", rrank).filter(F.col("rule_rank") <= n_rules)
    return per.join(top, "ProductID").select(
        F.col("ProductID").alias("main_product"), "main_product_forecast",
        F.col("consequents_str").alias("associated_products"), "confidence", "lift", "product_rank", "rule_rank")


def recommendation_text(insights: DataFrame, n: int = 5) -> DataFrame:
    """Text advice for the first ``n`` insights (product rank, then rule rank)."""
    first = insights.orderBy("product_rank", "rule_rank").limit(n)
    text = F.format_string(
        "%s: %.2f units forecast. Often sold together with %s (confidence %.2f, lift %.2f): "
        "stock them together or offer a bundle.",
        "main_product", "main_product_forecast", "associated_products", "confidence", "lift")
    return first.select("main_product", "product_rank", "rule_rank", text.alias("recommendation"))
