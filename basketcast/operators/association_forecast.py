"""Forecasts that follow the rules: a product's expected rise or fall moves the products bought with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.operators.forecast import last_date
from basketcast.session import broadcast_if_small, scalar, stored

STEPS_PER_WRITE = 5  # steps of the propagation between two written tables


def rule_weights(rules: DataFrame) -> DataFrame:
    """``(source, target, weight)`` from rules with one antecedent; every item of the consequent is a target.

    The weight is the highest confidence of such a rule, divided by the sum of all that lead to the target
    where that sum is over 1: a target's weights never add up to more than 1.
    """
    pairs = rules.where(F.size("antecedents") == 1).select(
        F.get("antecedents", F.lit(0)).alias("source"), F.explode("consequents").alias("target"), "confidence")
    best = pairs.groupBy("target", "source").agg(F.max("confidence").alias("confidence"))
    sums = best.groupBy("target").agg(F.greatest(F.sum("confidence"), F.lit(1.0)).alias("_sum"))
    return best.join(sums, "target").select("source", "target", (F.col("confidence") / F.col("_sum")).alias("weight"))


def deviations(daily: DataFrame, forecast: DataFrame) -> DataFrame:
    """``(ProductID, deviation)`` of every forecast product: its mean forecast over its mean daily sales since
    its first sale (days without sales are 0), less 1; 0 without sales."""
    end = last_date(daily)
    past = daily.where("Date IS NOT NULL").groupBy("ProductID").agg(
        (F.sum("Quantity") / (F.datediff(F.lit(end), F.min("Date")) + 1)).alias("_base"))
    ahead = forecast.groupBy("ProductID").agg(F.avg("Predicted_Quantity").alias("_ahead"))
    return ahead.join(past, "ProductID", "left").select(
        "ProductID", F.when(F.col("_base") > 0, F.col("_ahead") / F.col("_base") - 1).otherwise(0.0).alias("deviation"))


def propagate(deviation: DataFrame, weights: DataFrame, damping: float = 0.5, tolerance: float = 1e-9) -> DataFrame:
    """``(ProductID, deviation, total)`` where ``total = deviation + damping * sum(weight * total of the source)``.

    What moved in a step is passed on in the next; since weights into a target add up to at most 1, every step
    moves at most ``damping`` times the last, so the steps end once the rest cannot exceed ``tolerance``. A
    step sends one row per product and per weight. Weights between products without a deviation are left out.
    """
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError("damping must be in [0, 1) and tolerance positive")
    start = stored(deviation.select("ProductID", F.col("deviation").cast("double").alias("deviation")))
    names = start.select("ProductID")
    known = weights.join(names.withColumnRenamed("ProductID", "source"), "source", "left_semi") \
                   .join(names.withColumnRenamed("ProductID", "target"), "target", "left_semi")
    edges = broadcast_if_small(known.select(F.col("source").alias("ProductID"), "target",
                                            (F.col("weight") * F.lit(damping)).alias("_w")))
    state = start.select("ProductID", F.col("deviation").alias("moved"), F.col("deviation").alias("total"))
    while scalar(state.agg(F.max(F.abs("moved"))), 0.0) * damping / (1 - damping) >= tolerance:
        for _ in range(STEPS_PER_WRITE):
            sent = state.join(edges, "ProductID").select(F.col("target").alias("ProductID"),
                                                         (F.col("_w") * F.col("moved")).alias("moved"), F.lit(0.0).alias("total"))
            kept = state.select("ProductID", F.lit(0.0).alias("moved"), "total")
            state = kept.unionByName(sent).groupBy("ProductID").agg(F.sum("moved").alias("moved"), F.sum("total").alias("total")) \
                        .select("ProductID", "moved", (F.col("total") + F.col("moved")).alias("total"))
        state = stored(state)
    return start.join(state.select("ProductID", "total"), "ProductID")


def adjusted_forecast(daily: DataFrame, forecast: DataFrame, rules: DataFrame, damping: float = 0.5,
                      tolerance: float = 1e-9) -> DataFrame:
    """``(Date, ProductID, Predicted_Quantity, influence, Adjusted_Quantity)``: every forecast row times
    ``1 + influence``, the share of a product's rise or fall that comes from others; clipped at 0. Without rules
    nothing changes. Not for forecasts with a null product: such rows are left out."""
    moved = propagate(deviations(daily, forecast.where("ProductID IS NOT NULL")), rule_weights(rules), damping, tolerance)
    influence = broadcast_if_small(moved.select("ProductID", (F.col("total") - F.col("deviation")).alias("influence")))
    return forecast.join(influence, "ProductID").select(
        "Date", "ProductID", "Predicted_Quantity", "influence",
        F.greatest(F.col("Predicted_Quantity") * (1 + F.col("influence")), F.lit(0.0)).alias("Adjusted_Quantity"))
