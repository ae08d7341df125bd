"""Inventory: safety stock, reorder points, order quantities, recommendations, bundles, plan.

Per-product statistics are computed once with ``groupBy(ProductID)``; bundles
explode to (bundle, product) and join those statistics instead of recomputing
them per bundle.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from basketcast.functions.inventory import service_factor
from basketcast.session import cut_lineage, scalar

EOQ_SCHEMA = StructType([StructField("ProductID", StringType()), StructField("annual_demand", DoubleType()),
                         StructField("Price", DoubleType()), StructField("eoq", LongType())])


def _ceil(c):
    return F.ceil(c).cast("long")


def _safety(mean, std, z: float, lead_time_days: int):
    """ceil(std * z * sqrt(lead time)); no variability (std 0 or a single row) -> ceil(0.2 * mean)."""
    spread = std * F.lit(z) * F.lit(math.sqrt(lead_time_days))
    flat = (std.isNull()) | (std == 0)
    return _ceil(F.when(flat, mean * F.lit(0.2)).otherwise(spread))


def product_stats(hist: DataFrame, grain: str = "line") -> DataFrame:
    """Everything the inventory operators need per product, in one pass over the rows:
    mean, sample std, total quantity, mean price, first and last date.

    ``grain='line'`` (the reference's behaviour) takes demand statistics over
    transaction lines; ``grain='day'`` over daily totals (price still averaged over
    lines, carried through the daily step as a sum and a count).
    """
    has_price = "Price" in hist.columns
    if grain == "day":
        price_parts = [F.sum("Price").alias("_psum"), F.count("Price").alias("_pn")] if has_price else []
        hist = hist.groupBy("ProductID", "Date").agg(F.sum("Quantity").alias("Quantity"), *price_parts)
        price = (F.sum("_psum") / F.sum("_pn")) if has_price else F.lit(None).cast("double")
    elif grain == "line":
        price = F.avg("Price") if has_price else F.lit(None).cast("double")
    else:
        raise ValueError("grain must be 'line' or 'day'")
    return hist.groupBy("ProductID").agg(
        F.avg("Quantity").alias("mean"), F.stddev_samp("Quantity").alias("std"),
        F.sum("Quantity").alias("_total"), price.alias("_price"),
        F.min("Date").alias("_first"), F.max("Date").alias("_last"))


def _stats(hist: DataFrame, grain: str = "line") -> DataFrame:
    """Accept raw rows or an existing ``product_stats`` table; a new one (a row per product) is written once."""
    return hist if "_total" in hist.columns else cut_lineage(product_stats(hist, grain))


def safety_stock(hist: DataFrame, service_level: float = 0.95, lead_time_days: int = 7) -> DataFrame:
    """``(ProductID, mean, std, safety_stock)`` over the rows given (transaction lines by default)."""
    z = service_factor(service_level)
    return _safety_cols(_stats(hist), z, lead_time_days).select("ProductID", "mean", "std", "safety_stock")


def _safety_cols(stats: DataFrame, z: float, lead_time_days: int) -> DataFrame:
    return stats.withColumn("safety_stock", _safety(F.col("mean"), F.col("std"), z, lead_time_days))


def default_as_of(hist: DataFrame) -> dt.date | None:
    """First day after the history given, which must be that of all products: the forecast
    starts there, so a selection of products needs the date passed to it."""
    end = scalar(hist.agg(F.max("_last" if "_last" in hist.columns else "Date")))
    return None if end is None else end + dt.timedelta(days=1)


def lead_time_demand(forecast: DataFrame, as_of: dt.date, lead_time_days: int = 7) -> DataFrame:
    """Forecast total per product with ``as_of <= Date <= as_of + lead`` (both ends included)."""
    end = as_of + dt.timedelta(days=lead_time_days)
    window = forecast.filter((F.col("Date") >= F.lit(as_of)) & (F.col("Date") <= F.lit(end)))
    return window.groupBy("ProductID").agg(F.sum("Predicted_Quantity").alias("lead_time_demand"))


def reorder_points(hist: DataFrame, forecast: DataFrame, lead_time_days: int = 7, service_level: float = 0.95,
                   as_of: dt.date | None = None) -> DataFrame:
    """Safety stock plus lead-time demand (forecast, else mean x lead time), rounded up."""
    stats = _stats(hist)
    return _reorder_cols(stats, forecast, lead_time_days, service_level, as_of) \
        .select("ProductID", "mean", "std", "safety_stock", "lead_time_demand", "reorder_point")


def _reorder_cols(stats: DataFrame, forecast: DataFrame, lead_time_days: int, service_level: float,
                  as_of: dt.date | None) -> DataFrame:
    as_of = as_of or default_as_of(stats)
    ss = _safety_cols(stats, service_factor(service_level), lead_time_days)
    ltd = lead_time_demand(forecast, as_of, lead_time_days)
    out = ss.join(ltd, "ProductID", "left").withColumn(
        "lead_time_demand", F.coalesce(F.col("lead_time_demand"), F.col("mean") * F.lit(float(lead_time_days))))
    return out.withColumn("reorder_point", _ceil(F.col("lead_time_demand") + F.col("safety_stock")))


def _eoq(annual, price, holding_cost_pct: float, ordering_cost: float):
    holding = price * F.lit(float(holding_cost_pct))
    value = F.sqrt((F.lit(2.0) * annual * F.lit(float(ordering_cost))) / holding)
    ok = holding.isNotNull() & (holding > 0) & annual.isNotNull() & (annual >= 0)
    return F.when(ok, _ceil(value))


def economic_order_quantity(hist: DataFrame, holding_cost_pct: float = 0.25, ordering_cost: float = 25.0) -> DataFrame:
    """``(ProductID, annual_demand, Price, eoq)``.

    Annual demand = total quantity x 365 / days between the first and last date of
    the rows given (at least 1). Without a Price column the result is empty; a zero
    price gives a null ``eoq``.
    """
    if "Price" not in hist.columns and "_total" not in hist.columns:
        return hist.sparkSession.createDataFrame([], EOQ_SCHEMA)
    stats = _stats(hist)
    span = stats.agg(F.greatest(F.datediff(F.max("_last"), F.min("_first")), F.lit(1)).alias("days"))
    days = scalar(span, 1)
    per = stats.withColumn("annual_demand", F.col("_total") * F.lit(365.0 / days))
    return per.select("ProductID", "annual_demand", F.col("_price").alias("Price"),
                      _eoq(F.col("annual_demand"), F.col("_price"), holding_cost_pct, ordering_cost).alias("eoq"))


def inventory_recommendations(hist: DataFrame, forecast: DataFrame, lead_time_days: int = 7,
                              service_level: float = 0.95, holding_cost_pct: float = 0.25,
                              ordering_cost: float = 25.0, as_of: dt.date | None = None,
                              grain: str = "line") -> DataFrame:
    """Reorder points joined to order quantities (``as_of`` must be given when ``hist`` is a selection); a missing order quantity is twice the
    reorder point; days of supply = ceil(eoq / mean daily demand)."""
    stats = _stats(hist, grain)
    rop = reorder_points(stats, forecast, lead_time_days, service_level, as_of)
    eoq = economic_order_quantity(stats, holding_cost_pct, ordering_cost).select("ProductID", "eoq")
    recs = rop.join(eoq, "ProductID", "left").withColumn(
        "eoq", F.coalesce(F.col("eoq"), F.col("reorder_point") * 2).cast("long"))
    dos = F.when(F.col("mean") != 0, _ceil(F.col("eoq") / F.col("mean")))
    return recs.select("ProductID", F.col("mean").alias("avg_daily_demand"), F.col("std").alias("demand_std_dev"),
                       "safety_stock", "lead_time_demand", "reorder_point", "eoq", dos.alias("days_of_supply"))


def top_reorder(recs: DataFrame, n: int = 10) -> DataFrame:
    return recs.orderBy(F.col("reorder_point").desc(), F.col("ProductID").asc()).limit(n)


def rule_bundles(rules: DataFrame, min_confidence: float | None = None, min_lift: float | None = None) -> DataFrame:
    """One bundle per rule: items = antecedents + consequents (sorted), with its confidence and lift."""
    sel = rules
    if min_confidence is not None:
        sel = sel.filter(F.col("confidence") >= F.lit(float(min_confidence)))
    if min_lift is not None:
        sel = sel.filter(F.col("lift") >= F.lit(float(min_lift)))
    items = F.array_sort(F.concat("antecedents", "consequents"))
    return sel.select("antecedents_str", "consequents_str", items.alias("items"), "confidence", "lift") \
              .filter(F.size("items") >= 2)


def bundle_inventory(hist: DataFrame, forecast: DataFrame, bundles: DataFrame, lead_time_days: int = 7,
                     service_level: float = 0.95, holding_cost_pct: float = 0.25, ordering_cost: float = 25.0,
                     as_of: dt.date | None = None) -> DataFrame:
    """Stock advice per bundle from its products' recommendations.

    The order quantity uses the date span of the bundle's own products (as the
    reference recomputes it per bundle); products without history are left out and
    a bundle with none is dropped. Means are rounded half to even.
    """
    prod = _reorder_cols(_stats(hist), forecast, lead_time_days, service_level, as_of)
    members = bundles.select("antecedents_str", "consequents_str", "items", "confidence", "lift",
                             F.explode("items").alias("ProductID"))
    joined = members.join(prod, "ProductID")
    key = ["antecedents_str", "consequents_str"]
    # per-bundle span as a window on the bundle key: the final aggregate groups by a
    # superset of that key, so both share one shuffle (a bundle has at most 4 rows)
    per_bundle = Window.partitionBy(*key)
    span = F.greatest(F.datediff(F.max("_last").over(per_bundle), F.min("_first").over(per_bundle)), F.lit(1))
    joined = joined.withColumn("_days", span)
    annual = F.col("_total") * (F.lit(365.0) / F.col("_days"))
    eoq = F.coalesce(_eoq(annual, F.col("_price"), holding_cost_pct, ordering_cost), F.col("reorder_point") * 2)
    joined = joined.withColumn("_eoq", eoq)
    joined = joined.withColumn("_dos", F.when(F.col("mean") != 0, _ceil(F.col("_eoq") / F.col("mean"))))
    mean_rop = F.avg("reorder_point")
    return joined.groupBy(*key, "items", "confidence", "lift").agg(
        F.bround(F.avg("safety_stock"), 0).cast("long").alias("avg_safety_stock"),
        F.bround(mean_rop, 0).cast("long").alias("avg_reorder_point"),
        F.min("_dos").alias("min_days_supply"),
        F.bround((mean_rop * F.col("confidence")) * (F.lit(1.0) + F.lit(0.1) * (F.col("lift") - 1)), 0)
         .cast("long").alias("suggested_bundle_stock"),
    ).select(F.array_join("items", "-").alias("bundle_id"), F.array_join("items", ", ").alias("products"),
             *key, "confidence", "lift", "avg_safety_stock", "avg_reorder_point", "min_days_supply",
             "suggested_bundle_stock")


def inventory_plan(forecast: DataFrame, lead_time_days: int = 7, safety_factor: float = 1.5) -> DataFrame:
    """Plan from the forecast alone: safety = (max - avg) x factor when max > avg else 0.2 x avg;
    reorder point = avg x lead + safety; order quantity = 14 days of average demand."""
    stats = forecast.groupBy("ProductID").agg(F.avg("Predicted_Quantity").alias("avg_daily_demand"),
                                              F.max("Predicted_Quantity").alias("max_daily_demand"))
    avg, mx = F.col("avg_daily_demand"), F.col("max_daily_demand")
    safety = F.when(mx > avg, (mx - avg) * F.lit(float(safety_factor))).otherwise(avg * F.lit(0.2))
    return stats.withColumn("safety_stock", safety).select(
        "ProductID", "avg_daily_demand", "max_daily_demand", "safety_stock",
        (avg * F.lit(float(lead_time_days)) + F.col("safety_stock")).alias("reorder_point"),
        (avg * F.lit(14.0)).alias("suggested_order_quantity"))
