"""Forecasts of bundles and products that add up: parts, bundles, products and the total in whole units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketcast.operators.baskets import basket_encoding
from basketcast.session import broadcast_if_small, stored

ALONE = ""  # the bundle of what is sold outside every bundle


def basket_parts(lines: DataFrame, bundles: DataFrame) -> DataFrame:
    """``(ProductID, bundle, n)``: the basket lines of each product by the bundle they were sold in.

    ``bundles`` has an array ``items``; its name is the sorted items joined by ``", "``. A basket holds a bundle
    when it holds all its items. A line counts once, for the largest such bundle with its product (ties by name),
    or for no bundle (the empty name). No basket is gathered into one row: its lines meet the bundles of their item,
    and a bundle is held when as many lines met it as it has items.
    """
    named = bundles.select(F.array_sort(F.array_distinct("items")).alias("items")).where(F.size("items") > 1).distinct()
    by_item = broadcast_if_small(named.select(F.array_join("items", ", ").alias("bundle"), "items",
                                              F.size("items").alias("size"), F.explode("items").alias("ProductID")))
    cells = basket_encoding(lines)
    held = cells.join(by_item, "ProductID").groupBy("TransactionID", "bundle", "items", "size") \
                .agg(F.count(F.lit(1)).alias("met")).where("met = size")
    best = held.select("TransactionID", "bundle", "size", F.explode("items").alias("ProductID")) \
               .groupBy("TransactionID", "ProductID").agg(F.min(F.struct((-F.col("size")).alias("back"), "bundle"))["bundle"].alias("bundle"))
    return cells.join(best, ["TransactionID", "ProductID"], "left") \
                .groupBy("ProductID", F.coalesce("bundle", F.lit(ALONE)).alias("bundle")).agg(F.count(F.lit(1)).alias("n"))


def bundle_forecast(forecast: DataFrame, lines: DataFrame, bundles: DataFrame, places: int = 3) -> DataFrame:
    """``(level, Date, ProductID, bundle, units)``; units are whole numbers of ``10^-places``.

    Levels: ``part`` (product in a bundle, or alone), ``bundle``, ``product`` and ``total`` per day. Proportional from
    the top: a product's forecast, rounded to units once, is dealt to its parts by their shares of its past basket
    lines; the part ending at share c gets ``floor(units * c)`` less what was dealt before, so parts add up to the
    product exactly. Bottom-up from there: bundles and the total are sums of parts, so all levels agree. A
    product that never sold has one part, alone; a missing forecast counts as 0.
    """
    history = stored(basket_parts(lines, bundles))
    order = Window.partitionBy("ProductID").orderBy("bundle")  # at most one row per bundle of the product
    shares = history.select("ProductID", "bundle", F.sum("n").over(order).alias("upto"), (F.sum("n").over(order) - F.col("n")).alias("before"),
                            F.sum("n").over(Window.partitionBy("ProductID")).alias("n"))
    wanted = forecast.select("Date", "ProductID", F.coalesce(F.round(F.col("Predicted_Quantity") * F.lit(10 ** places)), F.lit(0.0))
                             .cast("long").alias("_units"))

    def dealt(upto):
        # whole numbers: _units * upto may pass 2^63
        return F.expr(f"cast((cast(_units AS decimal(19, 0)) * cast({upto} AS decimal(19, 0))) div cast(n AS decimal(19, 0)) AS bigint)")

    parts = stored(wanted.join(broadcast_if_small(shares), "ProductID", "left").select(
        "Date", "ProductID", F.coalesce("bundle", F.lit(ALONE)).alias("bundle"),
        F.when(F.col("n").isNull(), F.col("_units")).otherwise(dealt("upto") - dealt("before")).alias("units")))

    def level(name, keys):
        sums = parts.groupBy("Date", *keys).agg(F.sum("units").alias("units"))
        cols = [F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in ("ProductID", "bundle")]
        return sums.select(F.lit(name).alias("level"), "Date", *cols, "units")

    return level("part", ["ProductID", "bundle"]).unionByName(level("bundle", ["bundle"])) \
        .unionByName(level("product", ["ProductID"])).unionByName(level("total", []))
