"""Forecast features: calendar, lags, rolling statistics, associated-product sales.

All per-product windows run over the daily table, where a product has at most one
row per calendar day, so a window partition is bounded by the number of days. One
``Window.partitionBy(ProductID).orderBy(Date)`` spec feeds every lag and rolling
column, and Spark plans a single sort for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.operators.daily import daily_sales
from basketcast.session import broadcast_if_small

LAGS = (1, 7, 14, 30)
ROLLING_MEANS = (7, 14, 30)
ROLLING_STD = 7
TIME_FEATURES = ["Year", "Month", "Day", "DayOfWeek", "Quarter", "WeekOfYear", "IsWeekend",
                 "IsMonthStart", "IsMonthEnd"]
LAG_FEATURES = ([f"Quantity_Lag{k}" for k in LAGS] + [f"Quantity_RollingMean{n}" for n in ROLLING_MEANS]
                + [f"Quantity_RollingStd{ROLLING_STD}"])
ASSOCIATION_FEATURE = "AssociatedProductSales"


def time_feature_columns(date: Column) -> dict[str, Column]:
    dow = F.weekday(date)  # Monday = 0
    return {
        "Year": F.year(date),
        "Month": F.month(date),
        "Day": F.dayofmonth(date),
        "DayOfWeek": dow,
        "Quarter": F.quarter(date),
        "WeekOfYear": F.weekofyear(date),  # ISO-8601 week
        "IsWeekend": (dow >= 5).cast("int"),
        "IsMonthStart": (F.dayofmonth(date) == 1).cast("int"),
        "IsMonthEnd": (date == F.last_day(date)).cast("int"),
    }


def time_features(df: DataFrame, date_col: str = "Date") -> DataFrame:
    return df.withColumns(time_feature_columns(F.col(date_col)))


def lag_features(daily: DataFrame, lags=LAGS, means=ROLLING_MEANS, std_window: int = ROLLING_STD,
                 exclude_current: bool = False) -> DataFrame:
    """Lags by row position in the product's date order, rolling means and sample std.

    Frames include the current row like the reference (``exclude_current=True``
    shifts them to the rows before it). Missing values become 0.
    """
    w = Window.partitionBy("ProductID").orderBy("Date")
    hi = -1 if exclude_current else 0
    cols = {f"Quantity_Lag{k}": F.coalesce(F.lag("Quantity", k).over(w), F.lit(0.0)) for k in lags}
    for n in means:
        frame = w.rowsBetween(-(n - 1) + hi, hi)
        cols[f"Quantity_RollingMean{n}"] = F.coalesce(F.avg("Quantity").over(frame), F.lit(0.0))
    frame = w.rowsBetween(-(std_window - 1) + hi, hi)
    cols[f"Quantity_RollingStd{std_window}"] = F.coalesce(F.stddev_samp("Quantity").over(frame), F.lit(0.0))
    return daily.withColumns(cols)


def rolling_means(daily: DataFrame) -> DataFrame:
    return lag_features(daily, lags=(), std_window=ROLLING_STD).drop(f"Quantity_RollingStd{ROLLING_STD}")


def rule_pairs(rules: DataFrame) -> DataFrame:
    """(antecedent item, consequent item, confidence) for every rule, duplicates kept."""
    return rules.select(F.explode("antecedents").alias("antecedent"), "consequents", "confidence") \
                .select("antecedent", F.explode("consequents").alias("consequent"), "confidence")


def association_feature(daily: DataFrame, rules: DataFrame) -> DataFrame:
    """``AssociatedProductSales`` per (product, date).

    For product p on day d: sum of (consequent's quantity that day x rule
    confidence) over every (rule, consequent) pair with p in the antecedents,
    divided by the number of pairs whose consequent sold that day; 0 when none did
    or p has no rule. Pairs from different rules count separately.
    """
    # one row per product pair, however many rules link it; broadcast once counted, so the
    # daily table is streamed past it without a shuffle
    pairs = broadcast_if_small(rule_pairs(rules).groupBy("antecedent", "consequent").agg(
        F.sum("confidence").alias("_conf"), F.count(F.lit(1)).alias("_pairs")))
    sold = daily.select(F.col("ProductID").alias("consequent"), "Date", F.col("Quantity").alias("_q"))
    hits = (pairs.join(sold, "consequent")
                 .groupBy(F.col("antecedent").alias("ProductID"), "Date")
                 .agg(F.sum(F.col("_q") * F.col("_conf")).alias("_s"), F.sum("_pairs").alias("_n")))
    return (daily.join(hits, ["ProductID", "Date"], "left")
                 .withColumn(ASSOCIATION_FEATURE, F.coalesce(F.col("_s") / F.col("_n"), F.lit(0.0)))
                 .drop("_s", "_n"))


def forecast_features(tx: DataFrame, rules: DataFrame | None = None, exclude_current: bool = False) -> DataFrame:
    """Daily sales -> calendar -> lags/rolling -> associated-product sales.

    ``tx`` may be transactions or an existing daily table. Without rules, or with an
    empty rule table, there is no associated-product feature.
    """
    daily = daily_sales(tx)
    feats = lag_features(time_features(daily), exclude_current=exclude_current)
    if rules is not None and not rules.isEmpty():
        feats = association_feature(feats, rules)
    return feats


def latest_lag_state(daily: DataFrame) -> DataFrame:
    """Newest lag and rolling values per product, frozen for scoring.

    From the product's newest 30 daily rows: Lag1 = newest; Lag7/14/30 = the 7th,
    14th, 30th newest when that many rows exist, else the newest; means of the
    newest 7, 14 and up to 30; sample std of the newest 7 (0 for one row).
    """
    w = Window.partitionBy("ProductID").orderBy(F.col("Date").desc())
    recent = daily.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 30)
    q, rn = F.col("Quantity"), F.col("_rn")
    newest = F.max(F.when(rn == 1, q))
    agg = recent.groupBy("ProductID").agg(
        F.count(F.lit(1)).alias("_n"),
        newest.alias("Quantity_Lag1"),
        F.max(F.when(rn == 7, q)).alias("_l7"),
        F.max(F.when(rn == 14, q)).alias("_l14"),
        F.max(F.when(rn == 30, q)).alias("_l30"),
        F.avg(F.when(rn <= 7, q)).alias("Quantity_RollingMean7"),
        F.avg(F.when(rn <= 14, q)).alias("Quantity_RollingMean14"),
        F.avg(q).alias("Quantity_RollingMean30"),
        F.coalesce(F.stddev_samp(F.when(rn <= 7, q)), F.lit(0.0)).alias("Quantity_RollingStd7"),
    )
    return agg.select(
        "ProductID",
        "Quantity_Lag1",
        F.coalesce("_l7", "Quantity_Lag1").alias("Quantity_Lag7"),
        F.coalesce("_l14", "Quantity_Lag1").alias("Quantity_Lag14"),
        F.coalesce("_l30", "Quantity_Lag1").alias("Quantity_Lag30"),
        "Quantity_RollingMean7", "Quantity_RollingMean14", "Quantity_RollingMean30", "Quantity_RollingStd7",
    )
