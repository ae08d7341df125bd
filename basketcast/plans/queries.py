"""Registered queries: one per operator of the survey inventory, over the whole test tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the SQL in ``basketcast.plans.oracle``. Doubles that depend on summation
order are rounded to 6 places on both sides; item sets are compared as
``', '``-joined sorted strings.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.operators import (association_forecast, baskets, bundle_forecast, boosting, daily, features, forecast, inventory, itemsets, reports,
                                  rule_views, timeseries, validate)
from basketcast.operators.clean import filter_products, normalize_transactions
from basketcast.plans import fixed_model, flows
from basketcast.plans import fixtures as fx
from basketcast.plans.oracle import MULTI
from basketcast.session import cut_lineage, ensure_checkpoint_dir, stored
from basketcast.sources import history
from basketcast.sources.sinks import write_csv
from basketcast.sources.transactions import table, tpch_lines

Query = Callable[[SparkSession, str], DataFrame]
RULE_COLS = ["antecedents_str", "consequents_str", "support", "confidence", "lift"]
METRIC_COLS = ["antecedents_str", "consequents_str", "antecedent_support", "consequent_support", "support",
               "confidence", "lift", "leverage", "conviction", "zhangs_metric", "jaccard", "certainty", "kulczynski"]
TOP_LIFT = 1.01  # inside the range of lifts of the mined rules
SELECTED = ["Brand#11", "Brand#23", "Brand#3", "Brand#14"]
SCENARIOS = {"base": {}, "promotion": {"Brand#11": 1.25, "Brand#23": 1.5}, "shortage": {"Brand#11": 0.6}}


def r6(col) -> F.Column:
    """Round to 6 places after a 1e-10 nudge, so a value on a tie rounds the same way in
    both engines even when summation order changed its last bit."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(1e-10), 6)


# ---------------------------------------------------------------- load, clean, validate
def q_clean_transactions(spark, sf):
    return fx.transactions(spark, sf).select("TransactionID", "Date", "ProductID", "Quantity", "Price")


def q_synth_txn_id(spark, sf):
    raw = tpch_lines(spark, sf).select(F.col("o_orderdate").alias("Date"), F.col("_product").alias("ProductID"),
                                       F.col("l_quantity").alias("Quantity"), F.col("l_orderkey").alias("k1"),
                                       F.col("l_linenumber").alias("k2"))
    return normalize_transactions(raw, order_cols=["k1", "k2", "ProductID", "Quantity"]).select(
        "TransactionID", "Date", "ProductID", "Quantity", "k1", "k2")


def q_validation_profile(spark, sf):
    return validate.validation_profile(fx.transactions(spark, sf))


def q_basket_lines(spark, sf):
    return baskets.basket_lines(fx.transactions(spark, sf))


def q_product_list(spark, sf):
    return baskets.product_list(fx.transactions(spark, sf))


def q_dataset_stats(spark, sf):
    return baskets.dataset_stats(fx.transactions(spark, sf))


def q_preview(spark, sf):
    return baskets.preview(fx.transactions(spark, sf)).select("TransactionID", "Date", "ProductID", "Quantity")


# ---------------------------------------------------------------- association mining
def q_baskets(spark, sf):
    return baskets.basket_encoding(baskets.basket_lines(fx.transactions(spark, sf)))


def _itemsets(spark, sf, product):
    return fx.mined(spark, sf, product)[0].select("itemsets_str", "size", "freq", "support")


def q_frequent_itemsets(spark, sf):
    return _itemsets(spark, sf, fx.TYPE)


def q_frequent_itemsets_brand(spark, sf):
    return _itemsets(spark, sf, fx.BRAND)


def q_association_rules(spark, sf):
    return fx.rules(spark, sf, fx.TYPE).select(*RULE_COLS)


def q_rule_metrics(spark, sf):
    return fx.rules(spark, sf, fx.TYPE).select(*METRIC_COLS)


def q_association_rules_brand(spark, sf):
    return fx.rules(spark, sf, fx.BRAND).select(*METRIC_COLS)


def q_top_associations(spark, sf, product=fx.BRAND):
    return rule_views.top_associations(fx.rules(spark, sf, product), 5).select("ProductID", "rank", *RULE_COLS)


def q_product_bundles(spark, sf, product=fx.BRAND):
    out = rule_views.product_bundles(fx.rules(spark, sf, product), min_confidence=0.12, min_lift=1.02)
    return out.select("antecedents_str", "consequents_str", F.array_join("items", ", ").alias("items_str"),
                      "confidence", "lift")


def q_cross_sell(spark, sf, product=fx.BRAND):
    return rule_views.cross_sell(fx.rules(spark, sf, product)).select("ProductID", *RULE_COLS)


def q_all_rule_bundles(spark, sf, product=fx.BRAND):
    out = rule_views.all_rule_bundles(fx.rules(spark, sf, product))
    return out.select("antecedents_str", "consequents_str", F.array_join("items", ", ").alias("items_str"),
                      F.size("items").alias("n_items"), "confidence", "lift")


def q_associated_products(spark, sf, product=fx.BRAND):
    return rule_views.associated_products(fx.rules(spark, sf, product), 5)


def q_associated_forecast(spark, sf, product=fx.BRAND):
    out = rule_views.associated_forecast(fx.rules(spark, sf, product), fx.stand_in_forecast(spark, sf, product))
    return out.withColumn("avg_predicted_demand", r6("avg_predicted_demand"))


# ---------------------------------------------------------------- aggregation
def q_daily_sales(spark, sf):
    return daily.daily_sales(fx.transactions(spark, sf))


def _trend(period):
    def q(spark, sf):
        return daily.sales_trend(fx.transactions(spark, sf), None, period)
    return q


def q_sales_trend_stats(spark, sf):
    return daily.sales_trend_stats(daily.sales_trend(fx.transactions(spark, sf), None, "week"))


def q_top_products(spark, sf):
    return daily.top_products(fx.transactions(spark, sf), 15)


def q_associated_sales_comparison(spark, sf, product=fx.BRAND):
    tx = fx.transactions(spark, sf, product)
    return rule_views.associated_sales_comparison(daily.daily_sales(tx), fx.rules(spark, sf, product))


def q_forecast_summary(spark, sf):
    out = forecast.forecast_summary(fx.stand_in_forecast(spark, sf))
    return out.select("ProductID", r6("total").alias("total"), r6("average").alias("average"),
                      r6("min").alias("min"), r6("max").alias("max"))


def q_rule_item_frequency(spark, sf, product=fx.BRAND):
    return rule_views.rule_item_frequency(fx.rules(spark, sf, product))


def q_demand_stats(spark, sf):
    out = daily.demand_stats(fx.transactions(spark, sf))
    return out.select("ProductID", r6("mean").alias("mean"), r6("std").alias("std"), "max", "min")


# ---------------------------------------------------------------- windows and features
def _features(spark, sf, rules=False, product=fx.BRAND):
    tx = fx.transactions(spark, sf, product)
    return features.forecast_features(tx, fx.rules(spark, sf, product) if rules else None)


def q_time_features(spark, sf):
    return features.time_features(daily.daily_sales(fx.transactions(spark, sf))) \
        .select("Date", "ProductID", *features.TIME_FEATURES)


def q_lag_features(spark, sf):
    return _features(spark, sf).select("Date", "ProductID", "Quantity",
                                       *[f"Quantity_Lag{k}" for k in features.LAGS])


def q_rolling_means(spark, sf):
    cols = [f"Quantity_RollingMean{n}" for n in features.ROLLING_MEANS]
    return _features(spark, sf).select("Date", "ProductID", *[r6(c).alias(c) for c in cols])


def q_rolling_std(spark, sf):
    return _features(spark, sf).select("Date", "ProductID", r6("Quantity_RollingStd7").alias("Quantity_RollingStd7"))


def q_association_feature(spark, sf, product=fx.BRAND):
    tx = fx.transactions(spark, sf, product)
    out = features.association_feature(daily.daily_sales(tx), fx.rules(spark, sf, product))
    return out.select("Date", "ProductID", r6(features.ASSOCIATION_FEATURE).alias(features.ASSOCIATION_FEATURE))


def q_forecast_features(spark, sf, product=fx.BRAND):
    feats = _features(spark, sf, rules=True, product=product)
    exact = ["Date", "ProductID", "Quantity", *features.TIME_FEATURES, *[f"Quantity_Lag{k}" for k in features.LAGS]]
    rounded = [c for c in feats.columns if c not in exact]
    return feats.select(*exact, *[r6(c).alias(c) for c in rounded])


def q_latest_lag_state(spark, sf):
    st = features.latest_lag_state(daily.daily_sales(fx.transactions(spark, sf)))
    return st.select(*[r6(c).alias(c) if c != "ProductID" else F.col(c) for c in st.columns])


# ---------------------------------------------------------------- forecasting
def q_train_split(spark, sf):
    frame, _ = forecast.training_frame(_features(spark, sf))
    return forecast.train_split(frame, 0.8).select("Date", "ProductID", "is_train")


def q_future_grid(spark, sf):
    return forecast.future_grid(fx.daily_table(spark, sf), horizon=fx.HORIZON)


def q_demand_forecast(spark, sf):
    return flows.demand_forecast(fx.transactions(spark, sf), rules=fx.rules(spark, sf), horizon=fx.HORIZON)[1]


def _model(spark, sf):
    """Daily table, rules and the fitted model, trained by every query that needs it."""
    daily_, rules = fx.daily_table(spark, sf), fx.rules(spark, sf)
    return daily_, rules, forecast.train_model(daily_, rules=rules)


def q_feature_importance(spark, sf):
    return forecast.feature_importance(_model(spark, sf)[2])


def q_holdout_accuracy(spark, sf):
    daily_, rules, model = _model(spark, sf)
    return forecast.evaluate_holdout(model, daily_, rules=rules)


def _fixed_model(spark):
    """The written model, as read back from its node table."""
    names = [*features.TIME_FEATURES, *features.LAG_FEATURES]
    return boosting.from_node_table(spark.createDataFrame(fixed_model.NODES, boosting.NODE_SCHEMA), names)


def q_demand_forecast_fixed(spark, sf):
    model = _fixed_model(spark)
    grid = forecast.scoring_frame(fx.daily_table(spark, sf), horizon=fx.HORIZON)
    return grid.select("Date", "ProductID", r6(F.greatest(model.score(), F.lit(0.0))).alias("Predicted_Quantity"))


def q_holdout_accuracy_fixed(spark, sf):
    daily_ = fx.daily_table(spark, sf)
    model = forecast.ForecastModel(_fixed_model(spark), [*features.TIME_FEATURES, *features.LAG_FEATURES])
    out = forecast.evaluate_holdout(model, daily_)
    return out.select(r6("RMSE").alias("RMSE"), r6("MAPE").alias("MAPE"))


def q_feature_importance_fixed(spark, sf):
    """The written model's mean gain per split, next to how many of the held-out rows pass a split on the feature."""
    model = _fixed_model(spark)
    names = [*features.TIME_FEATURES, *features.LAG_FEATURES]
    frame, _ = forecast.training_frame(_features(spark, sf))
    test = forecast.train_split(frame, 0.8).filter(~F.col("is_train"))
    passed = boosting.split_passes(model, test)
    score = forecast.feature_importance(forecast.ForecastModel(model, names), top=len(names))
    return score.join(passed, "feature", "left").select("feature", r6("importance").alias("importance"),
                                                       F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


def q_forecast_accuracy(spark, sf):
    """Accuracy of the previous day's quantity as the prediction on the held-out 20 %."""
    frame, _ = forecast.training_frame(_features(spark, sf))
    test = forecast.train_split(frame, 0.8).filter(~F.col("is_train"))
    out = forecast.forecast_accuracy(test.select(F.col("Quantity").alias("actual"),
                                                 F.col("Quantity_Lag1").alias("predicted")))
    return out.select(r6("RMSE").alias("RMSE"), r6("MAPE").alias("MAPE"))


def q_scenario_forecast(spark, sf):
    out = forecast.scenario_forecasts(fx.stand_in_forecast(spark, sf), SCENARIOS)
    return out.select("scenario", "Date", "ProductID", r6("Predicted_Quantity").alias("Predicted_Quantity"))


def q_actual_vs_forecast(spark, sf):
    days = fx.daily_table(spark, sf)
    out = forecast.actual_vs_forecast(days, fx.stand_in_forecast(spark, sf, daily=days))
    return out.select("series", "ProductID", "Date", r6("Quantity").alias("Quantity"))


def q_forecast_report(spark, sf):
    days = fx.daily_table(spark, sf)
    out = forecast.forecast_report(fx.stand_in_forecast(spark, sf, daily=days), days)
    return out.select("ProductID", "ForecastDate", r6("Predicted_Quantity").alias("Predicted_Quantity"))


# ---------------------------------------------------------------- inventory
def q_safety_stock(spark, sf):
    out = inventory.safety_stock(fx.transactions(spark, sf))
    return out.select("ProductID", r6("mean").alias("mean"), r6("std").alias("std"), "safety_stock")


def q_reorder_points(spark, sf):
    out = inventory.reorder_points(fx.transactions(spark, sf), fx.stand_in_forecast(spark, sf))
    return out.select("ProductID", "safety_stock", r6("lead_time_demand").alias("lead_time_demand"), "reorder_point")


def q_economic_order_quantity(spark, sf):
    out = inventory.economic_order_quantity(fx.transactions(spark, sf))
    return out.select("ProductID", r6("annual_demand").alias("annual_demand"), r6("Price").alias("Price"), "eoq")


def _recs(spark, sf):
    return inventory.inventory_recommendations(fx.transactions(spark, sf), fx.stand_in_forecast(spark, sf))


def q_inventory_recommendations(spark, sf):
    out = _recs(spark, sf)
    return out.select("ProductID", r6("avg_daily_demand").alias("avg_daily_demand"),
                      r6("demand_std_dev").alias("demand_std_dev"), "safety_stock",
                      r6("lead_time_demand").alias("lead_time_demand"), "reorder_point", "eoq", "days_of_supply")


def q_top_reorder(spark, sf):
    return inventory.top_reorder(_recs(spark, sf), 10).select("ProductID", "reorder_point")


def q_bundle_inventory(spark, sf, product=fx.BRAND):
    tx = fx.transactions(spark, sf, product)
    bundles = rule_views.all_rule_bundles(fx.rules(spark, sf, product))
    out = inventory.bundle_inventory(tx, fx.stand_in_forecast(spark, sf, product), bundles)
    return out.drop("confidence", "lift")


def q_inventory_plan(spark, sf):
    out = inventory.inventory_plan(fx.stand_in_forecast(spark, sf))
    return out.select("ProductID", *[r6(c).alias(c) for c in out.columns if c != "ProductID"])


# ---------------------------------------------------------------- report tables
def q_top_rules_table(spark, sf, product=fx.BRAND):
    return rule_views.top_rules_table(fx.rules(spark, sf, product), 10)


def q_top_rules_by_lift(spark, sf, product=fx.BRAND):
    return rule_views.top_rules(fx.rules(spark, sf, product), "lift", 20, TOP_LIFT).select(*RULE_COLS)


def q_top_rules_by_confidence(spark, sf, product=fx.BRAND):
    return rule_views.top_rules(fx.rules(spark, sf, product), "confidence", 10, TOP_LIFT).select(*RULE_COLS)


def q_rule_labels(spark, sf):
    return rule_views.rule_labels(fx.rules(spark, sf, fx.TYPE))


def q_lift_matrix(spark, sf, product=fx.BRAND):
    tx = fx.transactions(spark, sf, product)
    return rule_views.lift_matrix(fx.rules(spark, sf, product), daily.top_products(tx, 15))


def q_association_report(spark, sf, product=fx.BRAND):
    return rule_views.association_report(fx.rules(spark, sf, product), min_support=0.102)


def q_rules_min_lift(spark, sf, product=fx.BRAND):
    return rule_views.rules_min_lift(fx.rules(spark, sf, product), 1.05).select(*RULE_COLS)


def q_combined_insights(spark, sf, product=fx.BRAND):
    out = reports.combined_insights(fx.rules(spark, sf, product), fx.stand_in_forecast(spark, sf, product))
    return out.withColumn("main_product_forecast", r6("main_product_forecast"))


def q_recommendation_text(spark, sf, product=fx.BRAND):
    ins = reports.combined_insights(fx.rules(spark, sf, product), fx.stand_in_forecast(spark, sf, product))
    return reports.recommendation_text(ins, 5)


def q_bundle_stock(spark, sf):
    """Flagship: rules -> strongest bundles -> bundle stock advice."""
    tx = fx.transactions(spark, sf)
    bundles = rule_views.product_bundles(fx.rules(spark, sf), min_confidence=0.12, min_lift=1.02)
    return inventory.bundle_inventory(tx, fx.stand_in_forecast(spark, sf), bundles).drop("confidence", "lift")


# ---------------------------------------------------------------- time-series models
def _r4(df, names):
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-10), 4) for c in names})


def q_arima_forecast(spark, sf):
    """ARIMA(2, 1, 1) per product, 30 days ahead."""
    return _r4(timeseries.arima_forecast(fx.daily_table(spark, sf)), ["Predicted_Quantity"])


def q_trend_season_forecast(spark, sf):
    """Trend, weekday and yearly waves per product, 30 days ahead."""
    return _r4(timeseries.trend_season_forecast(fx.daily_table(spark, sf)), ["Predicted_Quantity"])


def q_forecast_intervals(spark, sf):
    """The same forecast with 90 % intervals from six backtests."""
    return _r4(timeseries.forecast_intervals(fx.daily_table(spark, sf)), ["Predicted_Quantity", "lower", "upper"])


def q_association_adjusted_forecast(spark, sf):
    """The stand-in forecast moved along rule confidences to the fixed point."""
    day = fx.daily_table(spark, sf)
    out = association_forecast.adjusted_forecast(day, fx.stand_in_forecast(spark, sf, daily=day), fx.rules(spark, sf))
    return _r4(out, ["Predicted_Quantity", "influence", "Adjusted_Quantity"])


def q_bundle_forecast(spark, sf):
    """The stand-in forecast dealt to bundles (all item sets behind the rules) and summed on every level."""
    tx, rules = fx.transactions(spark, sf, fx.TYPE), fx.rules(spark, sf, fx.TYPE)
    bundles = rules.select(F.concat("antecedents", "consequents").alias("items"))
    return bundle_forecast.bundle_forecast(fx.stand_in_forecast(spark, sf, fx.TYPE), baskets.basket_lines(tx), bundles)


# ---------------------------------------------------------------- time ranges, periods, categories
def _history(spark, sf):
    return history.write_history(fx.transactions(spark, sf, "CAST(p_partkey AS STRING)"), _scratch(spark, "history"))


def q_sales_by_category(spark, sf):
    """Sales of three categories (brands of the parts) from 15 January 1996 to 30 June 1997, by month."""
    rows = history.read_history(spark, _history(spark, sf), dt.date(1996, 1, 15), dt.date(1997, 6, 30))
    brands = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("ProductID"), F.col("p_brand").alias("Category"))
    return history.with_category(rows, brands, SELECTED[:3]).groupBy("SaleMonth", "Category").agg(
        F.sum("Quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


def q_sales_in_periods(spark, sf):
    """Sales of named quarters; which months a quarter has comes from the orders."""
    day = F.to_date("o_orderdate")
    quarters = table(spark, sf, "orders").select(
        F.concat(F.year(day), F.lit("Q"), F.quarter(day)).alias("period"), F.date_format(day, "yyyy-MM").alias(history.MONTH)).distinct()
    rows = history.in_periods(history.read_history(spark, _history(spark, sf)), quarters, ["1996Q3", "1997Q1"])
    return rows.groupBy("period").agg(F.sum("Quantity").alias("quantity"), F.count(F.lit(1)).alias("n"),
                                      F.countDistinct("ProductID").alias("products"))


# ---------------------------------------------------------------- selections, messy input, files
def q_inventory_selected(spark, sf):
    """Advice for some products only: the lead time starts where the forecast of all products starts."""
    tx = fx.transactions(spark, sf).where("ProductID <> 'Brand#23' OR Date < DATE'1998-06-01'")  # one stops selling early
    recs, _ = flows.inventory_advice(tx, fx.stand_in_forecast(spark, sf), products=SELECTED)
    return recs.select("ProductID", "safety_stock", r6("lead_time_demand").alias("lead_time_demand"), "reorder_point", "eoq",
                       "days_of_supply")


def q_safety_stock_99(spark, sf):
    out = inventory.safety_stock(fx.transactions(spark, sf), service_level=0.99, lead_time_days=14)
    return out.select("ProductID", r6("mean").alias("mean"), r6("std").alias("std"), "safety_stock")


def q_product_filter(spark, sf):
    """Rows of the selected products by an IN list, of all products by a semi join with itself."""
    tx = fx.transactions(spark, sf)
    listed = filter_products(tx, SELECTED).groupBy("ProductID").agg(F.count(F.lit(1)).alias("n"))
    big = tx.groupBy("ProductID").agg(F.sum("Quantity").alias("q")).where("q % 2 = 0").select("ProductID")
    semi = filter_products(tx, big).groupBy("ProductID").agg(F.count(F.lit(1)).alias("n"))
    return listed.withColumn("how", F.lit("list")).unionByName(semi.withColumn("how", F.lit("semi")))


def q_product_history(spark, sf):
    return daily.product_history(daily.daily_sales(fx.transactions(spark, sf)), SELECTED[:1]).select("Date", "ProductID", "Quantity")


def q_forecast_stats_one(spark, sf):
    out = forecast.forecast_summary(fx.stand_in_forecast(spark, sf), SELECTED[1:2])
    return out.select("ProductID", *[r6(c).alias(c) for c in ("total", "average", "min", "max")])


def q_display_rounding(spark, sf):
    """Halves and other values, rounded half to even for display."""
    halves = fx.transactions(spark, sf).select("TransactionID", "ProductID", (F.col("Quantity") / 8).alias("eighths"),
                                              (F.col("Quantity") / 2).alias("halves"), "Quantity")
    out = reports.rounded(halves, 2, ["eighths"])
    return reports.rounded(out, 0, ["halves"])


def _messy(spark, sf):
    """The test tables as an export would hold them: odd headers, text everywhere, three date
    formats, quantities that are not numbers, missing keys."""
    n = F.col("l_linenumber")
    day = F.col("o_orderdate").cast("date")
    date = (F.when(n == 1, F.date_format(day, "MM/dd/yyyy")).when(n == 2, F.date_format(day, "MMM d, yyyy"))
            .when(n == 7, F.lit(None)).otherwise(F.date_format(day, "yyyy-MM-dd")))
    whole = F.col("l_quantity").cast("int")
    quantity = (F.when(whole % 10 == 3, F.lit("n/a")).when(whole % 10 == 7, F.lit(None))
                .when(whole % 10 == 5, F.concat(F.lit("-"), whole.cast("string"))).otherwise(whole.cast("string")))
    return tpch_lines(spark, sf).select(
        date.alias("Order Date"), F.col("l_orderkey").alias("Invoice-No"), F.when(n != 6, F.col("_product")).alias("SKU"),
        F.col("_product").alias("Product Name"), quantity.alias("Qty"), F.col("p_retailprice").cast("string").alias("Price"))


def _cleaned(df):
    return df.groupBy("TransactionID", "Date", "ProductID").agg(
        F.sum("Quantity").alias("Quantity"), F.count(F.lit(1)).alias("n"), r6(F.sum("Price")).alias("price"))


def q_clean_messy(spark, sf):
    return _cleaned(normalize_transactions(stored(_messy(spark, sf))))  # read twice: for the date format, then for the rows


def _scratch(spark, name):
    """A folder for files that every machine sees: below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_csv_upload(spark, sf):
    """The messy table as a folder of CSV files, read back by the upload step."""
    path = write_csv(_messy(spark, sf), _scratch(spark, "sales"))
    return _cleaned(flows.upload(spark, path, fmt="csv").transactions)


def q_csv_roundtrip(spark, sf):
    """The report sinks: rules, forecast, summary, insights and plan written as CSV and read back."""
    rules, fc = cut_lineage(fx.rules(spark, sf, fx.TYPE)), cut_lineage(fx.stand_in_forecast(spark, sf, fx.TYPE))
    tables = {"rules": rules.select("antecedents", "consequents"), "forecast": fc.select("Date", "ProductID"),
              "summary": forecast.forecast_summary(fc).select("ProductID"),
              "insights": reports.combined_insights(rules, fc).select("main_product", "associated_products"),
              "plan": inventory.inventory_plan(fc).select("ProductID")}
    out = None
    for name, df in tables.items():
        back = spark.read.option("header", True).csv(write_csv(df, _scratch(spark, name)))
        lines = back.select(F.lit(name).alias("report"), F.concat_ws("|", *[f"`{c}`" for c in back.columns]).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


QUERIES: dict[str, Query] = {
    "clean_transactions": q_clean_transactions,
    "synth_txn_id": q_synth_txn_id,
    "validation_profile": q_validation_profile,
    "basket_lines": q_basket_lines,
    "product_list": q_product_list,
    "dataset_stats": q_dataset_stats,
    "preview": q_preview,
    "baskets": q_baskets,
    "frequent_itemsets": q_frequent_itemsets,
    "frequent_itemsets_brand": q_frequent_itemsets_brand,
    "association_rules": q_association_rules,
    "rule_metrics": q_rule_metrics,
    "association_rules_brand": q_association_rules_brand,
    "top_associations": q_top_associations,
    "product_bundles": q_product_bundles,
    "cross_sell": q_cross_sell,
    "all_rule_bundles": q_all_rule_bundles,
    "associated_products": q_associated_products,
    "associated_forecast": q_associated_forecast,
    "daily_sales": q_daily_sales,
    "sales_trend_day": _trend("day"),
    "sales_trend_week": _trend("week"),
    "sales_trend_month": _trend("month"),
    "sales_trend_stats": q_sales_trend_stats,
    "top_products": q_top_products,
    "associated_sales_comparison": q_associated_sales_comparison,
    "forecast_summary": q_forecast_summary,
    "rule_item_frequency": q_rule_item_frequency,
    "demand_stats": q_demand_stats,
    "time_features": q_time_features,
    "lag_features": q_lag_features,
    "rolling_means": q_rolling_means,
    "rolling_std": q_rolling_std,
    "association_feature": q_association_feature,
    "forecast_features": q_forecast_features,
    "latest_lag_state": q_latest_lag_state,
    "train_split": q_train_split,
    "future_grid": q_future_grid,
    "demand_forecast": q_demand_forecast,
    "feature_importance": q_feature_importance,
    "holdout_accuracy": q_holdout_accuracy,
    "demand_forecast_fixed": q_demand_forecast_fixed,
    "holdout_accuracy_fixed": q_holdout_accuracy_fixed,
    "feature_importance_fixed": q_feature_importance_fixed,
    "forecast_accuracy": q_forecast_accuracy,
    "scenario_forecast": q_scenario_forecast,
    "actual_vs_forecast": q_actual_vs_forecast,
    "forecast_report": q_forecast_report,
    "arima_forecast": q_arima_forecast,
    "trend_season_forecast": q_trend_season_forecast,
    "forecast_intervals": q_forecast_intervals,
    "association_adjusted_forecast": q_association_adjusted_forecast,
    "bundle_forecast": q_bundle_forecast,
    "sales_by_category": q_sales_by_category,
    "sales_in_periods": q_sales_in_periods,
    "safety_stock": q_safety_stock,
    "reorder_points": q_reorder_points,
    "economic_order_quantity": q_economic_order_quantity,
    "inventory_recommendations": q_inventory_recommendations,
    "top_reorder": q_top_reorder,
    "bundle_inventory": q_bundle_inventory,
    "bundle_stock": q_bundle_stock,
    "inventory_plan": q_inventory_plan,
    "top_rules_table": q_top_rules_table,
    "top_rules_by_lift": q_top_rules_by_lift,
    "top_rules_by_confidence": q_top_rules_by_confidence,
    "rule_labels": q_rule_labels,
    "lift_matrix": q_lift_matrix,
    "association_report": q_association_report,
    "rules_min_lift": q_rules_min_lift,
    "combined_insights": q_combined_insights,
    "recommendation_text": q_recommendation_text,
    "inventory_selected": q_inventory_selected,
    "safety_stock_99": q_safety_stock_99,
    "product_filter": q_product_filter,
    "product_history": q_product_history,
    "forecast_stats_one": q_forecast_stats_one,
    "display_rounding": q_display_rounding,
    "clean_messy": q_clean_messy,
    "csv_upload": q_csv_upload,
    "csv_roundtrip": q_csv_roundtrip,
}

# Queries over rules, again over product types: rules with up to three items on a side.
QUERIES |= {f"{name}_multi": partial(QUERIES[name], product=fx.TYPE) for name in MULTI}
