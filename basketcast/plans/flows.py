"""The three flows of the reference, composed from the operators.

* upload -> clean -> validate -> basket lines -> itemsets -> rules
* history (+ rules) -> features -> model -> forecast
* history + forecast (+ rules) -> inventory advice, bundle stock, report tables

Each step returns DataFrames; nothing is collected except the validation verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basketcast.operators import forecast as fc
from basketcast.operators import inventory, reports, rule_views
from basketcast.operators.baskets import basket_lines, dataset_stats, product_list
from basketcast.operators.clean import filter_products, normalize_transactions
from basketcast.operators.daily import daily_sales, sales_trend, sales_trend_stats, top_products
from basketcast.operators.rules import mine_rules
from basketcast.operators.validate import validate
from basketcast.session import cut_lineage, stored
from basketcast.sources.transactions import read_transactions


@dataclass
class Upload:
    transactions: DataFrame
    basket_lines: DataFrame
    products: DataFrame
    stats: DataFrame
    valid: bool
    message: str


def upload(spark: SparkSession, path: str, fmt: str | None = None) -> Upload:
    """Read CSV or Parquet (a file, a folder or a glob), clean it and validate it (raises on
    an unusable file)."""
    tx = stored(normalize_transactions(read_transactions(spark, path, fmt)))  # text is cleaned once, not for every result
    ok, message = validate(tx)
    return Upload(tx, basket_lines(tx), product_list(tx), dataset_stats(tx), ok, message)


def associations(tx: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5,
                 min_lift: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets (at most 4 items) and rules sorted by lift."""
    return mine_rules(tx, min_support, min_confidence, min_lift, sort=True)


def demand_forecast(tx: DataFrame, products=None, rules: DataFrame | None = None, horizon: int = 30,
                    train_ratio: float = 0.8, **model_options) -> tuple[fc.ForecastModel, DataFrame]:
    """Train on the selected products (with the associated-product feature when rules
    are given) and forecast ``horizon`` days. The daily table is computed once and all steps
    read it."""
    daily = cut_lineage(daily_sales(tx))
    model = fc.train_model(daily, products, rules, train_ratio, **model_options)
    return model, fc.predict_demand(model, daily, products, horizon)


def inventory_advice(tx: DataFrame, forecast: DataFrame, rules: DataFrame | None = None, products=None,
                     lead_time_days: int = 7, service_level: float = 0.95,
                     holding_cost_pct: float = 0.25) -> tuple[DataFrame, DataFrame | None]:
    """Per-product recommendations and, with rules, bundle stock for the selected products.

    The lead time starts the day after the history of all products ends, whichever are
    selected: that is where the forecast starts.
    """
    as_of = inventory.default_as_of(tx)
    hist = filter_products(tx, products)
    fcast = filter_products(forecast, products)
    recs = inventory.inventory_recommendations(hist, fcast, lead_time_days, service_level, holding_cost_pct, as_of=as_of)
    bundles = None
    if rules is not None:
        bundles = inventory.bundle_inventory(hist, fcast, rule_views.all_rule_bundles(rules), lead_time_days,
                                             service_level, holding_cost_pct, as_of=as_of)
    return recs, bundles


def report_tables(tx: DataFrame, rules: DataFrame, forecast: DataFrame, min_support: float = 0.01,
                  min_lift: float = 1.2, top_n: int = 15, period: str = "week") -> dict[str, DataFrame]:
    """The data behind the report and chart pages."""
    trend = sales_trend(tx, None, period)
    insights = reports.combined_insights(rules, forecast)
    return {
        "top_rules": rule_views.top_rules_table(rules),
        "association_report": rule_views.association_report(rules, min_support),
        "rules_min_lift": rule_views.rules_min_lift(rules, min_lift),
        "rule_item_frequency": rule_views.rule_item_frequency(rules),
        "lift_matrix": rule_views.lift_matrix(rules, top_products(tx, top_n)),
        "sales_trend": trend,
        "sales_trend_stats": sales_trend_stats(trend),
        "forecast_report": fc.forecast_report(forecast, tx),
        "forecast_summary": fc.forecast_summary(forecast),
        "combined_insights": insights,
        "recommendations": reports.recommendation_text(insights),
        "inventory_plan": inventory.inventory_plan(forecast),
    }
