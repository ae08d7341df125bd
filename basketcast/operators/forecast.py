"""Demand model: training set, chronological split, boosted trees, scoring, evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketcast.operators.boosting import BoostedTrees, fit_boosted_trees
from basketcast.operators.clean import filter_products
from basketcast.operators.daily import daily_sales
from basketcast.operators.features import (ASSOCIATION_FEATURE, association_feature, forecast_features,
                                           latest_lag_state, time_feature_columns)
from basketcast.session import broadcast_if_small, cut_lineage, keep, materialize, scalar

NON_FEATURES = ("Date", "ProductID", "Quantity")
TRAIN_ROWS_PER_PARTITION = 250_000


@dataclass
class ForecastModel:
    model: BoostedTrees | PipelineModel  # either adds a ``prediction`` column in ``transform``
    feature_names: list[str] = field(default_factory=list)


def training_frame(features: DataFrame, products=None) -> tuple[DataFrame, list[str]]:
    """Selected products' feature rows without nulls, and the feature column names."""
    frame = filter_products(features, products).dropna()
    names = [c for c in frame.columns if c not in NON_FEATURES]
    return frame, names


def train_split(frame: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """Add ``is_train``: the first ``int(n * ratio)`` rows in date order (ties by product).

    Rows per date are counted and summed into offsets on the date table (one row per
    day, broadcast after a size check). Only the one date that straddles the
    boundary needs a rank; its rows (at most one per product) are ranked apart and
    joined back, so the frame keeps its partitioning.
    """
    frame = keep(frame)  # read by the per-day counts, the boundary ranks and the final join
    per_day, _, _ = materialize(frame.groupBy("Date").agg(F.count(F.lit(1)).alias("_c")))
    n = scalar(per_day.agg(F.sum("_c")), 0)
    cut = int(n * train_ratio)
    upto = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(per_day.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))))
    straddles = (F.col("_before") < F.lit(cut)) & (F.col("_before") + F.col("_c") > F.lit(cut))
    edge = offsets.filter(straddles).select("Date", "_before")
    ranked = frame.select("Date", "ProductID").join(edge, "Date") \
        .withColumn("_edge_train", (F.col("_before") + F.row_number().over(
            Window.partitionBy("Date").orderBy("ProductID"))) <= F.lit(cut)) \
        .drop("_before")
    marked = frame.join(offsets, "Date").join(broadcast_if_small(ranked), ["Date", "ProductID"], "left")
    whole_day = (F.col("_before") + F.col("_c")) <= F.lit(cut)
    return marked.withColumn("is_train", F.coalesce(F.col("_edge_train"), whole_day)) \
                 .drop("_c", "_before", "_edge_train")


def gbt_regressor(features_col: str = "features", label_col: str = "Quantity") -> GBTRegressor:
    """Spark's own boosted trees with the same numbers; it samples features per node, not per tree."""
    return GBTRegressor(featuresCol=features_col, labelCol=label_col, predictionCol="prediction",
                        lossType="squared", maxIter=100, maxDepth=6, stepSize=0.1,
                        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)


def train_model(tx: DataFrame, products=None, rules: DataFrame | None = None, train_ratio: float = 0.8,
                regressor: GBTRegressor | None = None, product_identity: bool = False) -> ForecastModel:
    """Fit one global model on the training share of the selected products' feature rows.

    The model is 100 boosted trees of depth 6, step 0.1, with 0.8 of the rows and of the columns drawn once per
    tree (``operators.boosting``). Like the reference, it has no product identity by default;
    ``product_identity=True`` adds a one-hot product vector. That, or a ``regressor``, is fitted by Spark ML.
    """
    frame, names = training_frame(forecast_features(tx, rules), products)
    frame = keep(frame)
    if frame.isEmpty():
        frame.unpersist()
        raise ValueError("No valid data for forecasting after preprocessing.")
    train = cut_lineage(train_split(frame, train_ratio).filter("is_train"))
    frame.unpersist()
    if regressor is None and not product_identity:
        return ForecastModel(fit_boosted_trees(train, names, "Quantity", F.xxhash64("Date", "ProductID")), names)
    # Boosting runs one job per tree level; size the partitions by rows, not by cores.
    rows = train.count()
    train = keep(train.repartition(max(1, math.ceil(rows / TRAIN_ROWS_PER_PARTITION))))
    stages, inputs = [], list(names)
    if product_identity:
        stages += [StringIndexer(inputCol="ProductID", outputCol="_product_index", handleInvalid="keep"),
                   OneHotEncoder(inputCols=["_product_index"], outputCols=["_product_vec"], handleInvalid="keep")]
        inputs.append("_product_vec")
    stages += [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
               regressor or gbt_regressor()]
    fitted = Pipeline(stages=stages).fit(train)
    train.unpersist()
    return ForecastModel(fitted, inputs)


def last_date(tx: DataFrame):
    return scalar(tx.agg(F.max("Date")))


def future_grid(tx: DataFrame, products=None, horizon: int = 30) -> DataFrame:
    """(ProductID, Date) for each product with history and each of the ``horizon`` days
    after the latest date of all data; dates come from ``explode(sequence)``."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    end = last_date(tx)
    prods = filter_products(tx, products).select("ProductID").distinct()
    days = F.sequence(F.date_add(F.lit(end), 1), F.date_add(F.lit(end), horizon))
    return prods.select("ProductID", F.explode(days).alias("Date"))


def scoring_frame(tx: DataFrame, products=None, horizon: int = 30, feature_names: list[str] | None = None,
                  rules: DataFrame | None = None, association_value: str = "zero") -> DataFrame:
    """Future grid with calendar features and each product's frozen lag state.

    The associated-product feature is 0 when scoring, as in the reference;
    ``association_value='last'`` (needs ``rules``) uses each product's value on its
    newest history day instead.
    """
    hist = filter_products(tx, products)
    state = latest_lag_state(daily_sales(hist))
    grid = future_grid(tx, products, horizon)
    grid = grid.withColumns(time_feature_columns(F.col("Date"))).join(state, "ProductID")
    if feature_names and ASSOCIATION_FEATURE in feature_names:
        if association_value == "last" and rules is not None:
            assoc = association_feature(daily_sales(tx), rules).groupBy("ProductID").agg(
                F.max_by(ASSOCIATION_FEATURE, "Date").alias(ASSOCIATION_FEATURE))
            grid = grid.join(assoc, "ProductID", "left").fillna(0.0, [ASSOCIATION_FEATURE])
        elif association_value in ("zero", "last"):
            grid = grid.withColumn(ASSOCIATION_FEATURE, F.lit(0.0))
        else:
            raise ValueError("association_value must be 'zero' or 'last'")
    return grid


def predict_demand(model: ForecastModel, tx: DataFrame, products=None, horizon: int = 30,
                   rules: DataFrame | None = None, association_value: str = "zero") -> DataFrame:
    """``(Date, ProductID, Predicted_Quantity)``: direct multi-step scoring, clipped at 0."""
    grid = scoring_frame(tx, products, horizon, model.feature_names, rules, association_value)
    scored = model.model.transform(grid)
    return scored.select("Date", "ProductID",
                         F.greatest(F.col("prediction"), F.lit(0.0)).alias("Predicted_Quantity"))


def forecast_accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: RMSE over all rows, MAPE in % over rows with a non-zero actual (null if none)."""
    a, p = F.col(actual), F.col(predicted)
    return df.agg(
        F.sqrt(F.avg(F.pow(a - p, 2))).alias("RMSE"),
        (F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100).alias("MAPE"),
    )


def evaluate_holdout(model: ForecastModel, tx: DataFrame, products=None, rules: DataFrame | None = None,
                     train_ratio: float = 0.8) -> DataFrame:
    """Score the held-out share of the chronological split and report its accuracy."""
    frame, _ = training_frame(forecast_features(tx, rules), products)
    test = train_split(frame, train_ratio).filter(~F.col("is_train"))
    scored = model.model.transform(test.select("Quantity", *[c for c in frame.columns if c not in NON_FEATURES]))
    return forecast_accuracy(scored.select(F.col("Quantity").alias("actual"),
                                           F.col("prediction").alias("predicted")))


def scenario_forecasts(forecast: DataFrame, adjustments) -> DataFrame:
    """Forecast per scenario: products named in a scenario are multiplied by its factor.

    ``adjustments`` is ``{scenario: {product: factor}}`` or a frame
    ``(scenario, ProductID, factor)``; every scenario gets every forecast row.
    """
    spark = forecast.sparkSession
    if isinstance(adjustments, DataFrame):
        factors = adjustments.select("scenario", "ProductID", F.col("factor").cast("double"))
        # one row that holds the scenarios' names, joined to every forecast row
        names = factors.agg(F.array_sort(F.collect_set("scenario")).alias("_names"))
        out = forecast.join(F.broadcast(names)).withColumn("scenario", F.explode("_names")).drop("_names")
    else:
        rows = [(s, str(p), float(f)) for s, adj in adjustments.items() for p, f in adj.items()]
        factors = spark.createDataFrame(rows, "scenario string, ProductID string, factor double")
        out = forecast.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in adjustments])))
    out = out.join(broadcast_if_small(factors), ["scenario", "ProductID"], "left")
    return out.withColumn("Predicted_Quantity", F.col("Predicted_Quantity") * F.coalesce("factor", F.lit(1.0))) \
              .drop("factor")


def feature_importance(model: ForecastModel, top: int = 15) -> DataFrame:
    """Model feature importances by name, largest first (a model property, not data): for boosted trees
    each feature's mean gain per split as a share of all."""
    if isinstance(model.model, BoostedTrees):
        scored = model.model.importances().items()
    else:
        scores = model.model.stages[-1].featureImportances.toArray().tolist()
        names = [n for n in model.feature_names if n != "_product_vec"]
        names += [f"ProductID_{i}" for i in range(len(scores) - len(names))]
        scored = zip(names, scores, strict=False)
    rows = sorted(scored, key=lambda r: (-r[1], r[0]))[:top]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(n, float(s)) for n, s in rows], "feature string, importance double")


def actual_vs_forecast(tx: DataFrame, forecast: DataFrame, products=None) -> DataFrame:
    """Daily actuals and forecasts of the selected products in one long table."""
    actual = daily_sales(filter_products(tx, products)).select(
        F.lit("actual").alias("series"), "ProductID", "Date", F.col("Quantity").cast("double").alias("Quantity"))
    fc = filter_products(forecast, products).select(
        F.lit("forecast").alias("series"), "ProductID", "Date", F.col("Predicted_Quantity").alias("Quantity"))
    return actual.unionByName(fc)


def forecast_report(forecast: DataFrame, tx: DataFrame, products=None) -> DataFrame:
    """``(ProductID, ForecastDate, Predicted_Quantity)``: the k-th forecast row of a product
    (in date order) is dated k days after the last history date."""
    end = last_date(tx)
    sel = filter_products(forecast, products)
    day = F.row_number().over(Window.partitionBy("ProductID").orderBy("Date")) - 1
    return sel.withColumn("ForecastDay", day) \
              .select("ProductID", F.date_add(F.lit(end), (F.col("ForecastDay") + 1).cast("int")).alias("ForecastDate"),
                      "Predicted_Quantity")


def forecast_summary(forecast: DataFrame, products=None) -> DataFrame:
    return filter_products(forecast, products).groupBy("ProductID").agg(
        F.sum("Predicted_Quantity").alias("total"),
        F.avg("Predicted_Quantity").alias("average"),
        F.min("Predicted_Quantity").alias("min"),
        F.max("Predicted_Quantity").alias("max"),
    )
