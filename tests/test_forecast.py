import datetime as dt

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from basketcast.operators.features import forecast_features
from basketcast.operators.forecast import (actual_vs_forecast, feature_importance, forecast_accuracy,
                                           forecast_report, forecast_summary, future_grid, predict_demand,
                                           scenario_forecasts, train_model, train_split, training_frame)
from basketcast.plans import fixtures as fx
from conftest import SF_SMALL


def test_train_split_counts(spark):
    tx = fx.transactions(spark, SF_SMALL)
    frame, names = training_frame(forecast_features(tx))
    n = frame.count()
    split = train_split(frame, 0.8)
    assert split.filter("is_train").count() == int(n * 0.8)
    last_train = split.filter("is_train").agg(F.max("Date")).first()[0]
    first_test = split.filter("NOT is_train").agg(F.min("Date")).first()[0]
    assert last_train <= first_test
    assert "Quantity" not in names and "ProductID" not in names


def test_model_forecast_shape_and_clip(spark):
    tx = fx.transactions(spark, SF_SMALL)
    small = GBTRegressor(featuresCol="features", labelCol="Quantity", maxIter=3, maxDepth=3, seed=42)
    products = [r.ProductID for r in tx.select("ProductID").distinct().orderBy("ProductID").limit(3).collect()]
    model = train_model(tx, products, rules=fx.rules(spark, SF_SMALL), regressor=small)
    assert "AssociatedProductSales" in model.feature_names
    fc = predict_demand(model, tx, products, horizon=10)
    rows = fc.collect()
    last = predict_demand(model, tx, products, horizon=10, rules=fx.rules(spark, SF_SMALL), association_value="last")
    assert last.count() == 30
    assert len(rows) == 3 * 10 and all(r.Predicted_Quantity >= 0 for r in rows)
    end = tx.agg(F.max("Date")).first()[0]
    assert min(r.Date for r in rows) == end + dt.timedelta(days=1)
    assert feature_importance(model).count() == 15
    rep = forecast_report(fc, tx).collect()
    assert sorted({r.ForecastDate for r in rep}) == [end + dt.timedelta(days=i) for i in range(1, 11)]
    assert forecast_summary(fc).count() == 3
    assert actual_vs_forecast(tx, fc, products).filter("series = 'forecast'").count() == 30


def test_future_grid_and_scenarios(spark):
    tx = fx.transactions(spark, SF_SMALL)
    n_products = tx.select("ProductID").distinct().count()
    grid = future_grid(tx, horizon=5)
    assert grid.count() == 5 * n_products
    fc = grid.withColumn("Predicted_Quantity", F.lit(2.0))
    sc = scenario_forecasts(fc, {"base": {}, "up": {"Brand#11": 1.5}})
    got = {(r.scenario, r.ProductID): r.Predicted_Quantity for r in sc.collect()}
    assert got[("up", "Brand#11")] == 3.0 and got[("base", "Brand#11")] == 2.0 and got[("up", "Brand#12")] == 2.0


def test_accuracy(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (4.0, 4.0)], "actual double, predicted double")
    r = forecast_accuracy(df).first()
    assert abs(r.RMSE - (2 / 3) ** 0.5) < 1e-12 and abs(r.MAPE - 25.0) < 1e-12
    none = forecast_accuracy(spark.createDataFrame([(0.0, 1.0)], "actual double, predicted double")).first()
    assert none.MAPE is None


def test_product_identity_option(spark):
    tx = fx.transactions(spark, SF_SMALL)
    small = GBTRegressor(featuresCol="features", labelCol="Quantity", maxIter=2, maxDepth=2, seed=1)
    products = [r.ProductID for r in tx.select("ProductID").distinct().orderBy("ProductID").limit(2).collect()]
    model = train_model(tx, products, regressor=small, product_identity=True)
    assert predict_demand(model, tx, products, horizon=3).count() == 6
