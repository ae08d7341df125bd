import datetime as dt
import math

from basketcast.operators.features import association_feature, lag_features, latest_lag_state, time_features


def _daily(spark, rows):
    return spark.createDataFrame(rows, "Date date, ProductID string, Quantity double")


def test_lags_by_position_and_rolling(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d + dt.timedelta(days=2 * i), "A", float(i + 1)) for i in range(10)]  # every other day
    out = lag_features(_daily(spark, rows)).orderBy("Date").collect()
    assert out[0].Quantity_Lag1 == 0.0 and out[1].Quantity_Lag1 == 1.0  # previous row, not previous day
    assert out[7].Quantity_Lag7 == 1.0
    assert out[0].Quantity_RollingStd7 == 0.0
    assert out[2].Quantity_RollingMean7 == 2.0
    assert math.isclose(out[9].Quantity_RollingMean7, sum(range(4, 11)) / 7)


def test_time_features(spark):
    out = time_features(_daily(spark, [(dt.date(2024, 3, 31), "A", 1.0)])).first()
    assert (out.Year, out.Month, out.Day, out.DayOfWeek, out.Quarter) == (2024, 3, 31, 6, 1)
    assert (out.WeekOfYear, out.IsWeekend, out.IsMonthStart, out.IsMonthEnd) == (13, 1, 0, 1)


def test_association_feature_counts_duplicate_pairs(spark):
    d = dt.date(2024, 1, 1)
    daily = _daily(spark, [(d, "A", 1.0), (d, "B", 10.0), (d, "C", 20.0), (d + dt.timedelta(days=1), "A", 2.0)])
    rules = spark.createDataFrame(
        [(["A"], ["B"], 0.5), (["A"], ["B", "D"], 0.25), (["C"], ["A"], 1.0)],
        "antecedents array<string>, consequents array<string>, confidence double")
    out = {(r.ProductID, r.Date): r.AssociatedProductSales for r in association_feature(daily, rules).collect()}
    # A on day 1: pairs (B,0.5), (B,0.25) sold; D never sold -> (10*0.5 + 10*0.25) / 2
    assert out[("A", d)] == (10 * 0.5 + 10 * 0.25) / 2
    assert out[("A", d + dt.timedelta(days=1))] == 0.0
    assert out[("C", d)] == 1.0 and out[("B", d)] == 0.0


def test_latest_lag_state(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d + dt.timedelta(days=i), "A", float(i)) for i in range(40)] + [(d, "B", 5.0)]
    st = {r.ProductID: r for r in latest_lag_state(_daily(spark, rows)).collect()}
    a = st["A"]
    assert (a.Quantity_Lag1, a.Quantity_Lag7, a.Quantity_Lag14, a.Quantity_Lag30) == (39.0, 33.0, 26.0, 10.0)
    assert a.Quantity_RollingMean30 == sum(range(10, 40)) / 30
    b = st["B"]
    assert (b.Quantity_Lag7, b.Quantity_RollingStd7) == (5.0, 0.0)
