"""Time-series models against fits worked in numpy, short and empty series, and intervals that cover."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketcast.operators import timeseries as ts
from basketcast.plans import fixtures as fx
from conftest import SF_SMALL

START = dt.date(2024, 1, 1)
SCHEMA = "Date date, ProductID string, Quantity double"


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 20 + 0.01 * t + 5 * (t % 7 == 2) + 3 * np.sin(2 * math.pi * t / ts.YEAR) + rng.normal(0, 1, n)
    y[rng.random(n) < 0.1] = 0.0  # days without sales
    y[0] = 1.0
    y[-1] = 21.0
    return y


def rows(product, y, start=START):
    return [(start + dt.timedelta(days=i), product, float(v)) for i, v in enumerate(y) if v]


@pytest.fixture(scope="module")
def series(spark):
    """Two long products, one first sold late, one sold on the last day only, one row without a date."""
    a, b = noisy(500, 1), noisy(500, 2)
    late = b[400:]
    data = rows("a", a) + rows("b", b) + rows("late", late, START + dt.timedelta(days=400))
    data += [(START + dt.timedelta(days=499), "once", 4.0), (None, "a", 9.0)]
    return spark.createDataFrame(data, SCHEMA), {"a": a, "b": b, "late": late}


def by_product(df):
    out = {}
    for r in df.orderBy("ProductID", "Date").collect():
        out.setdefault(r.ProductID, []).append(r.Predicted_Quantity)
    return out


def test_dense_series_fills_days_without_sales(series):
    df, truth = series
    got = ts.dense_series(df).groupBy("ProductID").agg(F.count(F.lit(1)).alias("n"), F.sum("Quantity").alias("q"), F.max("t").alias("t"))
    for r in got.collect():
        want = truth.get(r.ProductID, np.array([4.0]))
        assert r.n == len(want) and r.t == len(want) - 1 and abs(r.q - want.sum()) < 1e-8


def arima_by_hand(y, p, d, q, horizon, m=7):
    w = np.diff(y, d)
    e = np.full(len(w), np.nan)
    if q:
        x = np.array([[1, *w[t - m:t][::-1]] for t in range(m, len(w))])
        e[m:] = w[m:] - x @ np.linalg.lstsq(x, w[m:], rcond=None)[0]
    first = max(p, m + q if q else 0)
    x = np.array([[1, *[w[t - i] for i in range(1, p + 1)], *[e[t - i] for i in range(1, q + 1)]] for t in range(first, len(w))])
    c = np.linalg.lstsq(x, w[first:], rcond=None)[0]
    own, shocks = list(w[::-1][:p]), list(e[::-1][:q])
    levels, out = [np.diff(y, j)[-1] for j in range(d)], []
    for _ in range(horizon):
        v = c[0] + np.dot(c[1:1 + p], own) + np.dot(c[1 + p:], shocks)
        own, shocks = [v, *own][:p], [0.0, *shocks][:q]
        for j in reversed(range(d)):
            levels[j] += v if j == d - 1 else levels[j + 1]
        out.append(max(levels[0] if d else v, 0.0))
    return out


@pytest.mark.parametrize("order", [(2, 1, 1), (3, 0, 0), (1, 2, 2), (0, 1, 0)])
def test_arima_equals_regressions_by_hand(series, order):
    df, truth = series
    got = by_product(ts.arima_forecast(df, *order, horizon=9))
    for name, y in truth.items():
        assert np.allclose(got[name], arima_by_hand(y, *order, 9), rtol=1e-6, atol=1e-6), name
    flat = 4.0 if order[1] else 0.0  # too short for any regression
    assert got["once"] == [flat] * 9


def columns(day, end, harmonics=3):
    n = (day - dt.date(1970, 1, 1)).days
    waves = [f(n * 2 * math.pi * i / ts.YEAR) for i in range(1, harmonics + 1) for f in (math.sin, math.cos)]
    return [1.0, (day - end).days / ts.YEAR, *[float(day.weekday() == i) for i in range(7)], *waves]


def test_trend_season_equals_ridge_by_hand(series):
    df, truth = series
    end = START + dt.timedelta(days=499)
    got = by_product(ts.trend_season_forecast(df, horizon=10))
    for name, y in {**truth, "once": np.array([4.0])}.items():
        x = np.array([columns(end - dt.timedelta(days=len(y) - 1 - i), end) for i in range(len(y))])
        ridge = np.eye(x.shape[1])
        ridge[0, 0] = 0
        b = np.linalg.solve(x.T @ x + ridge, x.T @ y)
        want = [max(np.dot(b, columns(end + dt.timedelta(days=h), end)), 0.0) for h in range(1, 11)]
        assert np.allclose(got[name], want, rtol=1e-7, atol=1e-7), name


def test_intervals_cover_days_held_back(spark):
    daily = fx.daily_table(spark, SF_SMALL)
    end = daily.agg(F.max("Date")).first()[0]
    seen = daily.where(F.col("Date") <= F.lit(end - dt.timedelta(days=20)))
    last = seen.agg(F.max("Date")).first()[0]
    out = ts.forecast_intervals(seen, horizon=20, coverage=0.8)
    actual = daily.where(F.col("Date") > F.lit(last))
    r = out.join(actual, ["Date", "ProductID"], "left").fillna(0.0, ["Quantity"]).agg(
        F.avg(F.expr("int(Quantity BETWEEN lower AND upper)")).alias("inside"), F.count(F.lit(1)).alias("n"),
        F.min(F.expr("lower <= Predicted_Quantity AND Predicted_Quantity <= upper")).alias("ordered")).first()
    assert r.n == 20 * daily.select("ProductID").distinct().count() and r.ordered
    assert 0.7 <= r.inside <= 0.95


def test_intervals_without_enough_history_are_open(spark):
    daily = spark.createDataFrame(rows("a", [3.0, 4.0, 5.0]), SCHEMA)
    got = ts.forecast_intervals(daily, horizon=5, origins=2).collect()
    assert len(got) == 5 and all(r.lower == 0.0 and r.upper is None for r in got)


def test_no_sales_no_forecast(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ts.arima_forecast(empty).count() == ts.trend_season_forecast(empty).count() == 0
    assert ts.forecast_intervals(empty).columns == ["Date", "ProductID", "Predicted_Quantity", "lower", "upper"]
    with pytest.raises(ValueError):
        ts.arima_forecast(empty, p=-1)
    with pytest.raises(ValueError):
        ts.forecast_intervals(empty, coverage=1.0)
