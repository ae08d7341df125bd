"""Bundle forecasts: levels agree exactly, shares follow past baskets."""

import datetime as dt

from pyspark.sql import functions as F

from basketcast.operators.bundle_forecast import basket_parts, bundle_forecast

DAY = dt.date(2024, 5, 1)


def inputs(spark):
    baskets = {"1": "ab", "2": "abc", "3": "a", "4": "c", "5": "abc", "6": "bc"}
    lines = spark.createDataFrame([(t, p, 1.0) for t, items in baskets.items() for p in items],
                                  "TransactionID string, ProductID string, Quantity double")
    bundles = spark.createDataFrame([(["b", "a"],), (["a", "b", "c"],), (["c", "b"],), (["a", "b"],), (["a", "x"],), (["c"],)],
                                    "items array<string>")
    forecast = spark.createDataFrame([(DAY, "a", 10.0), (DAY, "b", 0.001), (DAY, "c", 7.7777), (DAY, "new", 2.5),
                                      (DAY + dt.timedelta(days=1), "a", None), (DAY + dt.timedelta(days=1), "c", 1e15)],
                                     "Date date, ProductID string, Predicted_Quantity double")
    return forecast, lines, bundles


def test_lines_count_for_the_largest_bundle(spark):
    _, lines, bundles = inputs(spark)
    got = {(r.ProductID, r.bundle): r.n for r in basket_parts(lines, bundles).collect()}
    assert got == {("a", "a, b"): 1, ("b", "a, b"): 1, ("a", "a, b, c"): 2, ("b", "a, b, c"): 2, ("c", "a, b, c"): 2,
                   ("b", "b, c"): 1, ("c", "b, c"): 1, ("a", ""): 1, ("c", ""): 1}


def test_levels_agree_exactly(spark):
    forecast, lines, bundles = inputs(spark)
    out = {}
    for r in bundle_forecast(forecast, lines, bundles).collect():
        out.setdefault(r.level, {})[r.Date, r.ProductID, r.bundle] = r.units
    wanted = {(r.Date, r.ProductID): round((r.Predicted_Quantity or 0.0) * 1000) for r in forecast.collect()}
    assert {(d, p): u for (d, p, _), u in out["product"].items()} == wanted
    for level, key in (("product", lambda d, p, b: (d, p, None)), ("bundle", lambda d, p, b: (d, None, b)), ("total", lambda d, p, b: (d, None, None))):
        sums = {}
        for (d, p, b), u in out["part"].items():
            sums[key(d, p, b)] = sums.get(key(d, p, b), 0) + u
        assert sums == out[level]
    a = {b: u for (d, p, b), u in out["part"].items() if p == "a" and d == DAY}
    assert a == {"": 2500, "a, b": 2500, "a, b, c": 5000}
    assert out["part"][DAY, "new", ""] == 2500


def test_without_bundles_or_forecast(spark):
    forecast, lines, bundles = inputs(spark)
    alone = bundle_forecast(forecast, lines, bundles.limit(0))
    assert {r.bundle for r in alone.where("level = 'part'").select("bundle").collect()} == {""}
    assert bundle_forecast(forecast.limit(0), lines, bundles).where(F.col("level") != "total").count() == 0
    assert bundle_forecast(forecast, lines.limit(0), bundles).where("level = 'total'").count() == 2
