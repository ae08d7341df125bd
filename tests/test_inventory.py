import datetime as dt

from basketcast.operators.inventory import (bundle_inventory, economic_order_quantity, inventory_plan,
                                            inventory_recommendations, safety_stock)

D = dt.date(2024, 1, 1)


def _hist(spark, rows):
    return spark.createDataFrame(rows, "TransactionID string, Date date, ProductID string, Quantity double, Price double")


def _fc(spark, rows):
    return spark.createDataFrame(rows, "Date date, ProductID string, Predicted_Quantity double")


def test_single_row_and_zero_price(spark):
    # B11: one row -> no std -> 0.2 x mean; B14: zero price -> eoq falls back to 2 x reorder point
    hist = _hist(spark, [("T1", D, "A", 10.0, 0.0), ("T2", D + dt.timedelta(days=10), "B", 4.0, 2.0),
                         ("T3", D + dt.timedelta(days=11), "B", 6.0, 2.0)])
    ss = {r.ProductID: r for r in safety_stock(hist).collect()}
    assert ss["A"].safety_stock == 2 and ss["A"].std is None
    recs = {r.ProductID: r for r in inventory_recommendations(hist, _fc(spark, [])).collect()}
    a = recs["A"]
    assert a.lead_time_demand == 70.0 and a.reorder_point == 72 and a.eoq == 144 and a.days_of_supply == 15
    eoq = {r.ProductID: r.eoq for r in economic_order_quantity(hist).collect()}
    assert eoq["A"] is None and eoq["B"] > 0


def test_lead_time_window_is_inclusive(spark):
    hist = _hist(spark, [("T1", D, "A", 5.0, 1.0), ("T2", D + dt.timedelta(days=1), "A", 5.0, 1.0)])
    start = D + dt.timedelta(days=2)
    fc = _fc(spark, [(start + dt.timedelta(days=i), "A", 1.0) for i in range(30)])
    r = inventory_recommendations(hist, fc, lead_time_days=7).first()
    assert r.lead_time_demand == 8.0  # as_of .. as_of + 7, both ends


def test_bundle_uses_own_span_and_half_even(spark):
    # B17: the bundle's order quantity uses its own products' date span
    rows = [("T1", D, "A", 2.0, 1.0), ("T2", D + dt.timedelta(days=1), "B", 2.0, 1.0),
            ("T3", D + dt.timedelta(days=300), "C", 2.0, 1.0)]
    hist = _hist(spark, rows)
    bundles = spark.createDataFrame([("A", "B", ["A", "B"], 1.0, 1.0)],
                                    "antecedents_str string, consequents_str string, items array<string>, "
                                    "confidence double, lift double")
    out = bundle_inventory(hist, _fc(spark, []), bundles).first()
    # annual demand for A in the bundle = 2 * 365 / 1 day -> eoq = ceil(sqrt(2*730*25/0.25)) = 383
    assert out.bundle_id == "A-B" and out.min_days_supply == 192
    # B20: safety stock ceil(0.4) = 1 each, mean 1; reorder ceil(14 + 1) = 15 each
    assert out.avg_safety_stock == 1 and out.avg_reorder_point == 15 and out.suggested_bundle_stock == 15


def test_inventory_plan(spark):
    fc = _fc(spark, [(D, "A", 1.0), (D, "A", 3.0), (D, "B", 2.0), (D, "B", 2.0)])
    out = {r.ProductID: r for r in inventory_plan(fc).collect()}
    assert out["A"].safety_stock == 1.5 and out["A"].reorder_point == 15.5
    assert out["B"].safety_stock == 0.4 and out["B"].suggested_order_quantity == 28.0


def test_bundle_means_round_half_to_even(spark):
    # B20: safety stocks 2 and 3 -> mean 2.5 -> 2 (Python round), reorder points 72 and 108 -> 90
    hist = _hist(spark, [("T1", D, "A", 10.0, 1.0), ("T2", D + dt.timedelta(days=5), "B", 15.0, 1.0)])
    bundles = spark.createDataFrame([("A", "B", ["A", "B"], 0.5, 3.0)],
                                    "antecedents_str string, consequents_str string, items array<string>, "
                                    "confidence double, lift double")
    out = bundle_inventory(hist, _fc(spark, []), bundles).first()
    assert out.avg_safety_stock == 2 and out.avg_reorder_point == 90
    assert out.suggested_bundle_stock == round(90 * 0.5 * 1.2)


def test_day_grain_statistics(spark):
    # B10 option: statistics over daily totals instead of transaction lines
    hist = _hist(spark, [("T1", D, "A", 1.0, 2.0), ("T2", D, "A", 3.0, 4.0), ("T3", D + dt.timedelta(days=1), "A", 2.0, 6.0)])
    line = inventory_recommendations(hist, _fc(spark, [])).first()
    day = inventory_recommendations(hist, _fc(spark, []), grain="day").first()
    assert line.avg_daily_demand == 2.0 and day.avg_daily_demand == 3.0


def test_display_rounding(spark):
    from basketcast.operators.reports import rounded
    df = spark.createDataFrame([("A", 2.675, 1.125, 3)], "p string, x double, y double, n int")
    r = rounded(df, 2).first()
    assert (r.p, r.y, r.n) == ("A", 1.12, 3)
