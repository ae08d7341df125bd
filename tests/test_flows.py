from pyspark.ml.regression import GBTRegressor

from basketcast.plans import flows


def test_flows_end_to_end(spark, tmp_path):
    src = tmp_path / "sales.csv"
    lines = ["TransactionID,Date,ProductID,ProductName,Quantity,Price"]
    for t in range(40):
        day = 1 + t % 20
        for p in ("P1", "P2") if t % 2 else ("P1", "P3", "P2"):
            lines.append(f"T{t:03d},2024-01-{day:02d},{p},name {p},{1 + t % 3},{2.5 if p == 'P1' else 4.0}")
    src.write_text("\n".join(lines) + "\n")
    up = flows.upload(spark, str(src))
    assert up.valid and up.products.count() == 3
    itemsets, rules = flows.associations(up.transactions, min_support=0.1, min_confidence=0.3, min_lift=0.0)
    assert rules.count() > 0
    small = GBTRegressor(featuresCol="features", labelCol="Quantity", maxIter=2, maxDepth=2, seed=42)
    model, forecast = flows.demand_forecast(up.transactions, rules=rules, horizon=7, regressor=small)
    assert forecast.count() == 3 * 7
    recs, bundles = flows.inventory_advice(up.transactions, forecast, rules)
    assert recs.count() == 3 and bundles.count() == rules.count()
    tables = flows.report_tables(up.transactions, rules, forecast)
    assert all(df.count() >= 0 for df in tables.values())


def test_selected_products_get_the_same_advice(spark):
    # A stops selling 10 days before the others: the lead time still starts where the forecast starts
    import datetime as dt
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(f"T{k}", day(k), p, 5.0, 2.0) for k in range(40) for p in "AB" if p == "B" or k < 30]
    tx = spark.createDataFrame(rows, "TransactionID string, Date date, ProductID string, Quantity double, Price double")
    forecast = spark.createDataFrame([(day(40 + k), p, 5.0) for k in range(30) for p in "AB"],
                                     "Date date, ProductID string, Predicted_Quantity double")
    every = {r.ProductID: (r.lead_time_demand, r.reorder_point) for r in flows.inventory_advice(tx, forecast)[0].collect()}
    one = flows.inventory_advice(tx, forecast, products=["A"])[0].first()
    assert every["A"][0] == 40.0 and (one.lead_time_demand, one.reorder_point) == every["A"]


def test_empty_rules_leave_the_feature_out(spark):
    from basketcast.operators.features import ASSOCIATION_FEATURE, forecast_features
    from basketcast.plans import fixtures as fx
    from conftest import SF_SMALL
    _, rules = flows.associations(fx.transactions(spark, SF_SMALL), 0.9, 0.9)
    assert rules.isEmpty()
    assert ASSOCIATION_FEATURE not in forecast_features(fx.transactions(spark, SF_SMALL), rules).columns


def test_an_upload_is_cleaned_once(spark, tmp_path):
    from basketcast.plans.flows import upload
    (tmp_path / "sales.csv").write_text("Order Date,Invoice-No,SKU,Qty\n" + "".join(
        f"0{d}/13/2025,T{d},P{d % 3},{d}\n" for d in range(1, 10)) + "\"Jan 5, 2025\",T10,P1,n/a\n\"Jan 5, 2025\",T11,P1,2\n")
    done = upload(spark, str(tmp_path / "sales.csv"))
    (tmp_path / "sales.csv").unlink()  # later results read the stored rows
    assert done.valid and done.transactions.count() == 10 and done.products.count() == 3
