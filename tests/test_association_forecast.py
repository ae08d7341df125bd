"""Propagation along rules against a linear solve, and history by month against plain filters."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketcast.operators import association_forecast as af
from basketcast.sources import history

RULES = "antecedents array<string>, consequents array<string>, confidence double"


def test_weights_take_the_best_rule_and_never_exceed_one(spark):
    rules = spark.createDataFrame([(["a"], ["b"], 0.8), (["a"], ["b", "c"], 0.3), (["c"], ["b"], 0.7), (["a", "c"], ["d"], 0.9)], RULES)
    got = {(r.source, r.target): r.weight for r in af.rule_weights(rules).collect()}
    assert got == {("a", "b"): pytest.approx(0.8 / 1.5), ("c", "b"): pytest.approx(0.7 / 1.5), ("a", "c"): 0.3}


def test_propagation_is_the_fixed_point_on_cycles(spark):
    rng = np.random.default_rng(5)
    n = 12
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    np.fill_diagonal(w, 0)
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1.0)  # row = target
    d = rng.normal(0, 0.3, n)
    dev = spark.createDataFrame([(f"p{i}", float(v)) for i, v in enumerate(d)], "ProductID string, deviation double")
    edges = [(f"p{s}", f"p{t}", float(w[t, s])) for t in range(n) for s in range(n) if w[t, s]]
    edges.append(("p0", "unknown", 0.5))
    weights = spark.createDataFrame(edges, "source string, target string, weight double")
    want = np.linalg.solve(np.eye(n) - 0.6 * w, d)
    got = {r.ProductID: r.total for r in af.propagate(dev, weights, damping=0.6).collect()}
    assert len(got) == n and all(abs(got[f"p{i}"] - want[i]) < 1e-7 for i in range(n))
    with pytest.raises(ValueError):
        af.propagate(dev, weights, damping=1.0)


def test_a_rise_moves_the_partner(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, i), p, 10.0) for i in range(1, 11) for p in "abz"],
                                  "Date date, ProductID string, Quantity double")
    fc = spark.createDataFrame([(dt.date(2024, 1, 11), "a", 12.0), (dt.date(2024, 1, 11), "b", 10.0),
                                (dt.date(2024, 1, 11), "z", 10.0), (dt.date(2024, 1, 11), "new", 3.0)],
                               "Date date, ProductID string, Predicted_Quantity double")
    rules = spark.createDataFrame([(["a"], ["b"], 0.8)], RULES)
    got = {r.ProductID: r.Adjusted_Quantity for r in af.adjusted_forecast(daily, fc, rules).collect()}
    assert got == {"a": 12.0, "b": pytest.approx(10 * (1 + 0.5 * 0.8 * 0.2)), "z": 10.0, "new": 3.0}
    same = af.adjusted_forecast(daily, fc, rules.limit(0)).where("Adjusted_Quantity <> Predicted_Quantity")
    assert same.count() == 0
    assert af.adjusted_forecast(daily.limit(0), fc, rules).count() == 4
    assert af.adjusted_forecast(daily, fc.limit(0), rules).count() == 0


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    rows = [(str(i), dt.date(2024, 1, 1) + dt.timedelta(days=i % 200), f"p{i % 7}", float(i % 5)) for i in range(2000)]
    rows += [(f"n{i}", None, "p1", 1.0) for i in range(5)] + [("x", dt.date(2024, 3, 3), None, 2.0)]
    tx = spark.createDataFrame(rows, "TransactionID string, Date date, ProductID string, Quantity double")
    return tx, history.write_history(tx, str(tmp_path_factory.mktemp("history") / "sales"), files_per_month=2)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_keeps_every_row(spark, sales):
    tx, path = sales
    back = history.read_history(spark, path)
    assert back.count() == 2006 and back.select(*tx.columns).exceptAll(tx).count() == 0


def test_range_reads_only_its_months(spark, sales):
    tx, path = sales
    start, end = dt.date(2024, 2, 10), dt.date(2024, 4, 5)
    got = history.read_history(spark, path, start, end)
    want = tx.where((F.col("Date") >= F.lit(start)) & (F.col("Date") <= F.lit(end)))
    assert got.select(*tx.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    assert {f.split("SaleMonth=")[1][:7] for f in (r.f for r in got.select(F.input_file_name().alias("f")).distinct().collect())} \
        == {"2024-02", "2024-03", "2024-04"}
    plan = _plan(got)
    assert "PartitionFilters: [isnotnull(SaleMonth" in plan and ">= 2024-02" in plan
    assert history.read_history(spark, path, start, start).count() == tx.where(F.col("Date") == F.lit(start)).count()
    with pytest.raises(ValueError):
        history.read_history(spark, path, end, start)


def test_periods_prune_when_the_query_runs(spark, sales):
    tx, path = sales
    periods = spark.createDataFrame([("spring", "2024-03"), ("spring", "2024-04"), ("spring", "2024-04"), ("may", "2024-05")],
                                    "period string, SaleMonth string")
    got = history.in_periods(history.read_history(spark, path), periods, ["spring"])
    assert "dynamicpruning" in _plan(got)
    assert got.count() == tx.where("month(Date) IN (3, 4)").count()
    assert got.select("period").distinct().collect()[0].period == "spring"
    assert history.in_periods(history.read_history(spark, path), periods, []).count() == 0


def test_categories(spark, sales):
    tx, _ = sales
    dim = spark.createDataFrame([(f"p{i}", "even" if i % 2 == 0 else "odd") for i in range(6)] + [("p0", "even")],
                                "ProductID string, Category string")
    every = history.with_category(tx, dim)
    assert every.count() == tx.count()
    assert every.where("Category IS NULL").count() == tx.where("ProductID = 'p6' OR ProductID IS NULL").count()
    assert history.with_category(tx, dim, ["odd"]).count() == tx.where("ProductID IN ('p1', 'p3', 'p5')").count()
