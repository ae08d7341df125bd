"""Boosted trees: a hand-worked tree, plain greedy trees, tasks and checkpoints, written models, held-out error."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from basketcast.operators import boosting
from basketcast.operators.features import forecast_features
from basketcast.operators.forecast import forecast_accuracy, train_split, training_frame
from basketcast.plans import fixtures as fx
from conftest import SF_SMALL

ALL = {"row_share": 1.0, "column_share": 1.0}


def fit(df, names, **options):
    return boosting.fit_boosted_trees(df, names, "y", F.xxhash64("id"), **options)


def test_hand_worked_tree(spark):
    # mean 5; residuals -4 -4 -2 | 1 4 5; below 4: sum -10 of 3, else 10 of 3; l2 = 1
    rows = list(zip(range(6), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, 1.0, 3.0, 6.0, 9.0, 10.0], strict=True))
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = fit(df, ["x"], trees=1, max_depth=1, rate=0.5, **ALL)
    tree = model.trees[0]
    assert model.base == 5.0 and tree.cut[0] == 4.0 and tree.gain[0] == pytest.approx(100 / 4 + 100 / 4)
    assert [tree.value[tree.yes[0]], tree.value[tree.no[0]]] == [-2.5, 2.5]
    got = {r.x: r.prediction for r in model.transform(df).collect()}
    assert got[3.0] == 3.75 and got[4.0] == 6.25


def plain_trees(x, y, trees, depth, rate, l2=1.0):
    """Greedy trees over all distinct cuts, one split at a time; predictions after each tree."""
    rest, steps = y - y.mean(), []
    for _ in range(trees):
        out = np.zeros(len(y))

        def grow(rows, left, out=out, rest=rest):
            s, n = rest[rows].sum(), len(rows)
            best = (1e-6, None)
            for c in range(x.shape[1]) if left else ():
                for cut in sorted(set(x[:, c]))[1:]:
                    a, b = rows[x[rows, c] < cut], rows[x[rows, c] >= cut]
                    if len(a) and len(b):
                        gain = rest[a].sum() ** 2 / (len(a) + l2) + rest[b].sum() ** 2 / (len(b) + l2) - s**2 / (n + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
            if best[1] is None:
                out[rows] = s / (n + l2)
            else:
                for part in best[1]:
                    grow(part, left - 1)

        grow(np.arange(len(y)), depth)
        rest = rest - rate * out
        steps.append(y - rest)
    return steps


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [(i, float(rng.randrange(9)), float(rng.randrange(40)), rng.random()) for i in range(300)]
    rows = [(i, a, b, c, a * 3 + (b > 20) * 7 + rng.gauss(0, 1) + 2 * c) for i, a, b, c in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(6).cache()


def test_first_trees_equal_plain_ones(table):
    local = table.orderBy("id").toPandas()
    local["c"] = (local.c * 50).round()
    df = table.withColumn("c", F.rint(F.col("c") * 50))
    for k, want in enumerate(plain_trees(local[["a", "b", "c"]].to_numpy(), local.y.to_numpy(), 3, 3, 0.3), 1):
        model = fit(df, ["a", "b", "c"], trees=k, max_depth=3, rate=0.3, **ALL)
        got = model.transform(df).orderBy("id").toPandas().prediction
        assert np.allclose(got, want, atol=1e-9)


def test_tasks_and_checkpoints_do_not_matter(table, monkeypatch):
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 3)
    one = fit(table, ["a", "b", "c"], trees=7, max_depth=3)
    many = fit(table, ["a", "b", "c"], trees=7, max_depth=3, rows_per_task=40)
    assert [t.column for t in one.trees] == [t.column for t in many.trees]
    assert [t.bin for t in one.trees] == [t.bin for t in many.trees]
    for a, b in zip(one.trees, many.trees, strict=True):
        assert np.allclose(a.value, b.value, atol=1e-9)


def test_rows_and_columns_are_drawn_once_per_tree(table):
    names = ["a", "b", "c", "y2", "y3"]
    model = fit(table.withColumns({"y2": F.col("y") * 2, "y3": -F.col("y")}), names, trees=12, max_depth=4, column_share=0.4)
    assert all(len({c for c in t.column if c >= 0}) <= 2 for t in model.trees)
    assert len({tuple(sorted({c for c in t.column if c >= 0})) for t in model.trees}) > 3
    keys = np.arange(50_000, dtype=np.int64) * 7919
    seen = [boosting.sampled(keys, t, 42, 0.8) for t in range(3)]
    assert all(abs(s.mean() - 0.8) < 0.01 for s in seen) and abs((seen[0] & seen[1]).mean() - 0.64) < 0.01
    assert (boosting.sampled(keys[::-1], 1, 42, 0.8)[::-1] == seen[1]).all()


def test_written_model_and_column_expression(spark, table):
    model = fit(table, ["a", "b", "c"], trees=5, max_depth=3)
    back = boosting.from_node_table(boosting.node_table(model, spark).repartition(3), ["a", "b", "c"])
    holes = table.unionByName(spark.createDataFrame([(-1, None, 3.0, None, 0.0)], table.schema))
    rows = holes.select("id", model.score().alias("s"), back.score().alias("t")).collect()
    want = {r.id: r.prediction for r in model.transform(holes).collect()}
    assert all(abs(r.s - want[r.id]) < 1e-9 and abs(r.t - want[r.id]) < 1e-9 for r in rows)  # missing values go right
    assert sum(model.importances().values()) == pytest.approx(1.0) and back.importances() == pytest.approx(model.importances())
    passes = {r.feature: r.rows for r in boosting.split_passes(model, holes).collect()}
    assert sum(passes.values()) >= 301 * 5 and set(passes) <= {"a", "b", "c"}


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 1.0, None, float(i % 2)) for i in range(10)], "id long, a double, b double, y double")
    model = fit(df, ["a", "b"], trees=2)
    assert all(len(t.column) == 1 for t in model.trees)
    assert [r.prediction for r in model.transform(df).limit(1).collect()] == [pytest.approx(0.5, abs=0.2)]
    with pytest.raises(ValueError):
        fit(df.limit(0), ["a", "b"])


def test_held_out_error_is_not_worse_than_sparks(spark):
    frame, names = training_frame(forecast_features(fx.daily_table(spark, SF_SMALL)))
    split = train_split(frame).cache()
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    ours = boosting.fit_boosted_trees(train, names, "Quantity", F.xxhash64("Date", "ProductID"), trees=20, max_depth=4)
    spark_ml = GBTRegressor(featuresCol="f", labelCol="Quantity", maxIter=20, maxDepth=4, stepSize=0.1, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", seed=42)
    theirs = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="f"), spark_ml]).fit(train)
    rmse = [forecast_accuracy(m.transform(test).selectExpr("Quantity AS actual", "prediction AS predicted")).first().RMSE
            for m in (ours, theirs)]
    assert rmse[0] <= 1.02 * rmse[1]
