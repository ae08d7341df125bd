import random

import numpy as np

from basketcast.llm import ordinal
from helpers import ROWS, awkward, empty


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    bad = ["zorgle", "frump", "nackter"]
    rows = []
    for i in range(n):
        words = [vocab[int(rng.paretovariate(0.7)) % 3000] for _ in range(rng.randrange(5, 200))]
        flaws = 0
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper())
            flaws += 1
        if rng.random() < 0.3:
            words = [w + "%%%" for w in words]
            flaws += 1
        rows.append((i, " ".join(words), 2 - flaws))
    return rows


def test_gradient_and_order_of_thresholds():
    rows = corpus(600, 1)
    sets, grades = [ordinal.features(t) for _, t, _ in rows], np.array([g for *_, g in rows])
    model = ordinal.fit(sets, grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    p = model.grade_probabilities(model.scores(sets))
    assert np.allclose(p.sum(axis=1), 1)

    def loss(weights):
        other = ordinal.OrdinalModel(model.kept, weights, model.thresholds)
        q = other.grade_probabilities(other.scores(sets))
        return -np.log(np.maximum(q[np.arange(len(grades)), grades], 1e-12)).mean() + 5e-5 * (weights**2).sum()

    base = loss(model.weights)
    for k in range(0, len(model.weights), max(1, len(model.weights) // 5)):
        for d in (-1.0, 1.0):
            moved = model.weights.copy()
            moved[k] += d
            assert loss(moved) > base - 1e-3  # near the least loss


def test_held_out_selection(spark):
    rows = corpus(1500, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000] + [(None, 1), (5, None), (10**9, 0)],
                                    "doc_id long, grade int")
    model = ordinal.train(docs, ratings, 3)
    got = {r.doc_id: r for r in ordinal.grade(docs, model, wanted=2).collect()}
    held = [r for r in rows if r[0] >= 1000]
    right = sum(got[i].keep == (g == 2) for i, _, g in held) / len(held)
    assert right > 0.95
    assert np.mean([abs(got[i].expected_grade - g) for i, _, g in held]) < 0.2
    kept = ordinal.select_rows(docs, model, 2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_the_bound_on_rated_rows_holds(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('w', id) AS text")
    ratings = spark.range(50).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS grade")
    assert ordinal.rated_features(docs, ratings, max_rows=20).count() == 20


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = ordinal.train(awkward(spark), none, 3)
    rows = ordinal.grade(awkward(spark), model, 2).collect()
    assert len(rows) == len(ROWS) and all(r.keep for r in rows)
    assert ordinal.grade(empty(spark), model, 2).count() == 0
    one = spark.createDataFrame([(1, 2)], "doc_id long, grade int")
    assert ordinal.grade(awkward(spark), ordinal.train(awkward(spark), one, 3), 2).count() == len(ROWS)
