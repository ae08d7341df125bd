import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from basketcast.llm import ordinal
from basketcast.llm.secrets import Scanner, redact
from helpers import awkward, empty
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def brute_pipeline(spark, sf_dir):
    """The stages by plain loops; only the fitted weights come from the operator."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ordinal.train(docs, cp.ratings(spark, sf_dir), 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weight = dict(zip(model.kept.tolist(), model.weights.tolist()))
    kept = []
    for i, t in rows:
        score = sum(weight.get(f, 0.0) for f in set(ordinal.raw_features(t or "").tolist()))
        if 1 - 1 / (1 + np.exp(-(model.thresholds[1] - score))) >= 0.5:
            kept.append((i, t))
    first = {}
    for i, t in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    once = sorted(first.values())
    stays = {i for i, _, c in brute(once) if i == c}
    return {i: redact(t or "", Scanner()) for i, t in once if i in stays}


def test_run_against_brute_force(spark):
    want = brute_pipeline(spark, SF)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = cp.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    total = {}
    for r in got:
        assert r.doc_tokens == ids[r.doc_id]
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == ids


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "exact_dedup", "near_duplicates", "secret_scan", "packing"]


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_rows(spark, make):
    docs = make(spark)
    n = docs.count()
    exact = cp.drop_exact_copies(spark, docs, SF)
    near = cp.drop_near_copies(spark, exact, SF)
    assert cp.redact_secrets(spark, near, SF).count() == near.count()
    assert cp.classify(spark, docs, SF).count() <= n
    if n:
        assert sorted(r.doc_id for r in exact.collect() if r.doc_id is not None) == [1, 2, 4, 5, 7, 8]
        assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == [1, 2, 4, 5, 7, 8]


def test_copies_are_dropped_by_row_not_by_id(spark):
    same, other, third = "one two three four five six seven eight", "a text of its own that is not like the others", "yet another text, alone"
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, same), (5, same), (5, other), (None, third), (None, third), (None, same), (7, third), (7, third), (None, "only here"),
            (8, near), (2, near + " end"), (8, "eight has a second text"), (None, near + " more")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    exact = cp.drop_exact_copies(spark, docs, SF)
    want = {(3, same), (5, other), (7, third), (None, "only here"), (8, near), (2, near + " end"), (8, "eight has a second text"), (None, near + " more")}
    assert exact.columns == docs.columns and exact.count() == len(want)
    assert {(r.doc_id, r.text) for r in exact.collect()} == want
    left = cp.drop_near_copies(spark, exact, SF)
    assert {(r.doc_id, r.text) for r in left.collect()} == want - {(8, near), (None, near + " more")}
    assert left.columns == docs.columns


def test_stages_bound_the_rows_of_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3).selectExpr("id AS doc_id", "'a text' AS text", "'en' AS lang", "'web' AS source", "6L AS n_chars")
    try:
        for held, wanted in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(name, held)
            cp.STAGES[3][1](spark, docs, "").collect()
            assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)
