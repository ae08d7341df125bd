import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from basketcast.plans.queries import QUERIES
from conftest import SF_SMALL

CHECKED = ["daily_sales", "frequent_itemsets", "association_rules_brand", "association_feature",
           "inventory_recommendations", "inventory_selected", "clean_messy", "csv_upload", "bundle_inventory_multi",
           "association_feature_multi", "rule_labels", "bundle_inventory", "lift_matrix", "train_split", "synth_txn_id"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "bundle_id" in df.columns


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) - set(E.oracle_sql()) == E.NO_SQL


def test_entry_stands_without_the_text_subpackage(tmp_path):
    # as after deleting the subpackage and the pipeline: the rest imports and keeps its queries
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "basketcast"), tmp_path / "basketcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"],
                         cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[-2:] == [str(len(QUERIES)), str(len(QUERIES) - len(E.NO_SQL))], out.stderr


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    df = E.queries()[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(dcols)
    want = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows)
    got = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    assert got == want
