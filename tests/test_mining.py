import itertools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from basketcast.operators.baskets import basket_lines
from basketcast.operators.itemsets import frequent_itemsets, intersections, narrowed, vertical_words
from basketcast.operators.rules import DEMO_BASKETS, association_rules, demo_association_data, mine_rules
from basketcast.plans import fixtures as fx
from conftest import SF_SMALL


def _demo_lines(spark):
    rows = [(f"D{i:02d}", item) for i, b in enumerate(DEMO_BASKETS) for item in b]
    return spark.createDataFrame(rows, "TransactionID string, ProductID string")


def test_demo_itemsets_and_rules(spark):
    itemsets, rules = demo_association_data(spark)
    got = {r.itemsets_str: r.freq for r in itemsets.collect()}
    letters = {"Product A": 7, "Product B": 6, "Product C": 7, "Product D": 7, "Product F": 3}
    assert {k: v for k, v in got.items() if "," not in k} == letters
    pairs = {k for k in got if k.count(",") == 1}
    assert len(pairs) == 6 and all(got[p] == 3 for p in pairs)
    assert not any(k.count(",") >= 2 for k in got)
    out = [(r.antecedents_str, r.consequents_str, r.confidence, r.lift) for r in rules.collect()]
    assert sorted(out) == [("Product B", "Product A", 0.5, 1.0), ("Product B", "Product C", 0.5, 1.0),
                           ("Product B", "Product D", 0.5, 1.0)]


def test_demo_rules_at_lower_confidence(spark):
    itemsets = frequent_itemsets(_demo_lines(spark), min_support=0.2, max_len=6)
    rules = association_rules(itemsets, min_confidence=0.4).collect()
    assert len(rules) == 12
    for r in rules:
        expect = 1.0 if "Product B" in (r.antecedents_str, r.consequents_str) else 6 / 7
        assert math.isclose(r.lift, expect, rel_tol=1e-12)


def test_level_wise_equals_fpgrowth(spark):
    tx = fx.transactions(spark, SF_SMALL, fx.TYPE)
    lines = basket_lines(tx)
    ours = {r.itemsets_str: r.freq for r in frequent_itemsets(lines, 0.02, 4, assume_distinct=True).collect()}
    baskets = lines.groupBy("TransactionID").agg(F.array_sort(F.collect_set("ProductID")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=0.02, minConfidence=0.5).fit(baskets)
    theirs = {", ".join(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect() if len(r["items"]) <= 4}
    assert ours == theirs and any(k.count(",") == 3 for k in ours)


def test_words_of_any_width_give_the_same(spark):
    lines = basket_lines(fx.transactions(spark, SF_SMALL, fx.TYPE))
    sizes = [{r.itemsets_str: r.freq for r in frequent_itemsets(lines, 0.02, 4, assume_distinct=True, per_word=b).collect()}
             for b in (1, 8, 64)]
    assert sizes[0] == sizes[1] == sizes[2] and any(k.count(",") == 3 for k in sizes[0])


def test_words_hold_each_basket_once(spark):
    # 500 baskets in 3 ranges: several words a range; repeated lines set the same bit
    lines = spark.range(2000).selectExpr("concat('b', id % 500) AS t", "concat('i', (id % 500) % 7) AS i")
    words = vertical_words(lines, 3)
    per_item = {r.i: r.n for r in words.groupBy("i").agg(F.sum(F.bit_count("word")).alias("n")).collect()}
    assert per_item == {f"i{k}": len(range(k, 500, 7)) for k in range(7)}
    assert words.groupBy("range").agg(F.max("number").alias("n")).agg(F.min("n")).first()[0] >= 1
    for bits in (1, 4, 32):
        thin = narrowed(words, bits)
        assert thin.agg(F.sum(F.bit_count("word"))).first()[0] == 500
        assert thin.where(F.bit_count("word") > bits).count() == 0


def test_one_wide_basket_and_a_hot_one(spark):
    # one basket holds a third of all lines, another 2,000 items
    lines = (spark.range(3000).selectExpr("'hot' AS TransactionID", "concat('P', id % 40) AS ProductID")
             .unionByName(spark.range(2000).selectExpr("'wide' AS TransactionID", "concat('P', id) AS ProductID"))
             .unionByName(spark.range(4000).selectExpr("concat('t', id % 800) AS TransactionID", "concat('P', id % 13) AS ProductID")))
    by_basket = {}
    for t, i in lines.collect():
        by_basket.setdefault(t, set()).add(i)
    got = {tuple(r["items"]): r.freq for r in frequent_itemsets(lines, 0.05, 3).collect()}
    for items, freq in got.items():
        assert freq == sum(set(items) <= b for b in by_basket.values())
    frequent = sorted(r for r in {i for b in by_basket.values() for i in b} if sum(r in b for b in by_basket.values()) >= 0.05 * len(by_basket))
    want = sum(sum(set(c) <= b for b in by_basket.values()) >= 0.05 * len(by_basket)
               for k in (1, 2, 3) for c in itertools.combinations(frequent, k))
    assert len(got) == want


def test_levels_stay_in_their_partitions(spark):
    words = vertical_words(spark.range(500).selectExpr("id % 90 AS t", "concat('P', id % 7) AS i"), 3)
    level = words.selectExpr("range", "number", "cast(array() AS array<string>) AS items", "i AS last", "word")
    plan = intersections(intersections(level))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one that deals lines into ranges


def test_no_level_makes_pairs_of_the_item_table(spark):
    # 3,000 frequent items, none of them together in a basket: no pair may come up at all
    lines = spark.range(6000).selectExpr("cast(id AS string) AS TransactionID", "concat('P', id % 3000) AS ProductID")
    words = vertical_words(lines.selectExpr("TransactionID AS t", "ProductID AS i"), 100)
    level = words.selectExpr("range", "number", "cast(array() AS array<string>) AS items", "i AS last", "word")
    assert intersections(level).count() == 0
    assert frequent_itemsets(lines, 1 / 4000, 4).count() == 3000


def test_rule_identities(spark):
    _, rules = mine_rules(fx.transactions(spark, SF_SMALL, fx.TYPE), 0.02, 0.05, 0.0)
    rows = rules.collect()
    assert rows
    by_sides = {(r.antecedents_str, r.consequents_str): r for r in rows}
    for r in rows:
        assert math.isclose(r.confidence * r.antecedent_support, r.support, rel_tol=1e-9)
        assert r.support <= min(r.antecedent_support, r.consequent_support) + 1e-12
        twin = by_sides.get((r.consequents_str, r.antecedents_str))
        if twin is not None:
            assert math.isclose(twin.lift, r.lift, rel_tol=1e-9)
    assert any(len(r.consequents) > 1 for r in rows)  # multi-item consequents are generated


def test_empty_when_nothing_frequent(spark):
    itemsets, rules = mine_rules(fx.transactions(spark, SF_SMALL, fx.BRAND), 0.9, 0.5, 1.0)
    assert itemsets.count() == 0 and rules.count() == 0
