"""Property checks of mining against brute force on random baskets (small, in memory)."""

from collections import Counter
from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketcast.operators.itemsets import frequent_itemsets
from basketcast.operators.rules import association_rules

ITEMS = list("ABCDEFG")
baskets = st.lists(st.sets(st.sampled_from(ITEMS), min_size=1, max_size=6), min_size=3, max_size=25)


def brute_force(bs, min_support, max_len):
    n = len(bs)
    counts = Counter()
    for b in bs:
        for k in range(1, max_len + 1):
            counts.update(combinations(sorted(b), k))
    return {", ".join(s): c for s, c in counts.items() if c / n >= min_support}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bs=baskets, min_support=st.sampled_from([0.1, 0.2, 0.3]), per_word=st.sampled_from([1, 4, 64]))
def test_itemsets_and_rules_match_brute_force(spark, bs, min_support, per_word):
    # words of any width
    rows = [(f"T{i}", item) for i, b in enumerate(bs) for item in b]
    lines = spark.createDataFrame(rows, "TransactionID string, ProductID string")
    itemsets = frequent_itemsets(lines, min_support=min_support, max_len=4, per_word=per_word)
    got = {r.itemsets_str: r.freq for r in itemsets.collect()}
    assert got == brute_force(bs, min_support, 4)
    rules = association_rules(itemsets, min_confidence=0.3).collect()
    n = len(bs)
    for r in rules:
        a, c = r.antecedents, r.consequents
        assert not set(a) & set(c)
        both = sum(1 for b in bs if set(a) | set(c) <= b)
        only_a = sum(1 for b in bs if set(a) <= b)
        assert abs(r.support - both / n) < 1e-12 and abs(r.confidence - both / only_a) < 1e-12
        assert r.confidence >= 0.3
    # every split of every multi-item frequent set with enough confidence is present
    expect = 0
    for s, f in got.items():
        items = s.split(", ")
        for k in range(1, len(items)):
            for ant in combinations(items, k):
                if (f / n) / (got[", ".join(ant)] / n) >= 0.3:  # same arithmetic as the engine
                    expect += 1
    assert len(rules) == expect


def test_hot_basket_holds_a_third_of_the_lines(spark):
    # one basket carries a third of all lines; its items make several blocks
    items = [f"P{i:02d}" for i in range(60)]
    hot = [items[i % 60] for i in range(300)]  # 300 lines, 60 distinct items, duplicates included
    small = [[items[(3 * b + j) % 60] for j in range(3)] for b in range(200)]  # 600 lines
    rows = [("HOT", it) for it in hot] + [(f"S{b}", it) for b, basket in enumerate(small) for it in basket]
    lines = spark.createDataFrame(rows, "TransactionID string, ProductID string")
    got = {r.itemsets_str: r.freq for r in frequent_itemsets(lines, min_support=0.01, max_len=3, per_word=8).collect()}
    bs = [set(hot)] + [set(b) for b in small]
    assert got == brute_force(bs, 0.01, 3)


def test_a_basket_of_thousands_of_items(spark):
    # 2,000 distinct items in one basket; only items that others hold too are frequent
    rows = [("WIDE", f"I{i:04d}") for i in range(2000)]
    rows += [(f"S{b}", f"I{(b * 7 + j) % 150:04d}") for b in range(400) for j in range(3)]
    lines = spark.createDataFrame(rows, "TransactionID string, ProductID string")
    baskets_ = {}
    for t, i in rows:
        baskets_.setdefault(t, set()).add(i)
    got = {r.itemsets_str: r.freq for r in frequent_itemsets(lines, min_support=0.006, max_len=3).collect()}
    keep = {i for i in {i for _, i in rows} if sum(i in b for b in baskets_.values()) / 401 >= 0.006}
    assert got == brute_force([b & keep for b in baskets_.values()], 0.006, 3)
