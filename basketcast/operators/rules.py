"""Association rules from frequent itemsets: every split, all metrics, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketcast.functions.metrics import rule_order, with_rule_metrics
from basketcast.operators.baskets import basket_lines
from basketcast.operators.itemsets import frequent_itemsets
from basketcast.session import broadcast_if_small

RULE_COLUMNS = ["antecedents", "consequents", "antecedent_support", "consequent_support", "support",
                "confidence", "lift", "leverage", "conviction", "zhangs_metric", "jaccard", "certainty",
                "kulczynski", "antecedents_str", "consequents_str"]


def rule_splits(itemsets: DataFrame) -> DataFrame:
    """Every (antecedent, consequent) split of every itemset with at least two items.

    Split ``m`` of an n-item set puts item i in the antecedent when bit i of ``m`` is
    set, for m in 1 .. 2^n - 2, so consequents with several items are included.
    """
    multi = itemsets.filter(F.col("size") >= 2)
    masks = multi.select("items", "support",
                         F.explode(F.expr("sequence(1, shiftleft(1, size) - 2)")).alias("mask"))
    return masks.select(
        F.expr("filter(items, (x, i) -> shiftright(mask, i) & 1 = 1)").alias("antecedents"),
        F.expr("filter(items, (x, i) -> shiftright(mask, i) & 1 = 0)").alias("consequents"),
        "support",
    )


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5,
                      min_lift: float | None = None) -> DataFrame:
    """Rules with ``confidence >= min_confidence`` (and ``lift >= min_lift`` when given).

    The two side supports come from equi-joins back to the itemsets: every subset of
    a frequent set is frequent, so both joins always match.
    """
    # The itemset table is small next to the baskets; broadcast it once its size is counted.
    sup = broadcast_if_small(itemsets.select("items", "support"))
    rules = (rule_splits(itemsets)
             .join(sup.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support")),
                   "antecedents")
             .join(sup.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support")),
                   "consequents"))
    rules = with_rule_metrics(rules).filter(F.col("confidence") >= F.lit(float(min_confidence)))
    if min_lift is not None:
        rules = rules.filter(F.col("lift") >= F.lit(float(min_lift)))
    rules = rules.withColumns({"antecedents_str": F.array_join("antecedents", ", "),
                               "consequents_str": F.array_join("consequents", ", ")})
    return rules.select(*RULE_COLUMNS)


def sort_rules(rules: DataFrame, by: str = "lift") -> DataFrame:
    return rules.orderBy(*rule_order(by))


def mine_rules(tx: DataFrame, min_support: float = 0.01, min_confidence: float = 0.5,
               min_lift: float = 1.0, max_len: int = 4, sort: bool = False) -> tuple[DataFrame, DataFrame]:
    """Basket lines -> itemsets (at most ``max_len`` items) -> rules filtered by confidence and lift.

    ``sort=True`` orders the rules by lift (ties broken deterministically) as the
    reference displays them; left unsorted, downstream top-k views order only what
    they keep instead of sorting the whole rule table. When nothing survives the
    frames are empty (the reference substitutes demo data; that data is available
    from ``demo_association_data``).
    """
    lines = basket_lines(tx) if "Quantity" in tx.columns else tx
    itemsets = frequent_itemsets(lines, min_support=min_support, max_len=max_len, assume_distinct=True)
    rules = association_rules(itemsets, min_confidence=min_confidence, min_lift=min_lift)
    return itemsets, sort_rules(rules) if sort else rules


# The reference's fourteen demonstration baskets over six products.
DEMO_BASKETS = [
    ["Product A", "Product B"],
    ["Product A", "Product C"],
    ["Product A", "Product B", "Product C"],
    ["Product B", "Product C"],
    ["Product B", "Product D"],
    ["Product C", "Product D"],
    ["Product A", "Product D"],
    ["Product A", "Product B", "Product D"],
    ["Product A", "Product C", "Product D"],
    ["Product B", "Product C", "Product D"],
    ["Product E", "Product F"],
    ["Product D", "Product E"],
    ["Product C", "Product F"],
    ["Product A", "Product F"],
]


def demo_association_data(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Itemsets and rules of the demonstration baskets (support 0.2, confidence 0.5, no lift filter)."""
    rows = [(f"D{i:02d}", item) for i, basket in enumerate(DEMO_BASKETS) for item in basket]
    lines = spark.createDataFrame(rows, "TransactionID string, ProductID string")
    itemsets = frequent_itemsets(lines, min_support=0.2, max_len=len({r[1] for r in rows}))
    rules = association_rules(itemsets, min_confidence=0.5)
    return itemsets, sort_rules(rules)
