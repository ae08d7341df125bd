"""Views over the rule table: per-product associations, bundles, top-k tables, labels, lift matrix.

Per-product views explode the rule sides into (product, rule) rows and use equi
joins and windows; no array-containment theta join is used. Top-k per product is
``row_number() <= k``, which Spark turns into a partial group limit before the
shuffle, so a product in very many rules does not move them all to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketcast.functions.metrics import rule_order
from basketcast.operators.clean import filter_products
from basketcast.operators.inventory import rule_bundles
from basketcast.session import materialize

RULE_KEY = ["antecedents_str", "consequents_str"]


def rules_with_product(rules: DataFrame, side: str = "antecedents") -> DataFrame:
    """(ProductID, rule...) for every product on the given side of every rule."""
    return rules.select(F.explode(side).alias("ProductID"), *rules.columns)


def top_associations(rules: DataFrame, n: int = 5, product: str | None = None) -> DataFrame:
    """Top ``n`` rules by lift in which the product is an antecedent, for every product
    (or one product)."""
    per = rules_with_product(rules, "antecedents")
    if product is not None:
        per = per.filter(F.col("ProductID") == product)
    rank = F.row_number().over(Window.partitionBy("ProductID").orderBy(*rule_order("lift")))
    return per.withColumn("rank", rank).filter(F.col("rank") <= n)


def product_bundles(rules: DataFrame, min_confidence: float = 0.7, min_lift: float = 2.0) -> DataFrame:
    """Bundles of strong rules: ``confidence >= 0.7`` and ``lift >= 2.0`` by default."""
    return rule_bundles(rules, min_confidence, min_lift)


def all_rule_bundles(rules: DataFrame) -> DataFrame:
    """Every rule as a bundle of at least two items, no thresholds."""
    return rule_bundles(rules)


def cross_sell(rules: DataFrame, product: str | None = None) -> DataFrame:
    """Rules in which the product appears on either side, per product."""
    both = rules_with_product(rules, "antecedents").unionByName(rules_with_product(rules, "consequents"))
    if product is not None:
        both = both.filter(F.col("ProductID") == product)
    return both.dropDuplicates(["ProductID", *RULE_KEY])


def _partners(rules: DataFrame) -> DataFrame:
    """(ProductID, partner, rule...) where partner sits on the opposite side of the rule."""
    base = rules.select("antecedents", "consequents", "lift", "confidence", "support", *RULE_KEY)
    fwd = base.select(F.explode("antecedents").alias("ProductID"), "consequents", "lift", "confidence",
                      "support", *RULE_KEY) \
              .select("ProductID", F.explode("consequents").alias("partner"), "lift", "confidence", "support",
                      *RULE_KEY)
    back = base.select(F.explode("consequents").alias("ProductID"), "antecedents", "lift", "confidence",
                       "support", *RULE_KEY) \
               .select("ProductID", F.explode("antecedents").alias("partner"), "lift", "confidence", "support",
                       *RULE_KEY)
    return fwd.unionByName(back)


def associated_products(rules: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` associated products per product, strongest (max lift) first, ties by id."""
    best = _partners(rules).groupBy("ProductID", "partner").agg(F.max("lift").alias("max_lift"))
    rank = F.row_number().over(Window.partitionBy("ProductID").orderBy(F.col("max_lift").desc(),
                                                                       F.col("partner").asc()))
    return best.withColumn("rank", rank).filter(F.col("rank") <= n) \
               .select("ProductID", F.col("partner").alias("AssociatedProductID"), "rank", "max_lift")


def associated_forecast(rules: DataFrame, forecast: DataFrame, products=None, n: int = 3) -> DataFrame:
    """For the first ``n`` associated products of each product that are forecast: mean
    forecast and lift/confidence of the strongest rule linking the two."""
    key = ["ProductID", "AssociatedProductID"]
    # One aggregate per (product, partner) finds the strongest linking rule in the rule
    # order (lift, confidence, support descending, then the sides ascending) as the
    # minimum of a struct with the numeric keys negated; its lift is the pair's max lift.
    strongest = F.min(F.struct((-F.col("lift")).alias("_l"), (-F.col("confidence")).alias("_c"),
                               (-F.col("support")).alias("_s"), "antecedents_str", "consequents_str",
                               "lift", "confidence")).alias("_first")
    best = _partners(rules).withColumnRenamed("partner", "AssociatedProductID").groupBy(*key).agg(strongest)
    rank = F.row_number().over(Window.partitionBy("ProductID").orderBy(F.col("_first.lift").desc(),
                                                                       F.col("AssociatedProductID").asc()))
    assoc = best.withColumn("rank", rank).filter(F.col("rank") <= n)
    fc = filter_products(forecast, products).groupBy(F.col("ProductID").alias("AssociatedProductID")) \
        .agg(F.avg("Predicted_Quantity").alias("avg_predicted_demand"))
    return assoc.join(fc, "AssociatedProductID").select(
        "ProductID", "AssociatedProductID", "rank", "avg_predicted_demand",
        F.col("_first.lift").alias("lift"), F.col("_first.confidence").alias("confidence"))


def associated_sales_comparison(daily: DataFrame, rules: DataFrame, n: int = 2) -> DataFrame:
    """Daily series of each product together with its first ``n`` associated products."""
    assoc = associated_products(rules, 5).filter(F.col("rank") <= n) \
        .select(F.col("ProductID").alias("SelectedProduct"), F.col("AssociatedProductID").alias("ProductID"))
    selves = assoc.select("SelectedProduct").distinct().withColumn("ProductID", F.col("SelectedProduct"))
    members = selves.unionByName(assoc)
    return members.join(daily, "ProductID").select("SelectedProduct", "ProductID", "Date", "Quantity")


def top_rules(rules: DataFrame, by: str = "lift", n: int = 20, min_lift: float | None = None) -> DataFrame:
    sel = rules if min_lift is None else rules.filter(F.col("lift") >= F.lit(float(min_lift)))
    return sel.orderBy(*rule_order(by)).limit(n)


def rule_item_frequency(rules: DataFrame, min_lift: float | None = None, top_rules_n: int = 20,
                        n: int = 15) -> DataFrame:
    """How often each product appears on either side of the top rules by lift; top ``n``."""
    top = top_rules(rules, "lift", top_rules_n, min_lift)
    items = top.select(F.explode(F.concat("antecedents", "consequents")).alias("ProductID"))
    counts = items.groupBy("ProductID").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.orderBy(F.col("frequency").desc(), F.col("ProductID").asc()).limit(n)


def top_rules_table(rules: DataFrame, n: int = 10, decimals: int = 3) -> DataFrame:
    """Top rules by lift with support, confidence and lift as fixed-decimal text."""
    fmt = f"%.{decimals}f"
    return top_rules(rules, "lift", n).select(
        F.col("antecedents_str").alias("Antecedents"), F.col("consequents_str").alias("Consequents"),
        F.format_string(fmt, "support").alias("Support"),
        F.format_string(fmt, "confidence").alias("Confidence"),
        F.format_string(fmt, "lift").alias("Lift"))


def rule_label(antecedents: str = "antecedents", consequents: str = "consequents"):
    """``first antecedent[+k] → first consequent`` (k = further antecedents)."""
    more = F.when(F.size(antecedents) > 1, F.concat(F.lit("+"), (F.size(antecedents) - 1).cast("string")))
    return F.concat(F.element_at(antecedents, 1), F.coalesce(more, F.lit("")), F.lit(" → "),
                    F.element_at(consequents, 1))


def rule_labels(rules: DataFrame) -> DataFrame:
    return rules.select(*RULE_KEY, rule_label().alias("label"), "lift", "confidence")


def association_report(rules: DataFrame, min_support: float, n: int = 10) -> DataFrame:
    """Rules with lift >= 10 x min_support, top 20 by lift, first ``n`` with 4 decimals."""
    top = top_rules(rules, "lift", 20, 10 * min_support)
    return top_rules_table(top, n, decimals=4)


def rules_min_lift(rules: DataFrame, min_lift: float = 1.2) -> DataFrame:
    return rules.filter(F.col("lift") >= F.lit(float(min_lift)))


def lift_matrix(rules: DataFrame, top: DataFrame) -> DataFrame:
    """Long-form symmetric lift matrix over the given products (bounded top-N list).

    Cell (a, b) = largest lift of any rule with one of them among the antecedents
    and the other among the consequents; 0 when no rule links them; null on the
    diagonal.
    """
    # the top list is read four times: checkpointed and counted once, then broadcast
    _, _, names = materialize(top.select("ProductID"))
    pairs = _partners(rules).join(names, "ProductID", "left_semi") \
        .join(names.withColumnRenamed("ProductID", "partner"), "partner", "left_semi")
    cell = pairs.groupBy(F.least("ProductID", "partner").alias("_lo"), F.greatest("ProductID", "partner").alias("_hi")) \
        .agg(F.max("lift").alias("_lift"))
    listed = names.agg(F.collect_list("ProductID").alias("_p"))
    grid = listed.select(F.explode("_p").alias("product_a"), "_p").select("product_a", F.explode("_p").alias("product_b"))
    grid = grid.withColumns({"_lo": F.least("product_a", "product_b"), "_hi": F.greatest("product_a", "product_b")})
    out = grid.join(cell, ["_lo", "_hi"], "left")
    value = F.when(F.col("product_a") == F.col("product_b"), F.lit(None).cast("double")) \
             .otherwise(F.coalesce(F.col("_lift"), F.lit(0.0)))
    return out.select("product_a", "product_b", value.alias("lift"))
