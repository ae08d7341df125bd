"""Column expressions for association-rule metrics (all JVM-side, guarded for zero divisors).

``s`` = support of antecedent and consequent together, ``a`` = antecedent support,
``c`` = consequent support.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def confidence(s: Column, a: Column) -> Column:
    return s / a


def lift(s: Column, a: Column, c: Column) -> Column:
    return (s / a) / c


def leverage(s: Column, a: Column, c: Column) -> Column:
    return s - a * c


def conviction(s: Column, a: Column, c: Column) -> Column:
    conf = s / a
    return F.when(conf >= F.lit(1.0), F.lit(INF)).otherwise((F.lit(1.0) - c) / (F.lit(1.0) - conf))


def zhangs_metric(s: Column, a: Column, c: Column) -> Column:
    denominator = F.greatest(s * (F.lit(1.0) - a), a * (c - s))
    return F.when(denominator == 0, F.lit(0.0)).otherwise(leverage(s, a, c) / denominator)


def jaccard(s: Column, a: Column, c: Column) -> Column:
    return s / (a + c - s)


def certainty(s: Column, a: Column, c: Column) -> Column:
    denominator = F.lit(1.0) - c
    return F.when(denominator == 0, F.lit(0.0)).otherwise(((s / a) - c) / denominator)


def kulczynski(s: Column, a: Column, c: Column) -> Column:
    return ((s / a) + (s / c)) / F.lit(2.0)


def with_rule_metrics(df, s: str = "support", a: str = "antecedent_support",
                      c: str = "consequent_support"):
    """Add every rule metric column to a frame that carries the three supports."""
    S, A, C = F.col(s), F.col(a), F.col(c)
    return df.withColumns({
        "confidence": confidence(S, A),
        "lift": lift(S, A, C),
        "leverage": leverage(S, A, C),
        "conviction": conviction(S, A, C),
        "zhangs_metric": zhangs_metric(S, A, C),
        "jaccard": jaccard(S, A, C),
        "certainty": certainty(S, A, C),
        "kulczynski": kulczynski(S, A, C),
    })


# Deterministic order for rules with tied lift (the reference leaves ties unordered).
def rule_order(primary: str = "lift") -> list[Column]:
    keys = [F.col(primary).desc()]
    for name in ("lift", "confidence", "support"):
        if name != primary:
            keys.append(F.col(name).desc())
    keys += [F.col("antecedents_str").asc(), F.col("consequents_str").asc()]
    return keys
