"""Awkward rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

LONG = ("Lorem ipsum dolor sit amet, consetetur sadipscing elitr. " * 4000) + "end"

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta. iota kappa!", "x", 1),
    (2, None, None, None),
    (3, "", "x", 3),
    (4, "   \t\n  ", "x", 4),
    (5, LONG, "y", 5),
    (6, "alpha beta  gamma delta epsilon zeta eta theta. iota kappa!", "x", 6),
    (6, "alpha beta  gamma delta epsilon zeta eta theta. iota kappa!", "x", 6),
    (7, "Größe naïve 東京 😀 é x y 'll 123 <|endoftext|> don't", "z", 7),
    (8, "a" * 3000, "z", 8),
    (None, "no id here", "z", 9),
    (9, LONG, "y", 5),
]
# clashing names: columns the operators use inside themselves
SCHEMA = "doc_id long, text string, n_bytes string, shard int"


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
