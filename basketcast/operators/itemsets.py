"""Frequent itemsets, level-wise, on vertical bitmaps: one exact path for baskets of any width.

Support of a set = baskets holding every item of it / all baskets.

* **Vertical words.** Baskets are dealt into ranges of about ``RANGE_BASKETS`` by a hash of their id; inside a
  range a basket is one bit of a 64-bit word. An item's tid-set is its non-zero words,
  ``(range, word number, item, word)``; empty words are not stored. One shuffle by range makes them, and rows of
  one basket and item that repeat set the same bit. Item counts are sums of set bits.
* **Levels.** Within a word, the tid-sets of two frequent sets that differ in their last item are intersected by
  ``&``; a non-zero result is the tid-set of the set they make, its set bits are its count. A
  row stands for up to 64 baskets, and nothing is made that no basket holds. All levels stay
  in the partitions of the ranges; only ``(set, count)`` rows cross a shuffle (partial sums per task).
* **Dense or sparse.** Where few items share many baskets whole words are intersected. Where items are many and
  baskets narrow, a full word holds many items that never meet, so words are first cut into
  narrower ones (``per_word`` bits, by default the cheaper of 64 and 1 by the items' number and the
  mean basket). The code is the same, the words are just thinner.

Frequent items get dense integer codes in sorting order, so everything after level one works on integers and the
names come back on the final table. Each level's sets are checkpointed, which ends the lineage between
levels; a level's words are kept once and read for its counts and for the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from basketcast.session import keep, materialize

ITEMSET_SCHEMA = StructType([
    StructField("items", ArrayType(StringType()), False),
    StructField("size", IntegerType(), False),
    StructField("freq", LongType(), False),
    StructField("support", DoubleType(), False),
    StructField("itemsets_str", StringType(), False),
])

WORD_BITS = 64
# Mean baskets of a range: few ranges pass 64 baskets, which then have a second word.
RANGE_BASKETS = 48
WORD = ["range", "number"]


def _frequent(counts: DataFrame, n: int, min_support: float) -> DataFrame:
    return counts.filter((F.col("freq") / F.lit(float(n))) >= F.lit(float(min_support)))


def coded_items(singles: DataFrame) -> DataFrame:
    """Dense codes 0.. of the frequent items in sorting order (a table of at most mean
    basket width / min_support rows)."""
    return singles.select("i", "freq", (F.row_number().over(Window.orderBy("i")) - 1).alias("code"))


def vertical_words(pairs: DataFrame, ranges: int) -> DataFrame:
    """``range, number, i, word``: each item's baskets as bits, from ``t, i``."""
    placed = pairs.select(F.pmod(F.xxhash64("t"), F.lit(ranges)).alias("range"), "t", "i")
    place = F.dense_rank().over(Window.partitionBy("range").orderBy("t")) - 1
    bit = F.expr(f"shiftleft(1L, place % {WORD_BITS})")
    return (placed.withColumn("place", place)
            .groupBy("range", F.floor(F.col("place") / WORD_BITS).cast("int").alias("number"), "i")
            .agg(F.bit_or(bit).alias("word")))


def narrowed(words: DataFrame, per_word: int) -> DataFrame:
    """The same tid-sets in words of ``per_word`` bits (a power of two), without empty ones."""
    if per_word == WORD_BITS:
        return words
    parts, mask = WORD_BITS // per_word, (1 << per_word) - 1
    split = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    own = F.expr(f"word & shiftleft({mask}L, _part * {per_word})")
    return (split.withColumn("word", own).where("word <> 0")
            .withColumn("number", F.col("number") * parts + F.col("_part")).drop("_part"))


def intersections(level: DataFrame) -> DataFrame:
    """``range, number, items, last, word`` of the sets that two sets of ``level`` make: those of one word
    with the same ``items``, by their ``last`` ones. ``level`` has the same columns."""
    runs = level.groupBy(*WORD, "items").agg(F.array_sort(F.collect_list(F.struct("last", "word"))).alias("run"))
    first = runs.select(*WORD, "items", "run", F.posexplode("run").alias("_p", "x"))
    after = F.slice("run", F.col("_p") + 2, F.size("run"))
    both = first.select(*WORD, "items", "x", F.explode(after).alias("y"))
    return (both.select(*WORD, F.concat("items", F.array("x.last")).alias("items"), F.col("y.last").alias("last"),
                        F.col("x.word").bitwiseAND(F.col("y.word")).alias("word")).where("word <> 0"))


def frequent_itemsets(lines: DataFrame, min_support: float = 0.01, max_len: int = 4,
                      txn: str = "TransactionID", item: str = "ProductID",
                      assume_distinct: bool = False, per_word: int | None = None) -> DataFrame:
    """All itemsets with ``support >= min_support`` and at most ``max_len`` items.

    ``lines`` holds one row per (basket, item), or repeats them unless ``assume_distinct``; the
    number of baskets is counted before any pruning. Output: ``items`` (sorted array), ``size``, ``freq``,
    ``support``, ``itemsets_str``.
    """
    spark = lines.sparkSession
    pairs = lines.select(F.col(txn).alias("t"), F.col(item).cast("string").alias("i"))
    if not assume_distinct:
        pairs = pairs.distinct()  # partial sums first: a repeated line must not crowd one range
    pairs = keep(pairs)  # read for the size of the ranges and for the words
    cached = [pairs]
    try:
        about = pairs.agg(F.approx_count_distinct("t")).first()[0]
        words = keep(vertical_words(pairs, max(1, about // RANGE_BASKETS)))
        cached.append(words)
        n = words.groupBy(*WORD).agg(F.bit_count(F.bit_or("word")).alias("n")).agg(F.sum("n")).first()[0] or 0
        if n == 0:
            return spark.createDataFrame([], ITEMSET_SCHEMA)
        bits = F.sum(F.bit_count("word")).alias("freq")
        singles = _frequent(words.groupBy("i").agg(bits), n, min_support)
        coded, m, codes = materialize(coded_items(singles))
        levels = [coded.select(F.array("code").alias("items"), "freq")]
        if max_len >= 2 and m > 1:
            if per_word is None:
                width = coded.agg(F.sum("freq")).first()[0] / n
                per_word = WORD_BITS if m <= width * WORD_BITS**0.5 else 1
            found = narrowed(words.join(codes.select("i", "code"), "i")
                             .select(*WORD, F.array().cast("array<int>").alias("items"), F.col("code").alias("last"), "word"), per_word)
            for k in range(2, max_len + 1):
                found = keep(intersections(found))  # read for the counts and for the next level
                cached.append(found)
                counts = found.groupBy("items", "last").agg(bits)
                level, mk, side = materialize(_frequent(counts, n, min_support))
                if mk == 0:
                    break
                levels.append(level.select(F.concat("items", F.array("last")).alias("items"), "freq"))
                if k < max_len:
                    found = found.join(side.select("items", "last"), ["items", "last"], "left_semi")
    finally:
        # every level is checkpointed: the words are no longer needed
        for df in cached:
            df.unpersist()
    sets = levels[0]
    for level in levels[1:]:
        sets = sets.unionByName(level)
    names = (sets.select("items", "freq", F.posexplode("items").alias("_p", "code"))
             .join(codes.select("code", "i"), "code")
             .groupBy("items", "freq").agg(F.array_sort(F.collect_list(F.struct("_p", "i"))).alias("_n")))
    named = names.select(F.col("_n.i").alias("items"), "freq")
    return named.select(
        "items",
        F.size("items").alias("size"),
        F.col("freq").cast("long").alias("freq"),
        (F.col("freq") / F.lit(float(n))).alias("support"),
        F.array_join("items", ", ").alias("itemsets_str"),
    )
