"""Mixing sources to target weights by a splitting tree of exact block quotas, in DataFrame functions only.

Every source gets a target of words: its weight's part of the budget, at most ``max_repeats`` times
its own words, the excess shared anew by weight until no source is above its limit.  The target
is met exactly (rounded to a word): whole passes over the source, then one shorter pass, whose last
document alone is cut.

* **Permuted stream.**  A source's documents are laid out in the order of a hash of id and text.
  Positions come from sums per (source, ``BUCKETS`` ranges of the hash) and running sums inside a range, so
  a source that holds a third of all rows is spread over as many groups.
* **Blocks and quotas.**  A pass is cut in blocks of ``block_words`` words of the stream; a document belongs to
  the block it starts in (a block inside a longer document is empty).  A source's quota is its number
  of blocks over all passes.
* **Splitting tree.**  The root holds all quotas; a node splits its quotas among the two halves of its output
  shards by a multivariate hypergeometric draw: what the left half gets is what a draw of its number of
  blocks without replacement would hold of each source.  Draws are by rejection (ratio of
  uniforms) from hashed uniforms.  Nodes hold one number per source, never blocks.
* **Disjoint permuted blocks.**  The leaves' counts give every shard its own range of the source's block
  numbers, which are permuted by a multiplication modulo their count.
* **Local shuffle.**  Inside a shard blocks are in the order of a hash, and rows inside a block as well.

Everything hangs on ids, texts and the seed, so reruns agree however rows are split into tasks.

A null text has no words; a null source is a source of its own, after all others; a null id is hashed as
empty.  Rows without words are never drawn.  Repeated rows are drawn like others; which of two equal
rows has which draw is open, their results are the same as a set.  A source's blocks must number fewer
than 2^31 (the job fails otherwise; raise ``block_words``).  An empty frame gives an empty result.  Other
columns are never looked at.
"""

from __future__ import annotations

from math import factorial, lcm, log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.session import broadcast_if_small, cut_lineage

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
SHARDS = 16
SEED = "mix"
BUCKETS = 4096             # three hexadecimal digits of the order hash
_PRIME = (1 << 31) - 1     # coprime to every smaller count of blocks
_TRIES = 64                # rejection rounds of a draw; one accepts with probability over one half
_LOG_FACTORIALS = [log(factorial(n)) for n in range(16)]
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*seed: Column) -> Column:
    """A number inside (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*seed), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def log_factorial(n: Column) -> Column:
    """ln(n!): exact values first, Stirling's series from 16 on."""
    x = n.cast("double")
    series = (x * F.log(x) - x + F.lit(0.5) * F.log(F.lit(2 * pi) * x) + F.lit(1 / 12) / x
              - F.lit(1 / 360) / (x * x * x))
    table = F.array(*[F.lit(v) for v in _LOG_FACTORIALS])
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, n: Column, *seed: Column) -> Column:
    """How many of ``n`` drawn without replacement are good: Stadlober's ratio of uniforms over the smaller
    class and the smaller of drawn and left, mapped back."""
    def ways(s, k):  # minus the log of the count of outcomes with k, but for a constant
        terms = F.array(k, s["few"] - k, s["m"] - k, s["many"] - s["m"] + k)
        return F.aggregate(terms, F.lit(0.0), lambda total, x: total + log_factorial(x))

    def sides(g):
        total = g["good"] + g["bad"]
        return F.struct(g["good"].alias("good"), g["bad"].alias("bad"), g["n"].alias("n"), total.alias("total"),
                        F.least(g["good"], g["bad"]).alias("few"), F.greatest(g["good"], g["bad"]).alias("many"),
                        F.least(g["n"], total - g["n"]).alias("m"))

    def hat(s):
        share = s["few"].cast("double") / s["total"]
        spread = F.sqrt((s["total"] - s["m"]).cast("double") * s["m"] * share * (F.lit(1.0) - share)
                        / F.greatest(s["total"] - 1, F.lit(1)) + F.lit(0.5))
        mode = F.floor((s["m"] + 1).cast("double") * (s["few"] + 1) / (s["total"] + 2)).cast("long")
        mode = F.least(F.greatest(mode, F.lit(0)), s["few"], s["m"])
        return F.struct((s["m"] * share + F.lit(0.5)).alias("centre"), mode.alias("mode"), ways(s, mode).alias("top"),
                        (F.lit(1.7155277699214135) * spread + F.lit(0.8989161620588988)).alias("width"))  # 2 sqrt(2/e), 3 - 2 sqrt(3/e)

    def few_drawn(s, h):
        def attempt(i):
            def at(u):
                x = h["centre"] + h["width"] * (uniform(*seed, i, F.lit(2)) - F.lit(0.5)) / u
                likely = let(F.floor(x).cast("long"), lambda k: F.when(
                    (k <= F.least(s["few"], s["m"])) & (F.lit(2.0) * F.log(u) <= h["top"] - ways(s, k)), k))
                return F.when(x >= 0, likely)
            return let(uniform(*seed, i, F.lit(1)), at)

        first = F.aggregate(F.sequence(F.lit(1), F.lit(_TRIES)), F.lit(None).cast("long"),
                            lambda found, i: F.when(found.isNotNull(), found).otherwise(attempt(i)))
        return F.coalesce(first, h["mode"])

    def mapped(s, k):
        of_smaller = F.when(s["good"] <= s["bad"], k).otherwise(s["m"] - k)
        return F.when(s["n"] == s["m"], of_smaller).otherwise(s["good"] - of_smaller)

    def draw(s):
        certain = F.when((s["n"] <= 0) | (s["good"] <= 0), F.lit(0).cast("long")).when(s["bad"] <= 0, s["n"])
        return certain.when(s["n"] >= s["total"], s["good"]).otherwise(
            let(let(hat(s), lambda h: few_drawn(s, h)), lambda k: mapped(s, k)))

    return let(let(F.struct(good.alias("good"), bad.alias("bad"), n.alias("n")), sides), draw)


def split_quotas(quotas: Column, n: Column, *seed: Column) -> Column:
    """What a draw of ``n`` of all blocks holds of each source: one hypergeometric draw after the other."""
    zero = F.struct(n.cast("long").alias("need"), F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("rest"),
                    F.array().cast("array<bigint>").alias("out"))

    def step(state, q):
        x = hypergeometric(q["n"], state["rest"] - q["n"], state["need"], *seed, q["i"])
        return let(x, lambda k: F.struct((state["need"] - k).alias("need"), (state["rest"] - q["n"]).alias("rest"),
                                         F.array_append(state["out"], k).alias("out")))

    numbered = F.transform(quotas, lambda q, i: F.struct(q.alias("n"), i.alias("i")))
    return F.aggregate(numbered, zero, step)["out"]


def splitting_tree(root: DataFrame, shards: int, seed: str) -> DataFrame:
    """``lo, counts``: each shard's blocks of every source; ``root`` is one row with ``quotas``."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), total.alias("total"), "quotas")

    def upto(shard):  # blocks of the shards before ``shard``
        return (F.col("total").cast("decimal(20,0)") * shard / F.lit(shards)).cast("long")

    for _ in range((shards - 1).bit_length()):
        mid, one = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"), F.col("hi") - F.col("lo") == 1
        left = F.when(one, F.col("quotas")).otherwise(
            split_quotas(F.col("quotas"), upto(mid) - upto(F.col("lo")), F.lit(seed), F.col("lo"), F.col("hi")))
        held = nodes.select("lo", "hi", "total", "quotas", mid.alias("mid"), one.alias("one"), left.alias("left"))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        children = F.when(F.col("one"), F.array(F.struct("lo", "hi", "quotas"))).otherwise(F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("quotas")),
            F.struct(F.col("mid").alias("lo"), "hi", right.alias("quotas"))))
        nodes = held.select("total", F.explode(children).alias("c")).select("c.lo", "c.hi", "total", "c.quotas")
    return nodes.select("lo", F.col("quotas").alias("counts"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source_key, number, weight, source_size, target`` from ``source_key, source_size``.

    Sources in the order of how soon they reach their limit: those before the first that stays within its share
    are limited, all others share the rest by weight.  Comparisons are exact (decimals).
    """
    unit = lcm(*weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    ranked = (sizes.withColumn("number", F.row_number().over(Window.orderBy("source_key")) - 1)
              .withColumn("weight", weight.cast("long"))
              .withColumn("_room", F.col("source_size").cast("decimal(38,0)") * (F.lit(unit) / F.col("weight")).cast("long")))
    soon = Window.orderBy("_room", "number")
    before = soon.rowsBetween(Window.unboundedPreceding, -1)

    def rest(column, factor=1):
        taken = F.coalesce(F.sum(column).over(before), F.lit(0)) * factor
        return (F.sum("source_size" if column == "source_size" else column).over(whole) - taken).cast("decimal(19,0)")

    ranked = ranked.select("*", F.row_number().over(soon).alias("_order"),
                           rest("source_size", max_repeats).alias("_words"), rest("weight").alias("_weights"))
    fits = F.col("weight") * F.col("_words") <= F.col("source_size") * F.lit(max_repeats) * F.col("_weights")
    ranked = ranked.withColumn("_first", F.min(F.when(fits, F.struct("_order", "_words", "_weights"))).over(whole))
    share = F.col("_first._words").cast("double") / F.col("_first._weights").cast("double")
    target = F.when(F.col("_order") < F.col("_first._order"), (F.col("source_size") * max_repeats).cast("double")) \
              .otherwise(F.col("weight") * share)
    return ranked.select("source_key", "number", "weight", "source_size", target.alias("target"))


def source_plan(targets: DataFrame, block_words: int, max_repeats: int, shards: int, seed: str) -> DataFrame:
    """``targets`` with each source's passes, words of the short pass, blocks and every shard's end in its blocks."""
    words = F.least(F.floor(F.col("target") + F.lit(0.5)).cast("long"), F.col("source_size") * max_repeats)
    planned = targets.withColumn("words", words) \
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long"))) \
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size")) \
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long")) \
        .withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long")) \
        .withColumn("quota", F.when(F.col("quota") < _PRIME, F.col("quota")).otherwise(
            F.raise_error(F.lit("too many blocks in a source: raise block_words")).cast("long")))
    planned = cut_lineage(planned)  # one row per source, read by the tree and by the rows
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda s: s["quota"])
    leaves = splitting_tree(planned.agg(quotas.alias("quotas")), shards, seed)
    by_source = (leaves.select("lo", F.posexplode("counts").alias("number", "n"))
                 .groupBy("number").agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("_counts")))  # ``shards`` numbers
    ends = F.transform("_counts", lambda s, i: F.aggregate(F.slice("_counts", F.lit(1), i + 1), F.lit(0).cast("long"),
                                                           lambda a, c: a + c["n"]))
    return planned.join(by_source.select("number", ends.alias("ends")), "number")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, shards: int = SHARDS,
        block_words: int = BLOCK_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: its id, ``source, size, source_size, weight, target`` and ``draws``, an array of
    ``copy, words, shard, block, place``: the shard that takes it, and where blocks and rows stand there."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("source_key"),  # nulls after all others
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.substring(order, 1, 16).alias("order"))
    rows = cut_lineage(rows)  # texts are read once; a row is some 40 bytes
    ranges = rows.groupBy("source_key", F.substring("order", 1, 3).alias("bucket")).agg(F.sum("size").alias("words"))
    ranges = cut_lineage(ranges)
    plan = source_plan(source_targets(ranges.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, max_repeats),
                       block_words, max_repeats, shards, seed)
    upto = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.select("source_key", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("_first"))
    inside = (Window.partitionBy("source_key", "bucket").orderBy("order", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("bucket", F.substring("order", 1, 3))
              .withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(broadcast_if_small(firsts), ["source_key", "bucket"])
              .withColumn("_start", F.col("_first") + F.col("_run"))
              .join(broadcast_if_small(plan), "source_key"))

    def draw(copy, words):
        g = copy * F.col("blocks") + F.expr(f"_start div {int(block_words)}")
        at = F.pmod(g * F.lit(_PRIME) + F.pmod(F.xxhash64(F.lit(seed), "number"), "quota"), F.col("quota"))
        return let(at, lambda b: F.struct(
            copy.cast("int").alias("copy"), words.cast("long").alias("words"),
            F.size(F.filter("ends", lambda e: e <= b)).alias("shard"),
            F.xxhash64(F.lit(seed), "number", b).alias("block"), F.xxhash64(F.lit(seed), "order", copy).alias("place")))

    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1),
                                                    lambda p: draw(p, F.col("size"))))
    short = F.when(F.col("_start") < F.col("rest"),
                   F.array(draw(F.col("passes"), F.least(F.col("size"), F.col("rest") - F.col("_start")))))
    none = F.array().cast("array<struct<copy:int,words:bigint,shard:int,block:bigint,place:bigint>>")
    draws = F.when(F.col("size") > 0, F.concat(F.coalesce(whole, none), F.coalesce(short, none))).otherwise(none)
    return placed.select(F.col("id").alias(id_col), F.expr("CASE WHEN source_key <> 't' THEN substring(source_key, 2) END").alias("source"),
                         "size", "source_size", "weight", "target", draws.alias("draws"))


def shard_rows(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``shard, block, place, id, copy, words`` of every draw, in the order in which the shards are written."""
    rows = mixed.select(F.col(id_col).alias("id"), F.explode("draws").alias("d"))
    rows = rows.select("d.shard", "d.block", "d.place", "id", "d.copy", "d.words")
    return rows.repartitionByRange("shard", "block", "place").sortWithinPartitions("shard", "block", "place")
