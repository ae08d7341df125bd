"""Source mix: targets, exact words, disjoint blocks over shards, the law of the draws."""

import hashlib
import re
from math import comb

import helpers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from basketcast.llm import mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(1, 2, 3), repeats=3):
    """``(id, size, source_size, target, taken)`` by the rule as it is worded: reshare until none is above."""
    sized = [(i, len(WORD.findall(t or "")), s, hashlib.md5(f"mix:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:16])
             for i, t, s in rows]
    sources = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x, _ in sized if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(size.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * share > repeats * size[s]}
        for s in above or free:
            target[s] = float(repeats * size[s]) if above else weight[s] * share
        free -= above or free
        left -= sum(target[s] for s in above)
    out = []
    for s in sources:
        passes, rest = divmod(min(int(target[s] + 0.5), repeats * size[s]), size[s]) if size[s] else (0, 0)
        at = 0
        for i, n, _, _ in sorted((r for r in sized if r[2] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1])):
            out.append((i, n, size[s], round(target[s], 6), passes * n + max(0, min(n, rest - at))))
            at += n
    return sorted(out, key=str)


def taken_of(mixed):
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)
                   for r in mixed.withColumn("taken", taken).collect()), key=str)


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)
                  for r in E.queries()["op11_source_mix"](spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_awkward_rows(spark):
    docs = helpers.awkward(spark).withColumn("source", F.expr("CASE WHEN shard < 6 THEN 'b' WHEN shard < 8 THEN 'a' END"))
    docs = docs.withColumn("block", F.lit("clash")).withColumn("size", F.lit("clash"))
    mixed = mixing.mix(docs)
    assert taken_of(mixed) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    again = mixing.mix(docs.repartition(3))
    assert taken_of(again) == taken_of(mixed)
    assert mixing.mix(helpers.empty(spark).withColumn("source", F.lit("x"))).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert taken_of(mixing.mix(wordless)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.fixture(scope="module")
def mixed(spark):
    return mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), block_words=256).cache()


def test_every_word_once_per_pass(mixed):
    for r in mixed.collect():
        copies = [d.copy for d in r.draws]
        assert copies == list(range(len(copies))) and all(d.words <= r.size for d in r.draws)
        assert all(d.words == r.size for d in r.draws[:-1])
    per_source = mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.aggregate(
        "draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])).alias("n")).collect()
    assert all(abs(r.n - r.t) <= 0.5 for r in per_source)


def test_blocks_are_dealt_out_whole(mixed):
    rows = mixing.shard_rows(mixed).collect()
    where = {}
    for r in rows:
        where.setdefault(r.block, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())  # a block goes to one shard
    words = [sum(r.words for r in rows if r.shard == k) for k in range(16)]
    assert min(words) > 0 and sum(words) == sum(r.words for r in rows)
    order = [(r.shard, r.block, r.place) for r in rows]
    assert order == sorted(order)


def test_quotas_are_exact(spark):
    quotas = [7, 0, 1000, 31, 90000, 3]
    root = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    leaves = sorted(mixing.splitting_tree(root, 13, "t").collect())
    assert [r.lo for r in leaves] == list(range(13))
    assert [sum(r.counts[k] for r in leaves) for k in range(6)] == quotas
    sizes = [sum(r.counts) for r in leaves]
    assert max(sizes) - min(sizes) <= 1 and all(n >= 0 for r in leaves for n in r.counts)


def test_draws_follow_the_hypergeometric_law(spark):
    n = 20000
    for good, bad, take in ((5, 7, 4), (30, 10, 25), (400, 900, 300), (2, 300, 150)):
        lit = [(F.lit(v) + F.col("id") * 0).cast("long") for v in (good, bad, take)]
        drawn = spark.range(n).select(mixing.hypergeometric(*lit, F.lit("law"), F.col("id")).alias("k")).groupBy("k").count()
        got = {r.k: r["count"] for r in drawn.collect()}
        want = {k: comb(good, k) * comb(bad, take - k) / comb(good + bad, take) * n
                for k in range(max(0, take - bad), min(take, good) + 1)}
        assert set(got) <= set(want)
        cells = [(got.get(k, 0), e) for k, e in want.items() if e > 5]
        assert sum((o - e) ** 2 / e for o, e in cells) < len(cells) + 5 * (2 * len(cells)) ** 0.5
