"""Source divergence audit: whole results against plain code; blocks, runs and the heap merge on their own."""

import random
import re
from collections import Counter, defaultdict

import helpers
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from basketcast.llm import divergence

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, ranks=200):
    """The contract, term by term, from ``text, lang, source``."""
    rows = [(t or "", x or "", s or "") for t, x, s in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:top])]
    return sorted(out)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, E.queries()["op13_source_divergence"](spark, SF).collect())) == brute(rows)


def random_rows(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Größe", "東京", "Ä", "É"]
    return [(" ".join(rng.choice(words[:rng.choice((10, 100, 304))]) for _ in range(rng.randrange(40))) + "!" * rng.randrange(2),
             rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", "d", None, "Z"))) for _ in range(n)]


def test_small_blocks_give_the_same(spark):
    rows = [*random_rows(400), ("alone", "xx", "a"), (None, "xx", "b"), ("", "yy", "only")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for postings in (50, 100_000):
        got = divergence.audit_sources(docs, block_postings=postings, term_ranks=7)
        assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_awkward_rows(spark):
    docs = helpers.awkward(spark).select("*", F.col("n_bytes").alias("lang"), F.col("shard").cast("string").alias("source"),
                                         F.lit(1).alias("p"), F.lit(2).alias("total"), F.lit("q").alias("term"))
    docs = docs.unionByName(docs).unionByName(docs)
    assert sorted(map(tuple, divergence.audit_sources(docs).collect())) == brute([(r.text, r.lang, r.source) for r in docs.collect()])
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_runs_are_merged_in_order():
    rows = [(t or "", x or "", s or "") for t, x, s in random_rows(300, 8)]
    block, chunks = divergence.Block(), []
    for k, (text, lang, source) in enumerate(rows):
        block.add(lang, source, text)
        if k % 37 == 0:
            chunks += block.run(1)
    chunks += block.run(1)
    assert not block.counts and len({c[1] for c in chunks}) == 3
    chunks.sort(key=lambda c: (c[1], c[2]))
    merged = list(divergence.merged_terms(((c[1], c[2], c[3], c[4]) for c in chunks), 3))
    assert [(m[0], m[1].encode()) for m in merged] == sorted((m[0], m[1].encode()) for m in merged)
    docs, counts = defaultdict(set), Counter()
    for k, (text, lang, source) in enumerate(rows):
        for t in TERM.findall(text.translate(LOWER)):
            docs[lang, t].add(k)
            counts[lang, t, source] += 1
    assert {(x, t) for x, t, _, _ in merged} == {k for k, d in docs.items() if len(d) >= 3}
    assert all(counts[x, t, s] == n for x, t, sources, ns in merged for s, n in zip(sources, ns, strict=True))


def test_long_text_is_split_whole(monkeypatch):
    text = "Ab cD, é" * 1000 + "x" * 500 + " end"
    want = [t.encode() for t in TERM.findall(text.translate(LOWER))]
    for piece in (7, 100, 1 << 20):
        monkeypatch.setattr(divergence, "_PIECE", piece)
        assert [t for terms in divergence.term_pieces(text) for t in terms] == want


def test_shares_are_exact(spark):
    rng = random.Random(1)
    totals = [rng.randrange(1, 1 << rng.randrange(1, 53)) for _ in range(2000)]
    counts = [rng.randrange(t) for t in totals]
    want = [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == want
    df = spark.createDataFrame(list(zip(counts, totals, want, strict=True)), "c long, t long, w long")
    assert df.where(divergence.share(F.col("c"), F.col("t")) != F.col("w")).count() == 0
