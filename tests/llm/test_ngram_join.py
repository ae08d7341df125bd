import random

import numpy as np

from basketcast.llm import ngram_join
from basketcast.llm.components import connected_components
from basketcast.llm.ngram_join import near_duplicates
from helpers import ROWS, awkward, empty


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k), i) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(map(tuple, near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_random_families_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocab) for _ in range(40)]  # a passage that a third of all documents share
    rows = []
    for family in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            if family % 3 == 0:
                words = words[: len(words) // 2] + common + words[len(words) // 2:]
            rows.append((len(rows) * 7 % 1009, " ".join(words).title()))
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_a_drifting_chain_is_one_component(spark):
    words = [f"v{i}" for i in range(200)]
    rows = []
    for k in range(60):  # each text is near the next one only
        rows.append((k, " ".join(words)))
        words = words[4:] + [f"n{k}_{i}" for i in range(4)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_awkward_rows(spark):
    assert got(awkward(spark)) == brute([r[:2] for r in ROWS])
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(500).selectExpr("id AS a", "id + 1 AS b").repartition(4)
    labels = connected_components(links).collect()
    assert len(labels) == 501 and {r.label for r in labels} == {0}


def test_components_of_a_long_path_with_shuffled_names(spark):
    rng = random.Random(3)
    names = [rng.getrandbits(63) - (1 << 62) for _ in range(3001)]
    links = spark.createDataFrame([(a, b) for a, b in zip(names[:1500], names[1:1501])]
                                  + [(b, a) for a, b in zip(names[1501:], names[1502:])], "a long, b long").repartition(4)
    labels = {r.node: r.label for r in connected_components(links).collect()}
    assert labels == {n: min(part) for part in (names[:1501], names[1501:]) for n in part}


def test_filters_never_drop_a_similar_pair():
    import numpy as np
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a = np.unique(np.r_[base[: rng.integers(40, 60)], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])
        b = np.unique(base)
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * len(np.union1d(a, b)):
            continue
        take = {id(s): s[: len(s) + (-75 * len(s)) // 100 + 1] for s in (a, b)}
        shared = np.intersect1d(take[id(a)], take[id(b)])
        assert len(shared)
        arr = lambda v: np.array([v])
        for g in shared:
            assert ngram_join.passes(arr(len(a)), np.searchsorted(a, arr(g)), arr(ngram_join.small_sketch(ngram_join.sketch_of(a))),
                                     arr(len(b)), np.searchsorted(b, arr(g)), arr(ngram_join.small_sketch(ngram_join.sketch_of(b))), 75)[0]
        apart = len(np.setxor1d(a, b))
        assert ngram_join.differing_bits(ngram_join.sketch_of(a), ngram_join.sketch_of(b)) <= apart
        half = b[::3]
        assert ngram_join.differing_bits(ngram_join.sketch_of(a), ngram_join.sketch_of(half)) <= len(np.setxor1d(a, half))


def test_crowded_shingles_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(17)
    template = [f"t{k}" for k in range(30)]
    rows = []
    for k in range(90):  # a template makes up much of every text; some texts are near copies of others
        own = [f"own{k if k % 3 else k + 1}_{j}" for j in range(rng.choice([12, 14, 40]))]
        rows.append((k, " ".join(template[: rng.randrange(20, 31)] + own)))
    want = brute(rows)
    rows_of = ngram_join.in_blocks
    for size in (1, 7):
        monkeypatch.setattr(ngram_join, "in_blocks", lambda df, size=size: rows_of(df, size))
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
    monkeypatch.setattr(ngram_join, "CROWDED", 2)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    monkeypatch.setattr(ngram_join, "NEAREST_ROUNDS", 0)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_set_names_are_mixed_as_arrays_are():
    import numpy as np

    from basketcast.llm import ngram_join
    from basketcast.llm.shingles import mix, shingle_set

    for n in (1, 5, 6, 40, 3000):
        grams = shingle_set(" ".join(f"w{k}" for k in range(n)))
        assert len(grams) == max(1, n - 4) and (grams[1:] > grams[:-1]).all()
        total = np.array([np.add.reduce(grams) ^ np.uint64(len(grams)), np.bitwise_xor.reduce(grams)], dtype=np.uint64)
        assert ngram_join.node_of(grams) == int((mix(total[:1]) + mix(mix(total[1:])))[0].astype(np.int64))
    assert len(shingle_set("a b c d e a b c d e a b c d e")) == 5


def test_halved_sketches_still_bound_the_difference():
    rng = np.random.default_rng(11)
    for n, m in ((400, 400), (900, 700), (20, 25), (40, 300)):
        base = rng.integers(0, 1 << 63, n + m, dtype=np.int64).view(np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[n // 4:n // 4 + m])
        x, y = ngram_join.sketch_of(a), ngram_join.sketch_of(b)
        short = ngram_join.halved(x)
        assert len(short) == max(8, len(x) // 2)
        assert ngram_join.differing_bits(short, ngram_join.halved(y)) <= ngram_join.differing_bits(x, y) <= len(np.setxor1d(a, b))
