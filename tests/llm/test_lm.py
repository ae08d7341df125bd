import math
import zlib
from collections import Counter

import numpy as np

from basketcast.llm import lm_score, shingles
from basketcast.llm.gru import Gru
from helpers import ROWS, awkward, empty


def small(seed=0, dtype=np.float64):
    rng = np.random.default_rng(seed)
    model = Gru.start(rng.integers(1, 50, 11), n_head=7, block=3, hidden=4)
    model.p = {n: (a + 0.1 * rng.standard_normal(a.shape)).astype(dtype) for n, a in model.p.items()}
    model.p["inner_bias"][-1, 1:] = -30.0  # places of the last class that hold no word
    return model


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    model = small()
    x, y = rng.integers(0, 12, (5, 3)), rng.integers(0, 11, (5, 3))
    keep = (rng.random((5, 3)) < 0.7).astype(float)
    h = rng.standard_normal((3, 4))
    _, g, _ = model.loss_and_gradients(h, x, y, keep)
    for name, a in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in a.shape)
            was, e = a[at], 1e-5
            a[at] = was + e
            up = model.loss_and_gradients(h, x, y, keep)[0]
            a[at] = was - e
            down = model.loss_and_gradients(h, x, y, keep)[0]
            a[at] = was
            assert abs((up - down) / (2 * e) - g[name][at]) < 1e-5 * max(1, abs(g[name][at])), name


def test_a_distribution_over_symbols():
    model = small()
    states = np.random.default_rng(2).standard_normal((2, 4))
    total = sum(np.exp(model.log_probabilities(states, np.full(2, s))) for s in range(11))
    assert np.allclose(total, 1, atol=1e-9)


def test_state_goes_over_windows():
    rng = np.random.default_rng(3)
    model = small()
    texts = [rng.integers(0, 11, n) for n in (70, 1, 33, 5, 64, 32)]
    for window, streams in ((8, 2), (32, 6), (100, 3)):
        got = model.score(texts, streams=streams, window=window)
        for k, t in enumerate(texts):
            h, x, total = np.zeros((1, 4)), np.array([model.first]), 0.0
            for s in t:
                h = model.step(h, x)[0]
                total += float(model.log_probabilities(h, np.array([s]))[0])
                x = np.array([s])
            assert abs(total - got[k]) < 1e-4


def plain(rows):
    words = lambda t: [*(t or "").encode().lower().split(), b" "]
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out_of(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, out_of(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows), key=str)


def test_counts_and_base_against_plain_loops(spark):
    rows = [(i, t) for i, t, *_ in ROWS] + [(i, f"word{i % 7} common rare{i} Common") for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for known in (4, 1 << 20):  # most counts by the join; none by the join
        got = lm_score.score_documents(df, n_head=20, n_tail=5, known_words=known, first_rows=5, share=0.5).collect()
        assert sorted((*tuple(r)[:5], round(r.base_score, 6)) for r in got if r.doc_id is not None) == \
            sorted(r for r in plain(rows) if r[0] is not None)
        assert all(r.score < 0 for r in got)
    assert lm_score.score_documents(awkward(spark)).count() == len(ROWS)
    assert lm_score.score_documents(empty(spark)).count() == 0


def test_probabilities_of_all_words_sum_to_one():
    words = [f"w{i}".encode() for i in range(30)]
    counts = np.arange(30, 0, -1)
    keys = np.array([lm_score.keyed(w, 6) for w in words])
    mass = np.bincount(keys & 0xFF, weights=counts + 1, minlength=6)
    vocab = lm_score.Vocabulary(keys, counts, int(counts.sum()), 30, mass, 8, 6)
    symbols, count, divisor, _ = vocab.look_up(np.r_[keys, lm_score.keyed(b" ", 6)])
    model = Gru.start(vocab.symbol_counts(), vocab.n_head, 3, 4)
    model.p = {n: a.astype(np.float64) for n, a in model.p.items()}
    h = np.ones((1, 4))
    p = sum(float(np.exp(model.log_probabilities(h, np.array([s]))[0])) * (10 ** (np.log10(c + 1) - d) if s >= vocab.n_head else 1)
            for s, c, d in zip(symbols, count, divisor))
    unseen = sum(float(np.exp(model.log_probabilities(h, np.array([vocab.n_head + k]))[0])) / vocab.tail_mass[k] for k in range(6))
    assert abs(p + unseen - 1) < 1e-6


def test_held_out_text_is_likelier_than_by_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in lm_score.score_documents(df, share=0.5).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_training_text_is_learned_whole(spark):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 11, n) for n in (300, 1, 77, 210)]
    assert small(dtype=np.float32).train(texts, streams=7) == 588  # no token is cut off for an even number of streams
    rows = [(i, f"plain words of text {i}") for i in range(200)]
    odd = next(i for i in range(1000, 2000) if not lm_score.held_out(i))
    scores = []
    for text in ("zebra quagga okapi " * 40, "okapi zebra quagga " * 40):  # equal counts; only the network tells them apart
        df = spark.createDataFrame([*rows, (odd, text)], "doc_id long, text string").coalesce(1)
        scores.append({r.doc_id: r.score for r in lm_score.score_documents(df, first_rows=1).collect()})
    assert all(scores[0][i] != scores[1][i] for i in range(200))


def test_the_first_fit_leaves_no_texts_on_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c " * 50) for i in range(30)], "doc_id long, text string")
    source = lm_score.id_text(df)
    vocabulary = lm_score.gather_vocabulary(lm_score.word_counts(source, 5), 20, 5, 100)
    calls = []  # tasks run in processes of their own
    train = Gru.train
    monkeypatch.setattr(Gru, "train", lambda self, *a, **k: calls.append(1) or train(self, *a, **k))
    lm_score.fit(source, vocabulary, first_rows=10)
    assert not calls


def test_keys_follow_words_and_endings():
    texts = ["", " \t", "a", "A b\x0bab\r\nAB", "né é  x", "z" * 70_000 + " yz " + "w" * 65_536 + " a", "ab c " * 30_000, "\ud800 q"]
    for text in texts:
        words = lm_score.tokens(text)
        keys = lm_score.keys_of(text, 7)
        assert len(keys) == len(words) and keys[-1] == lm_score.end_key(7)
        assert (keys & 0xFF).tolist() == [lm_score.tail_class(w, 7) for w in words]
        assert len(set(zip(words, keys.tolist(), strict=True))) == len(set(words)) == len(set(keys.tolist()))


def test_places_lead_to_the_facts_of_every_word():
    rng = np.random.default_rng(5)
    words = [f"w{k}".encode() for k in range(600)]
    keys = np.array([lm_score.keyed(w, 6) for w in words])
    vocab = lm_score.Vocabulary(keys[:400], np.arange(400, 0, -1), 80_200, 400, np.full(6, 1e6), 8, 6)
    for vocabulary in (vocab, lm_score.Vocabulary(keys[:0], keys[:0], 0, 0, np.zeros(6), 8, 6)):
        known = lm_score._Known(vocabulary)
        for _ in range(2):  # words that are not known come again
            texts = [b" ".join(words[k] for k in rng.integers(0, 600, n)).decode() for n in (0, 1, 300, 2000)]
            for text, row in zip(texts, known.rows(texts), strict=True):
                for got, want in zip(known.facts, vocabulary.look_up(lm_score.keys_of(text, 6)), strict=True):
                    assert got[row].tolist() == want.tolist()
        assert known.rows([]) == []


def test_short_texts_are_hashed_together(monkeypatch):
    texts = ["", "a", " B\x0bab ", "né é  x", "z" * 70_000 + " yz", "", "\ud800 q", *(f"word{i} of text" for i in range(400)), "w " * 9_000]
    calls, hashed = [], shingles._hashes_at
    monkeypatch.setattr(shingles, "_hashes_at", lambda *a: calls.append(1) or hashed(*a))
    keys, ends = lm_score.keys_of_all(texts, 7)
    assert len(calls) < 10
    for text, lo, hi in zip(texts, [0, *ends], ends, strict=False):
        assert keys[lo:hi].tolist() == [lm_score.keyed(w, 7) for w in lm_score.tokens(text)]


def test_words_a_task_does_not_know_are_counted_by_row():
    row, word = np.array([7, 7, 3, 7, 3]), np.array([5, 9, 5, 5, 8])
    got = lm_score._rare_rows(row, word).select(["row", "word", "times", "doc_id"]).to_pylist()
    assert [tuple(r.values()) for r in got] == [(3, 5, 1, None), (3, 8, 1, None), (7, 5, 2, None), (7, 9, 1, None)]
    assert lm_score._rare_rows(row[:0], word[:0]).num_rows == 0
