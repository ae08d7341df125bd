import hashlib
import random

import numpy as np
import pytest

from basketcast.llm import pfp
from basketcast.llm.pfp import remove_repeats
from helpers import ROWS, awkward, empty


def brute(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for s in range(len(t) - least + 1):
            w = t[s:s + least]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - least + 1):
            if seen[t[s:s + least]] > 1:
                gone[s:s + least] = True
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, remove_repeats(df, **kw).select(*cols).collect()), key=str)


def corpus(seed, least):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(least // 6, least)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, least // 2))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [rng.choice([p, p[a:b], p[a:], p[:b]]), text(rng.randrange(0, least // 3))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1][7:]), (102, "ab" * least * 3), (103, "x" * (least + 1)), (104, "y" * least)]
    return rows


@pytest.mark.parametrize("group", [20_000, 1])
@pytest.mark.parametrize("least,seed", [(40, 1), (100, 2), (400, 3)])
def test_against_brute_force(spark, least, seed, group):
    rows = corpus(seed, least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, least=least, group=group) == brute(rows, least)


def test_long_texts_in_parts(monkeypatch):
    rows = corpus(4, 100)
    rows.append((200, " ".join(t for _, t in rows[:20])))
    data = list(pfp.buffers(_batches(rows), 100, True))
    monkeypatch.setattr(pfp, "BUFFER", 1000)
    parts = list(pfp.buffers(_batches(rows), 100, True))
    assert len(parts) > len(data)
    names = lambda bufs: {int(x) for d, s, e, _, _ in bufs for x in pfp.parse(d, s, e, 100)[2]}
    assert names(parts) == names(data)  # the same triggers, however the texts are cut


def _batches(rows):
    import pyarrow as pa
    yield pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})


def test_triggers_depend_on_the_window_only():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    moved = np.concatenate([rng.integers(97, 101, 777, dtype=np.uint8), data])
    for d, at in ((data, 0), (moved, 777)):
        low, size, trigger, lead, _ = pfp.parse(d, np.array([0]), np.array([len(d)]), 400)
        per_window = {}
        for lo, n, t, k in zip(low, size, trigger, lead):
            for s in range(lo, lo + n - 399):
                per_window[s - at] = (int(t), int(lo + k - s))
        assert sorted(per_window) == list(range(-at, len(d) - 399 - at))
        if at:
            assert all(per_window[s] == first[s] for s in first)
        first = per_window


def test_awkward_rows(spark):
    assert got(awkward(spark)) == brute([r[:2] for r in ROWS], 400)
    assert remove_repeats(empty(spark)).count() == 0
