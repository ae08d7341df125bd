import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from basketcast.llm.packing import choose_cuts, pack
from basketcast.llm.tokens import json_tokenizer
from helpers import ROWS, awkward, empty

PATH = P.path("byte_bpe_50k.json")


def cost(cuts, penalty, window):
    total, begin = 0, 0
    for cut in cuts:
        n = cut - begin
        total += (0 if n & (n - 1) == 0 and n >= 32 else window - n) + penalty[cut]
        begin = cut
    return total


def test_cuts_cost_least():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([40, 64, 100])
        at, x = [], 0
        for _ in range(rng.randrange(1, 14)):
            x += rng.randrange(1, 33)
            at.append(x)
        pen = {p: rng.choice([0, 2, 8]) for p in at}
        best = {0: 0}
        for j in at:
            best[j] = min(best[i] + cost([j - i], {j - i: pen[j]}, window) for i in best if j - i <= window)
        got = choose_cuts(at, [pen[p] for p in at], window, at[-1])
        assert cost(got, pen, window) == best[at[-1]]


def test_ids_as_the_tokenizers_library():
    t = Tokenizer.from_file(PATH)
    fast = json_tokenizer(PATH, P.PATTERN)
    texts = [r[1] or "" for r in ROWS] + [" lead", "trail ", "a  b", "a\n b \n\n c", "x  y", "it's we'll 3rd", "a\x1c b"]
    for text in texts:
        assert fast.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(spark):
    t = Tokenizer.from_file(PATH)
    rows = pack(awkward(spark).coalesce(2), PATH, P.PATTERN, window=256, block=1024).collect()
    want = sorted(str([*t.encode(x or "", add_special_tokens=False).ids, 1]) for _, x, *_ in ROWS)
    assert sum(r.length for r in rows) == sum(len(eval(w)) for w in want)
    crc = {}
    for i, x, *_ in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        crc[i] = ids
    for r in rows:
        assert r.doc_tokens == len(crc[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(crc[r.doc_id][r.start:r.start + r.length].tobytes())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(empty(spark), PATH, P.PATTERN).count() == 0
