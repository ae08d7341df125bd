import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from basketcast.llm import byte_bpe
from helpers import ROWS, awkward, empty

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [r[1] or "" for r in ROWS] + [" lead", "trail ", "a  b", "\n\n x \ty", "ab" * 500, "thethethe" * 40, "日本語 テキスト"]


def test_as_the_tiktoken_library():
    own = byte_bpe.bpe(RANKS, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for text in TEXTS:
        ids = own.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == lib.encode_ordinary(text)
        assert own.decode(ids).decode() == text


def test_frames(spark):
    got = byte_bpe.round_trip(awkward(spark), RANKS, P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    back = byte_bpe.decode(byte_bpe.encode(awkward(spark), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert byte_bpe.round_trip(empty(spark), RANKS, P.PATTERN).count() == 0


def test_higher_order_fold_equals_the_fold(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    words = [" the", "Größe", " retitioning", "x", "zzqqj", "😀", " antidisestablishment"]
    got = byte_bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r.word: list(r.ids) for r in got} == {w: byte_bpe.fold(w.encode(), ranks) for w in words}
