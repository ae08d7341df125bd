"""Every registered query against a brute-force version on the smallest tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as E
import test_bm25
import test_fingerprint
import test_lm
import test_ngram_join
import test_pfp
import test_secrets
from basketcast.llm import byte_bpe, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name, *cols):
    return sorted(map(tuple, E.queries()[name](spark, SF).select(*cols).collect()), key=str)


def test_op1(spark, rows):
    kinds = ("assign", "access", "hex")
    want = {}
    for i, t in rows:
        base = test_secrets.brute(t or "")
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        want[i] = (*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(text.encode()).hexdigest(), set(text.split(",")))
    for r in E.queries()["op1_secret_scan"](spark, SF).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id][:4]
        assert want[r.doc_id][4] <= set(r.spans.split(","))
        assert r.spans == secrets.written(secrets.Scanner().findings(dict(rows)[r.doc_id] or "")[1])


def test_op2(spark, rows):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in rows}
    got = E.queries()["op2_packing"](spark, SF).collect()
    held, used = {}, {}
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(piece.tobytes())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        used.setdefault(r.doc_id, []).append((r.start, r.length))
    for pieces, total in [(p, None) for p in held.values()] + [(used[i], len(ids[i])) for i in ids]:
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 if total is None else at == total
    sizes = [sum(n for _, n in p) for p in held.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.03 * sum(sizes)


def test_op4(spark, rows):
    assert run(spark, "op4_repeat_removal", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == test_pfp.brute(rows, 400)


def test_op5(spark, rows):
    got = [(q, r, d, round(s, 6)) for q, r, d, s in run(spark, "op5_topk_search", "query_id", "rank", "doc_id", "score")]
    assert sorted(got, key=str) == test_bm25.brute(rows, lambda i: i % 20 == 0, 10)


def test_op6(spark, rows):
    assert run(spark, "op6_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == test_fingerprint.expected(rows)


def test_op7(spark, rows):
    assert run(spark, "op7_ngram_join", "doc_id", "n_shingles", "component_id") == test_ngram_join.brute(rows)


def test_op8(spark, rows):
    got = E.queries()["op8_sharding"](spark, SF).collect()
    text = {i: (t or "").encode() for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32, r.law) for r in got} == {i: (len(b) + 1, zlib.crc32(b), "key") for i, b in text.items()}
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)


def test_op9(spark, rows):
    got = E.queries()["op9_lm_score"](spark, SF).collect()
    want = test_lm.plain(rows)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10(spark, rows):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    want = []
    for i, t in rows:
        ids = np.array(lib.encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert run(spark, "op10_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
