import hashlib
import random
import re

from basketcast.llm import fingerprint as fp
from helpers import ROWS, awkward, empty


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_parts_combine_to_the_whole():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    n, h1, h2 = fp.fingerprint(data)
    for cut in (0, 1, 65536, 70_001, 199_999):
        for which, whole in ((0, h1), (1, h2)):
            left, right = fp.fingerprint(data[:cut])[1 + which], fp.fingerprint(data[cut:])[1 + which]
            assert fp.combine(left, right, n - cut, which) == whole
    value = 0
    for byte in data[:500]:
        value = (value * fp.BASES[0] + byte + 1) % fp.PRIMES[0]
    assert fp.fingerprint(data[:500])[1] == value


def test_against_brute_force(spark):
    got = fp.exact_dedup(awkward(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected([r[:2] for r in ROWS])
    assert fp.exact_dedup(empty(spark)).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = fp.fingerprints(docs)
    monkeypatch.setattr(fp, "fingerprints", lambda d: real.selectExpr("doc_id", "n_bytes * 0 + 6 AS n_bytes", "1L fp1", "1L fp2", "text_sha256"))

    def one_key_chunks(batches):
        for batch in batches:
            ids, texts = fp.columns_of(batch, "doc_id", "text")
            yield fp.rows_out([(i, len(t), 1, 1, 0, t.encode()) for i, t in zip(ids, texts)], fp._CHUNK_TYPES)

    monkeypatch.setattr(fp, "_chunk_rows", one_key_chunks)
    got = fp.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)

