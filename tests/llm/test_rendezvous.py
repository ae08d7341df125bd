from collections import Counter
import zlib

from basketcast.llm.rendezvous import shard_records
from helpers import ROWS, awkward, empty


def test_every_row_placed_with_gapless_slots(spark):
    rows = shard_records(awkward(spark), [1.0] * 4).collect()
    assert len(rows) == len(ROWS)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    text = {k: (t or "").encode() for k, t, *_ in ROWS}
    assert all((r.size, r.text_crc32) == (len(text[r.key]) + 1, zlib.crc32(text[r.key])) for r in rows)
    assert len({r.shard for r in rows if r.key == 6}) == 1  # repeated keys share a shard
    assert shard_records(empty(spark), [1.0] * 4).count() == 0


def test_new_shard_takes_rows_only_into_itself_and_weights_hold(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    weights = [1.0, 2.0, 1.0]
    now = {r.key: r for r in shard_records(docs, weights, added_weight=4.0).collect()}
    grown = {r.key: r.shard for r in shard_records(docs, [*weights, 4.0]).collect()}
    assert all(now[k].grown_shard == grown[k] and grown[k] in (now[k].shard, 3) for k in now)
    share = Counter(grown.values())
    for shard, weight in enumerate([*weights, 4.0]):
        assert abs(share[shard] / 20000 - weight / 8) < 0.015


def test_one_key_with_a_third_of_all_rows(spark):
    docs = spark.range(3000).selectExpr("if(id < 1000, 7, id) AS doc_id", "cast(id AS string) AS text")
    rows = shard_records(docs, [1.0] * 4, slot_groups=8).collect()
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
