"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes marks triggers: the trigger of a window of ``least``
bytes is its leftmost gram of smallest hash.  It depends on the window's bytes alone, so
equal windows have equal triggers at equal places, and every window has one, so phrases
are never longer than two windows.  A phrase is the stretch of text whose windows share
a trigger; a document's parse is its phrases in order, the dictionary is the distinct
phrases.

1. The dictionary is counted.  A phrase that occurs twice is repeated as a whole; most
   of a repetitive corpus is settled here, however often a text is copied.
2. Phrases that differ but share a trigger may still have windows in common, at the
   edges of repeated passages.  Their bytes meet by trigger, and their windows are put in
   one order (64-bit rolling hashes of the windows, 400 bytes each); equal neighbours are repeated.
   A trigger with more than ``GROUP`` different phrases is not brought together: its
   windows meet by window hash instead, spread over all tasks.
3. The repeated parts of dictionary phrases go back to the places of the phrases, and
   per text the union of those parts is removed.

The suffix order of the whole corpus is not needed to tell whether a window of a fixed
length starts elsewhere: windows are ordered inside their trigger's group only, by hash
(README).  Equal hashes of 64 bits under an equal 64-bit trigger count as equal bytes.

Texts are UTF-8 bytes, null texts empty.  Equal texts have equal results, so work is
done once per distinct text in a task; every row gets its result, repeated ids
included.  Texts shorter than ``least`` bytes are left whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.bitmap import bit_of, key_filter
from basketcast.llm.shingles import mix
from basketcast.llm.text import columns_of, id_text, rows_out, sorted_runs
from basketcast.session import cut_lineage

LEAST = 400
GRAM = 64
GROUP = 5_000       # different phrases of one trigger that are compared in one task
BUFFER = 1 << 20    # bytes parsed at once
_PLACE_BITS = np.uint64(28)
_BASE = 0x2545F4914F6CDD1B  # 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEN = 500_000
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class _Tables:
    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, BUFFER + LEAST)
            self.up, self.down = _powers(_BASE, self.n), _powers(_INVERSE, self.n)
        return self.up[:n], self.down[:n]


_TABLES = _Tables()


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums S, and powers U, with (S[e] - S[s]) * U[s] the hash of bytes s..e wherever they stand."""
    up, down = _TABLES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[data] * down[:len(data)], out=sums[1:])
    return sums, up


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from block-wise running minima."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Phrases of the texts at ``starts..ends`` in ``data``: ``(low, size, trigger, lead, name)``.

    ``low`` is where a phrase begins in ``data``, ``lead`` the bytes before its trigger,
    ``trigger`` and ``name`` 64-bit hashes of the trigger and of the whole phrase.
    """
    none = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int32, np.int64, np.int32, np.int64))
    gram = min(GRAM, least)
    long = ends - starts >= least
    if not long.any():
        return none
    starts, ends = starts[long], ends[long]
    sums, up = prefix_sums(data)
    n = len(data)
    h = mix((sums[gram:] - sums[:n - gram + 1]) * up[:n - gram + 1])
    places = np.arange(len(h), dtype=np.uint64)
    best = sliding_least((h >> _PLACE_BITS << _PLACE_BITS) | places, least - gram + 1)
    counts = ends - starts - least + 1
    at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())  # window starts inside one text
    place = (best[at] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    low, high = at[first], at[np.r_[first[1:], len(at)] - 1]
    trigger, stop = place[first], high + least
    size = stop - low
    name = mix((sums[stop] - sums[low]) * up[low] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               + (trigger - low).astype(np.uint64))
    return low, size.astype(np.int32), h[trigger].view(np.int64), (trigger - low).astype(np.int32), name.view(np.int64)


def text_key(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def buffers(batches: Iterator[pa.RecordBatch], least: int, once: bool) -> Iterator[tuple]:
    """``(data, starts, ends, keys, offsets)``: texts joined to buffers; a longer text comes in parts that
    overlap by ``least - 1`` bytes, ``offsets`` telling where a part begins in its text.
    ``once``: a text the task remembers is left out."""
    seen: set[bytes] = set()
    held, keys, offsets, size = [], [], [], 0

    def out():
        lengths = np.array([len(x) for x in held], dtype=np.int64)
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(held), dtype=np.uint8), ends - lengths, ends, keys, np.array(offsets, dtype=np.int64)

    for batch in batches:
        for (text,) in zip(*columns_of(batch, "text"), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) < least:
                continue
            key = text_key(data)
            if once:
                if key in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
            for begin in range(0, len(data) - least + 1, BUFFER):
                part = data[begin:begin + BUFFER + least - 1]
                held.append(part)
                keys.append(key)
                offsets.append(begin)
                size += len(part)
                if size >= BUFFER:
                    yield out()
                    held, keys, offsets, size = [], [], [], 0
    if held:
        yield out()


def _arrow(types: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in
                                       zip(columns, types, strict=True)], schema=pa.schema(types))


_COUNT_TYPES = [("trigger", pa.int64()), ("name", pa.int64()), ("n", pa.int64())]


def dictionary(source: DataFrame, least: int) -> DataFrame:
    """``trigger, name, n``: phrases whose trigger occurs at least twice in the corpus, with their counts."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            trigger, name = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.lexsort((name, trigger))
            trigger, name = trigger[order], name[order]
            first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (name[1:] != name[:-1])])
            return _arrow(_COUNT_TYPES, trigger[first], name[first], np.diff(np.r_[first, len(name)]))

        for data, starts, ends, _, _ in buffers(batches, least, once=False):
            _, _, trigger, _, name = parse(data, starts, ends, least)
            held.append((trigger, name))
            size += len(name)
            if size > 500_000:  # counted in the task before anything travels
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trigger, name, n in sorted_runs(batches, ["trigger", "name", "n"]):
            new_trigger = np.r_[True, trigger[1:] != trigger[:-1]]
            new = new_trigger | np.r_[True, name[1:] != name[:-1]]
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            group = np.cumsum(new_trigger)[first] - 1
            often = np.bincount(group, weights=total)[group] > 1
            if often.any():
                yield _arrow(_COUNT_TYPES, trigger[first][often], name[first][often], total[often])

    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "trigger long, name long, n long"
    return (source.select("text").mapInArrow(emit, schema).repartition(n, "trigger")
            .sortWithinPartitions("trigger", "name").mapInArrow(shared, schema))


_PHRASE_TYPES = [("trigger", pa.int64()), ("meet", pa.int64()), ("name", pa.int64()), ("low", pa.int32()),
                 ("bytes", pa.binary())]
_PART_TYPES = [("trigger", pa.int64()), ("name", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]


def contested_phrases(source: DataFrame, wanted, crowded, least: int) -> DataFrame:
    """Bytes of phrases whose trigger passes ``wanted``: ``trigger, meet, name, low, bytes``.

    ``meet`` is 0 and ``bytes`` the phrase, or, for a trigger that passes ``crowded``, a row
    per window with ``meet`` its hash, ``low`` its place in the phrase and no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, many, seen = wanted.value, crowded.value, set()
        for data, starts, ends, _, _ in buffers(batches, least, once=True):
            low, size, trigger, _, name = parse(data, starts, ends, least)
            hit = np.flatnonzero(bits[bit_of(trigger)]) if len(trigger) else np.empty(0, dtype=np.int64)
            rows = []
            for k in hit.tolist():
                key = int(name[k])
                if key in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
                rows.append(k)
            hit = np.array(rows, dtype=np.int64)
            if not len(hit):
                continue
            crowd = many[bit_of(trigger[hit], len(many))]
            plain = hit[~crowd]
            if len(plain):
                raw = data.tobytes()
                yield _arrow(_PHRASE_TYPES, trigger[plain], np.zeros(len(plain), dtype=np.int64), name[plain],
                             np.zeros(len(plain), dtype=np.int32),
                             pa.array([raw[b:b + s] for b, s in zip(low[plain].tolist(), size[plain].tolist(), strict=True)],
                                      pa.binary()))
            for k in np.array_split(hit[crowd], 1 + int(crowd.sum()) // 2000):
                if not len(k):
                    continue
                sums, up = prefix_sums(data)
                owner, at, rel = _windows(low[k], size[k], least)
                h = mix((sums[at + least] - sums[at]) * up[at]).view(np.int64) | 1
                yield _arrow(_PHRASE_TYPES, trigger[k][owner], h, name[k][owner], rel.astype(np.int32),
                             pa.nulls(len(h), pa.binary()))

    schema = "trigger long, meet long, name long, low int, bytes binary"
    return source.select("text").mapInArrow(run, schema)


def _windows(low: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the stretches: its stretch, its place, and its place in the stretch."""
    counts = size.astype(np.int64) - least + 1
    owner = np.repeat(np.arange(len(low)), counts)
    rel = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, low[owner] + rel, rel


def _parts(trigger, name, owner, rel, least: int) -> pa.RecordBatch:
    """Repeated windows (sorted by owner and place) as covered stretches of their phrases."""
    new = np.r_[True, (owner[1:] != owner[:-1]) | (rel[1:] > rel[:-1] + least)] if len(owner) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(owner)] - 1 if len(first) else first
    return _arrow(_PART_TYPES, trigger[owner[first]], name[owner[first]], rel[first].astype(np.int32),
                  (rel[last] + least).astype(np.int32))


def repeated_parts(contested: DataFrame, least: int) -> DataFrame:
    """``trigger, name, low, high``: stretches of phrases covered by windows that other phrases hold too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, trigger, meet, name, low, raw in sorted_runs(batches, ["key", "trigger", "meet", "name", "low", "bytes"]):
            _, first = np.unique(np.stack([trigger, meet, name, low.astype(np.int64)], axis=1), axis=0, return_index=True)
            trigger, meet, name, low, raw = (c[first] for c in (trigger, meet, name, low, raw))
            single = np.flatnonzero(meet != 0)
            if len(single):  # windows of crowded triggers: here with all that are equal
                key = np.stack([trigger[single], meet[single]], axis=1)
                _, inverse, counts = np.unique(key, axis=0, return_inverse=True, return_counts=True)
                good = single[counts[inverse.ravel()] > 1]
                yield _arrow(_PART_TYPES, trigger[good], name[good], low[good].astype(np.int32),
                             (low[good] + least).astype(np.int32))
            whole = np.flatnonzero(meet == 0)
            if not len(whole):
                continue
            trigger, name, raw = trigger[whole], name[whole], raw[whole]
            edges = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1], True])
            counts = np.diff(edges)
            pick = np.repeat(counts > 1, counts)  # a phrase alone with its trigger shares no window
            trigger, name, raw = trigger[pick], name[pick], raw[pick]
            # as many complete groups at a time as make up about 2 MB
            edges = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1], True]) if len(trigger) else np.array([0])
            sizes = np.array([len(x) for x in raw], dtype=np.int64)
            begin = 0
            for k in range(1, len(edges)):
                if k < len(edges) - 1 and sizes[edges[begin]:edges[k + 1]].sum() < 2 << 20:
                    continue
                span = slice(edges[begin], edges[k])
                begin = k
                data = np.frombuffer(b"".join(raw[span].tolist()), dtype=np.uint8)
                size = sizes[span]
                sums, up = prefix_sums(data)
                owner, at, rel = _windows(np.cumsum(size) - size, size, least)
                h = mix((sums[at + least] - sums[at]) * up[at])
                order = np.argsort(h, kind="stable")  # equal windows become neighbours
                same = h[order][1:] == h[order][:-1]
                twice = np.zeros(len(h), dtype=bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                yield _parts(trigger[span], name[span], owner[twice], rel[twice], least)

    n = int(contested.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (contested.withColumn("key", F.xxhash64("trigger", "meet")).repartition(n, "key").sortWithinPartitions("key")
            .mapInArrow(run, "trigger long, name long, low int, high int"))


_PLACE_TYPES = [("name", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("last", pa.int64()),
                ("size", pa.int32())]


def places(source: DataFrame, wanted, least: int) -> DataFrame:
    """``name, k1, k2, at, last, size``: where phrases that pass ``wanted`` stand in the distinct texts (named by k1, k2).

    A phrase that follows itself (a text with a short period) is one row from its first place to
    its last: phrases next to each other begin less than ``least`` bytes apart, and their repeated
    parts have ``least`` bytes, so what the row covers has no gaps.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for data, starts, ends, keys, offsets in buffers(batches, least, once=True):
            low, size, _, _, name = parse(data, starts, ends, least)
            if not len(low):
                continue
            text = np.searchsorted(starts, low, side="right") - 1
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
            last = np.r_[first[1:], len(name)] - 1
            hit = bits[bit_of(name[first])]
            first, last = first[hit], last[hit]
            at = low - starts[text] + offsets[text]
            halves = np.array([split_key(k) for k in keys], dtype=np.int64).reshape(-1, 2)[text[first]]
            yield _arrow(_PLACE_TYPES, name[first], halves[:, 0], halves[:, 1], at[first], at[last], size[first])

    return source.select("text").mapInArrow(run, "name long, k1 long, k2 long, at long, last long, size int")


def split_key(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def union_of(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


_ROW_TYPES = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string())]
_TEXT_TYPES = [("k1", pa.int64()), ("k2", pa.int64()), ("bytes", pa.binary())]
_CUT_TYPES = [("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))]


def _all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            rows.append((doc_id, *split_key(text_key(data)), len(data), hashlib.sha256(data).hexdigest()))
        yield rows_out(rows, _ROW_TYPES)


def _texts(wanted, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            rows, size = [], 0
            for (text,) in zip(*columns_of(batch, "text"), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < least:
                    continue
                key = split_key(text_key(data))
                if key in seen or not bits[bit_of(np.array(key[:1], dtype=np.int64))[0]]:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(key)
                rows.append((*key, data))
                size += len(data)
                if size > 8 << 20:
                    yield rows_out(rows, _TEXT_TYPES)
                    rows, size = [], 0
            yield rows_out(rows, _TEXT_TYPES)
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k1, k2, data, covered in zip(*columns_of(batch, "k1", "k2", "bytes", "covered"), strict=True):
            spans = union_of([(c["low"], c["high"]) for c in covered])
            kept, at = hashlib.sha256(), 0
            for low, high in spans:
                kept.update(data[at:low])
                at = high
            kept.update(data[at:])
            rows.append((k1, k2, sum(h - lo for lo, h in spans), len(spans), kept.hexdigest(),
                         [{"low": lo, "high": h} for lo, h in spans]))
        yield rows_out(rows, _CUT_TYPES)


def remove_repeats(docs: DataFrame, least: int = LEAST, group: int = GROUP, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``: every byte in a string of ``least`` bytes
    that also starts elsewhere is removed; ``spans`` are the removed stretches."""
    source = id_text(docs, id_col, text_col)
    shared = cut_lineage(dictionary(source, least))
    by_trigger = shared.groupBy("trigger").agg(F.count(F.lit(1)).alias("kinds"))
    contested = key_filter(by_trigger.where("kinds > 1").select("trigger"))
    crowded = key_filter(by_trigger.where(F.col("kinds") > group).select("trigger"), bits=1 << 20)
    found = repeated_parts(contested_phrases(source, contested, crowded, least), least).select("name", "low", "high")
    whole = shared.where("n > 1").select("name", F.lit(0).alias("low"), F.lit(-1).alias("high"))  # -1: to its end
    parts = cut_lineage(found.unionByName(whole).groupBy("name")
                        .agg(F.collect_list(F.struct("low", "high")).alias("parts")))  # at most one per window of a phrase

    placed = places(source, key_filter(parts.select("name")), least).join(parts, "name")
    stretch = F.transform("parts", lambda p: F.struct(
        (F.col("at") + p["low"]).alias("low"),
        (F.col("last") + F.when(p["high"] < 0, F.col("size")).otherwise(p["high"])).alias("high")))
    by_text = cut_lineage(placed.select("k1", "k2", stretch.alias("stretches")).distinct().groupBy("k1", "k2")
                          .agg(F.flatten(F.collect_list("stretches")).alias("covered")))

    texts = source.select("text").mapInArrow(_texts(key_filter(by_text.select("k1")), least), "k1 long, k2 long, bytes binary")
    cut = (texts.join(by_text, ["k1", "k2"]).select("k1", "k2", "bytes", "covered")
           .mapInArrow(_cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, "
                             "spans array<struct<low:long,high:long>>").dropDuplicates(["k1", "k2"]))
    rows = source.mapInArrow(_all_rows, "doc_id long, k1 long, k2 long, n_bytes long, sha string")
    return rows.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<low:long,high:long>>")).alias("spans"))
