"""N-gram Jaccard self-join: rare-first prefix filtering, each pair verified once.

A document's set is its distinct 5-word shingles.  Equal sets are one node.  All sets
are put in one global order of shingles, rare first; two sets whose Jaccard
similarity reaches ``threshold`` share a shingle among the first
``n - ceil(threshold * n) + 1`` of each, so nodes meet on the shingles of those prefixes
only.  A pair that meets must also pass

* the length filter (the smaller set has ``threshold`` of the larger's size),
* the positional filter (the places of the shared shingle leave room for the overlap),
* the suffix filter (each node has a sketch of two bits per shingle, the parities of its
  hash buckets; the bits in which two sketches differ are at most the symmetric difference),

before its sets are fetched and intersected, once per pair.

Frequencies for the order come from all documents: counts per hash bucket, in ``BUCKETS``
buckets, a parameter to raise with the corpus (what several shingles share a bucket for is noise
in the counts).  Any order is exact; the counts only make prefixes rare.

The answer is a component per document, so pairs inside one component need not all be
looked at.  Round one verifies, per meeting shingle, neighbours by size and everyone
with the first; its links give components.  Round two does the same with neighbours that lie
in different components.  In round three every row of a crowded shingle looks for the nearest partner by
sketch that lies in another component; this is repeated with the grown components, and then every remaining pair that meets, lies in different components and passes the filters
is verified.  No link between different components is
lost, and a large group of near copies costs its size, not its square.  In round three the rows of a
crowded shingle are dealt into blocks, and every two blocks meet in a task of their own.

Nulls, empty texts and texts without words have no shingles and link with nothing.
Repeated rows are one node and carry the same component.  A null id takes part in links
but is never a component's id unless the component has no other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.bitmap import bit_of, key_filter
from basketcast.llm.components import connected_components
from basketcast.llm.shingles import mix, shingle_set
from basketcast.llm.text import columns_of, id_text, rows_out, sorted_runs
from basketcast.session import DEFAULT_BROADCAST_ROWS, broadcast_if_small, cut_lineage, stored

PERCENT = 75
_MASK = (1 << 64) - 1
BUCKETS = 1 << 22
_PART = 1 << 15          # buckets per row while counts travel
_SEEN = 500_000          # nodes a task remembers to emit equal sets once
BLOCK_ROWS = 4096        # rows of a gram that are compared in one task
NEAREST_ROUNDS = 1       # rounds over nearest partners before all remaining pairs are verified
CROWDED = 64             # rows of a gram from which a round over nearest partners is worth its while
_PAIRS_PER_TASK = 5_000  # pairs whose sets a task fetches

_MARK_TYPES = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()),
               ("small", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())]
_MARK_SCHEMA = "doc_id long, n_shingles long, node long, sketch binary, small long, part int, counts binary"


def node_of(grams: np.ndarray) -> int:
    """64-bit name of a set."""
    total = (int(np.add.reduce(grams)) ^ len(grams), int(np.bitwise_xor.reduce(grams)))
    name = (_mixed(total[0]) + _mixed(_mixed(total[1]))) & _MASK
    return name - (1 << 64) if name >= 1 << 63 else name


def _mixed(h: int) -> int:
    """``mix`` of one number."""
    h = ((h ^ h >> 33) * 0xFF51AFD7ED558CCD) & _MASK
    h = ((h ^ h >> 33) * 0xC4CEB9FE1A85EC53) & _MASK
    return h ^ h >> 33


def least_overlap(n_a, n_b, percent: int):
    """Smallest intersection with 100 * i >= percent * (n_a + n_b - i)."""
    return -(-(percent * (n_a + n_b)) // (100 + percent))


def sketch_of(grams: np.ndarray) -> bytes:
    """Parities of a set's hash buckets; about two buckets per shingle, a power of two of them."""
    bits = 1 << max(6, (2 * len(grams) - 1).bit_length())
    parity = np.bincount((grams >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the shorter: at most the symmetric difference."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then the task's shingle counts by bucket (a byte each, written whenever one is full)."""
    counts, seen = np.zeros(BUCKETS, dtype=np.uint8), set()

    def out():
        parts = ((p, counts[p * _PART:(p + 1) * _PART]) for p in range(BUCKETS // _PART))
        return rows_out([(None, None, None, None, None, p, zlib.compress(c.tobytes(), 1)) for p, c in parts if c.any()], _MARK_TYPES)

    for batch in batches:
        rows = []
        for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
            grams = shingle_set(text)
            node = node_of(grams) if len(grams) else None
            fresh = node is not None and node not in seen
            sketch = sketch_of(grams) if fresh else None
            rows.append((doc_id, len(grams), node, sketch, small_sketch(sketch) if fresh else None, None, None))
            if fresh:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                bucket = np.sort((grams & np.uint64(BUCKETS - 1)).astype(np.int32))
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                at, n = bucket[first], np.diff(np.r_[first, len(bucket)])
                total = counts[at] + n  # a set's own count per bucket is small
                if total.max() > 255:
                    yield out()
                    counts[:] = 0
                    total = np.minimum(n, 255)
                counts[at] = total
        yield rows_out(rows, _MARK_TYPES)
    yield out()


def sum_parts(rows: DataFrame) -> DataFrame:
    """Sum of ``counts`` (compressed bytes in, unsigned 32-bit out) per ``part``, streamed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*columns_of(batch, "part", "counts"), strict=True):
                more = np.frombuffer(zlib.decompress(counts), dtype=np.uint8)
                if part in sums:
                    sums[part] += more
                else:
                    sums[part] = more.astype(np.uint32)
        yield rows_out([(p, s.astype("<u4").tobytes()) for p, s in sums.items()],
                       [("part", pa.int32()), ("counts", pa.binary())])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("part", "counts").repartition(n, "part").mapInArrow(run, "part int, counts binary")


_PREFIX_TYPES = [("gram", pa.int64()), ("node", pa.int64()), ("place", pa.int32())]


def small_sketch(sketch: bytes) -> int:
    """The sketch folded to 64 bits: settles short sets where they meet."""
    x, n = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while n > 64:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return x - (1 << 64) if x >= 1 << 63 else x


def prefix_rows(source: DataFrame, frequency, percent: int) -> DataFrame:
    """``gram, node, place``: the rare-first prefix of every distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen = frequency.value, set()
        for batch in batches:
            held, size = [], 0
            for (text,) in zip(*columns_of(batch, "text"), strict=True):
                grams = shingle_set(text)
                n = len(grams)
                if not n:
                    continue
                node = node_of(grams)
                if node in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                take = n + (-percent * n) // 100 + 1
                rank = freq[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]
                first = np.lexsort((grams, rank))[:take] if take < n else np.lexsort((grams, rank))
                held.append((grams[first], node))
                size += take
                if size > 200_000:
                    yield _prefix_batch(held)
                    held, size = [], 0
            if held:
                yield _prefix_batch(held)

    return source.select("text").mapInArrow(run, "gram long, node long, place int")


def _prefix_batch(held: list) -> pa.RecordBatch:
    sizes = [len(h[0]) for h in held]
    columns = [np.concatenate([h[0] for h in held]).view(np.int64),
               np.repeat(np.array([h[1] for h in held], dtype=np.int64), sizes),
               np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=pa.schema(_PREFIX_TYPES))


def passes(n_a, place_a, small_a, n_b, place_b, small_b, percent: int) -> np.ndarray:
    """Length and positional filters, and the suffix filter on 64 bits, on arrays."""
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    need = least_overlap(n_a, n_b, percent)
    room = np.minimum(place_a, place_b) + np.minimum(n_a - place_a, n_b - place_b)
    apart = np.bitwise_count(small_a.view(np.uint64) ^ small_b.view(np.uint64)).astype(np.int64)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (room >= need) & (apart <= n_a + n_b - 2 * need)


_NAMES = ["gram", "node", "n", "place", "small"]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only rows of grams that two or more nodes hold, each (gram, node) once, with ``many``: more than two do."""
    for cols in sorted_runs(batches, ["gram", "node", "place"]):
        gram, node = cols[0], cols[1]
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        cols = [c[fresh] for c in cols]
        gram = cols[0]
        same = gram[1:] == gram[:-1]
        many = np.zeros(len(gram), dtype=bool)
        many[1:] |= same
        many[:-1] |= same
        if many.any():
            gram = gram[many]
            edges = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True])
            crowd = np.repeat(np.diff(edges) > 2, np.diff(edges))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[many]) for c in cols), pa.array(crowd)],
                                             schema=pa.schema([*_PREFIX_TYPES, ("many", pa.bool_())]))


_PAIR_TYPES = [("a", pa.int64()), ("b", pa.int64())]


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))],
                                      schema=pa.schema(_PAIR_TYPES))


def _steps_between(percent: int):
    """Round two: neighbours by size in different components, and the first of each component with the gram's first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, node, n, place, small, label in sorted_runs(batches, [*_NAMES, "label"]):
            order = np.lexsort((label, n, gram))
            gram, node, n, place, small, label = (c[order] for c in (gram, node, n, place, small, label))
            new = np.r_[True, gram[1:] != gram[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
            _, lead = np.unique(np.stack([gram, label], axis=1), axis=0, return_index=True)
            i = np.flatnonzero(~new)
            left, right = np.r_[i - 1, first[lead]], np.r_[i, lead]
            ok = label[left] != label[right]
            left, right = left[ok], right[ok]
            ok = passes(n[left], place[left], small[left], n[right], place[right], small[right], percent)
            yield _pair_batch(node[left[ok]], node[right[ok]])
    return run


def _near_pairs(percent: int):
    """Round one: neighbours by size, and everyone with the first of the gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, node, n, place, small in sorted_runs(batches, _NAMES):
            order = np.lexsort((node, n, gram))
            gram, node, n, place, small = (c[order] for c in (gram, node, n, place, small))
            new = np.r_[True, gram[1:] != gram[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
            i = np.flatnonzero(~new)
            left, right = np.r_[i - 1, first[i]], np.r_[i, i]
            ok = passes(n[left], place[left], small[left], n[right], place[right], small[right], percent)
            yield _pair_batch(node[left[ok]], node[right[ok]])
    return run


def folded(sketches: list[bytes]) -> list[np.ndarray | None]:
    """Sketches by size: ``out[k]`` has a row of 2^k bits (as 64-bit words) for every sketch of at least that size."""
    sizes = np.array([8 * len(x) for x in sketches])
    out: list[np.ndarray | None] = [None] * (int(sizes.max()).bit_length() + 1)
    for k in range(int(sizes.max()).bit_length() - 1, 5, -1):
        words = (1 << k) // 64
        rows = np.zeros((len(sketches), words), dtype=np.uint64)
        own = np.flatnonzero(sizes == 1 << k)
        if len(own):
            rows[own] = np.frombuffer(b"".join(sketches[j] for j in own.tolist()), dtype="<u8").reshape(len(own), words)
        longer = out[k + 1] if k + 1 < len(out) else None
        if longer is not None:
            rows |= longer[:, :words] ^ longer[:, words:]  # rows of shorter sketches are zero there
        out[k] = rows
    return out


def _cross_pairs(best: bool):
    """Round three: pairs of a gram in different components that pass all filters, the sketches' included. A
    crowded gram comes in pairs of blocks (``left``, ``right``); one row against a block at a time, so what is
    written is what may be similar, not what meets. With ``best`` each row writes only its nearest partner."""
    def of(percent: int, block: int = 4096):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["key", *_NAMES, "label", "sketch", "left", "right", "block"]
            for key, *cols in sorted_runs(batches, names):
                order = np.lexsort((cols[2], key))
                key, (_, node, n, place, small, label, sketch, first, last, part) = key[order], (c[order] for c in cols)
                edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
                found_a, found_b, held = [], [], 0
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if hi - lo < 2 or (label[lo:hi] == label[lo]).all():
                        continue
                    levels, halves = folded(sketch[lo:hi].tolist()), first[lo] != last[lo]
                    for i in range(lo, hi - 1):
                        # sizes rise, so the partners of i end where they get too large
                        end = lo + int(np.searchsorted(n[lo:hi], 100 * int(n[i]) // percent, side="right"))
                        rows, nearest = levels[(8 * len(sketch[i])).bit_length() - 1], None
                        for at in range(i + 1, end, block):
                            j = np.arange(at, min(at + block, end))
                            j = j[(label[j] != label[i]) & (part[j] != part[i] if halves else True)]
                            if not len(j):
                                continue
                            k = np.full(len(j), i)
                            j = j[passes(n[k], place[k], small[k], n[j], place[j], small[j], percent)]
                            apart = np.bitwise_count(rows[j - lo] ^ rows[i - lo]).sum(axis=1, dtype=np.int64)
                            size = n[j].astype(np.int64) + int(n[i])
                            room = size - 2 * least_overlap(size, 0, percent) - apart
                            ok = room >= 0
                            if not ok.any():
                                continue
                            if best:
                                k = int(np.argmax(np.where(ok, room / size, -1)))
                                if nearest is None or room[k] / size[k] > nearest[0]:
                                    nearest = room[k] / size[k], j[k]
                                continue
                            found_a.append(np.full(int(ok.sum()), node[i]))
                            found_b.append(node[j[ok]])
                            held += int(ok.sum())
                        if nearest is not None:
                            found_a.append(node[i:i + 1])
                            found_b.append(node[nearest[1]:nearest[1] + 1])
                            held += 1
                        if held > 200_000:
                            yield _pair_batch(np.concatenate(found_a), np.concatenate(found_b))
                            found_a, found_b, held = [], [], 0
                if held:
                    yield _pair_batch(np.concatenate(found_a), np.concatenate(found_b))
        return run
    return of


def half_sketches(sketches: DataFrame) -> DataFrame:
    """``node, sketch``: the sketches folded once (those of over 64 bits), for the many rows of a node in round three."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows_out([(node, halved(sketch)) for node, sketch in zip(*columns_of(batch, "node", "sketch"), strict=True)],
                           [("node", pa.int64()), ("sketch", pa.binary())])

    return sketches.select("node", "sketch").mapInArrow(run, "node long, sketch binary")


def halved(sketch: bytes) -> bytes:
    half = len(sketch) // 2
    if half < 8:
        return sketch
    return (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")


def in_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``key, left, right, block``: a gram of over ``block_rows`` rows is dealt into blocks by a hash of the
    node, and every two blocks (and each with itself) are a group of their own, so no task gathers the gram."""
    sizes = rows.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    dealt = (rows.join(broadcast_if_small(sizes), "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    left, right = F.least("block", "other"), F.greatest("block", "other")
    return dealt.withColumns({"left": left, "right": right, "key": F.when(F.col("blocks") == 1, F.col("gram"))
                              .otherwise(F.xxhash64("gram", left, right))}).drop("blocks", "other")


def sketch_filter(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: pairs whose sketches leave room for the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y, n_a, n_b in zip(*columns_of(batch, "a", "b", "x", "y", "n_a", "n_b"), strict=True):
                if differing_bits(x, y) <= n_a + n_b - 2 * least_overlap(n_a, n_b, percent):
                    rows.append((a, b))
            yield rows_out(rows, _PAIR_TYPES)

    asked = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sketches = sketches.join(asked, "node", "left_semi")  # later rounds ask for few
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("n_b"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n_a", "n_b")
            .mapInArrow(run, "a long, b long"))


def sets_of(source: DataFrame, wanted, nodes) -> DataFrame:
    """``node, grams`` (sorted 64-bit hashes) of the documents whose id passes ``wanted`` (or is null; None: all)
    and whose node passes ``nodes``, each node once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits, seen = wanted and wanted.value, nodes.value, set()
        types = [("node", pa.int64()), ("grams", pa.binary())]
        for batch in batches:
            rows, size = [], 0
            if ids is not None:
                column = batch.column(batch.schema.get_field_index("doc_id"))
                hit = ids[bit_of(column.fill_null(0).to_numpy(zero_copy_only=False))] | column.is_null().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(hit))
            for (text,) in zip(*columns_of(batch, "text"), strict=True):
                grams = shingle_set(text)
                if not len(grams):
                    continue
                node = node_of(grams)
                if node in seen or not bits[bit_of(np.array([node], dtype=np.int64))[0]]:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                rows.append((node, grams.astype("<u8").tobytes()))
                size += 8 * len(grams)
                if size > 8 << 20:
                    yield rows_out(rows, types)
                    rows, size = [], 0
            yield rows_out(rows, types)

    return source.mapInArrow(run, "node long, grams binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, n_pairs: int, source: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold; ``members`` has a document id for each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*columns_of(batch, "a", "b", "x", "y"), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    rows.append((a, b))
            yield rows_out(rows, _PAIR_TYPES)

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stored(members.join(nodes, "node").where("doc_id IS NOT NULL").select("doc_id"))
    if ids.count() <= DEFAULT_BROADCAST_ROWS:  # numbers of 8 bytes: only their documents go to the tasks
        named = source.join(F.broadcast(ids), "doc_id", "left_semi").unionByName(source.where("doc_id IS NULL"))
        sets = sets_of(named, None, key_filter(pairs))
    else:
        sets = sets_of(source, key_filter(ids), key_filter(pairs))
    tasks = max(1, -(-n_pairs // _PAIRS_PER_TASK))
    sets = sets.coalesce(tasks)
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    spark = docs.sparkSession
    source = id_text(docs, id_col, text_col)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = cut_lineage(source.mapInArrow(_marks, _MARK_SCHEMA))
    counts = np.zeros(BUCKETS, dtype=np.uint32)
    for row in sum_parts(marks.where("part IS NOT NULL")).toLocalIterator():  # BUCKETS numbers in all
        counts[row["part"] * _PART:(row["part"] + 1) * _PART] = np.frombuffer(row["counts"], dtype="<u4")
    frequency = spark.sparkContext.broadcast(counts)

    # rows of a gram together; a gram that a third of all sets share stays out of prefixes as long as they hold rarer ones
    by_gram = prefix_rows(source, frequency, percent).repartition(n_parts, "gram").sortWithinPartitions("gram", "node")
    shared = stored(by_gram.mapInArrow(_shared, "gram long, node long, place int, many boolean"))

    meeting = broadcast_if_small(shared.select("node").distinct())
    nodes = (marks.where("sketch IS NOT NULL").join(meeting, "node", "left_semi").dropDuplicates(["node"])
             .select("node", "n_shingles", "small", "sketch"))
    members = marks.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sizes = broadcast_if_small(nodes.select("node", F.col("n_shingles").cast("int").alias("n"), "small"))
    shared = stored(shared.join(sizes, "node").select(*_NAMES, "many"))
    sketches = stored(nodes.select("node", "n_shingles", "sketch"))
    crowds = shared.where("many").select(*_NAMES)  # grams of two nodes are settled in round one
    halves = stored(half_sketches(sketches.join(crowds.select("node").distinct(), "node", "left_semi")))

    def meet(rows: DataFrame, pairs_of, key: str = "gram") -> DataFrame:
        grouped = rows.repartition(n_parts, key).sortWithinPartitions(key)
        pairs = grouped.mapInArrow(pairs_of(percent), "a long, b long")
        return pairs.groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b")  # partial sums before the shuffle

    known, links, labels = None, None, None

    def settle(pairs: DataFrame) -> bool:
        """Looks at the pairs that are new, and whether that gave links."""
        nonlocal known, links, labels
        fresh = stored(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"))
        known = fresh if known is None else known.unionByName(fresh)
        likely = stored(sketch_filter(fresh, sketches, percent))
        n = likely.count()
        if not n and links is not None:
            return False
        found = stored(verify(likely, n, source, members, percent))
        gained = links is None or found.limit(1).count() > 0
        links = found if links is None else links.unionByName(found)
        if gained:
            labels = broadcast_if_small(connected_components(links))  # rows of shared grams stay where they are
        return gained

    def labelled() -> DataFrame:
        return crowds.join(labels, "node", "left").select(*_NAMES, F.coalesce("label", "node").alias("label"))

    def crossing(best: bool) -> DataFrame:
        rows = labelled()
        apart = (rows.groupBy("gram").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.count(F.lit(1)).alias("_n"))
                 .where(F.col("_l") != F.col("_h")).where(F.col("_n") >= (CROWDED if best else 2)).select("gram"))
        rows = in_blocks(stored(rows.join(apart, "gram", "left_semi"))).join(halves, "node")
        return meet(rows, _cross_pairs(best), "key")

    settle(meet(shared, _near_pairs))
    settle(meet(labelled(), _steps_between))
    for _ in range(NEAREST_ROUNDS):  # components grow by each row's nearest partner first
        if not settle(crossing(best=True)):
            break
    settle(crossing(best=False))

    rows = marks.where("part IS NULL").select("doc_id", "n_shingles", "node")
    named = (rows.join(labels, "node", "left")
             .select("doc_id", "n_shingles", F.coalesce("label", "node").alias("class")))
    named = cut_lineage(named)
    first = named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return (named.join(first, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
