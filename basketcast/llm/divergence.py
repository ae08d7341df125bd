"""Source divergence audit: single-pass in-memory indexing, merged runs, streamed pair corrections.

Per language the kept terms are those in at least ``least_docs`` of its documents.  A group is a (language,
source); with ``c`` a term's occurrences in it, ``N`` their sum over kept terms and ``V`` kept terms, the
term's share is ``p = 1 + floor(10^9 (c + 1) / (N + V))``, and the divergence of p from q is ``floor((p - q)^2 / q)``.

* **Index.**  A task counts terms of its documents per group, and their documents per language, in memory until
  ``block_postings`` postings are held.  Then the block is spilled as a run: its terms sorted, cut by hash
  shard and in chunks of ``CHUNK_TERMS``, a compressed row each.
* **Merge.**  A shard's chunks arrive in the order of their first terms.  A heap holds the next term of every
  open chunk; a chunk is opened when the merge reaches its first term, so at most one chunk per
  run is open.  Equal terms meet at the top of the heap, are summed, and terms of too few documents end there.
* **Totals** ``V`` and ``N`` are sums of the merged index by Spark.
* **Pairs.**  A pair's sum over all kept terms is that of terms absent from both, plus what every term changes that
  one side holds (depends on its count only: summed over a histogram of counts), plus corrections for terms
  that both hold: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).  These stream by term, a task adding
  up its pairs of groups before they are shuffled; terms that few sources hold make few pairs.  The
  result has a row for every two sources of a language by contract, so sources are taken to be few
  enough for that, and their totals are broadcast to the tasks.
* **Terms** above their language's share are ranked by value, ``term_ranks`` for each group (the feature).

Arithmetic is exact: integers in numpy while ``N + V`` is under 2^53, decimals in Spark.  Null texts, languages and
sources are empty; a group without terms has its zeros; in a language without kept terms every pair is 0.
Repeated rows count as often as they stand.  An empty frame gives an empty result.  Other columns are never
looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketcast.llm.text import columns_of, rows_out
from basketcast.session import broadcast_if_small, cut_lineage

LEAST_DOCS = 3
TERM_RANKS = 200
SCALE = 10**9
BLOCK_POSTINGS = 600_000
CHUNK_TERMS = 2048
SHARDS_PER_TASK = 4
_PIECE = 1 << 20       # bytes of a text that are split at a time
_PAIRS_HELD = 4_000_000

# Terms are runs of letters and of all characters beyond ASCII: other bytes become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, some ``_PIECE`` bytes at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while len(data) - at > _PIECE:
        end = data.rfind(b" ", at, at + _PIECE)
        end = end if end > at else data.find(b" ", at + _PIECE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


_RUN_TYPES = [("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("sources", pa.list_(pa.string())),
              ("packed", pa.binary())]
_RUN_SCHEMA = "shard int, lang string, first binary, sources array<string>, packed binary"


class Block:
    """Postings in memory: occurrences per (language, source), documents per language."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: str) -> None:
        counts, docs = self.counts.setdefault((lang, source), Counter()), self.docs.setdefault(lang, Counter())
        before, distinct = len(counts) + len(docs), set()
        for terms in term_pieces(text):
            counts.update(terms)
            distinct.update(terms)
        docs.update(distinct)
        self.held += len(counts) + len(docs) - before

    def run(self, shards: int) -> Iterator[tuple]:
        """The block as rows of a run: for each shard and language its terms in order, in chunks."""
        for lang, docs in self.docs.items():
            sources = sorted(s for x, s in self.counts if x == lang)
            tables = [self.counts[lang, s] for s in sources]
            parts: dict[int, list[bytes]] = {}
            for term in sorted(docs):
                parts.setdefault(zlib.crc32(term) % shards, []).append(term)
            for shard, terms in parts.items():
                for at in range(0, len(terms), CHUNK_TERMS):
                    chunk = terms[at:at + CHUNK_TERMS]
                    postings = [[(k, n) for k, table in enumerate(tables) if (n := table.get(term))] for term in chunk]
                    flat = [x for p in postings for x in p]
                    yield shard, lang, chunk[0], sources, _packed(
                        chunk, [docs[t] for t in chunk], [len(p) for p in postings], [k for k, _ in flat], [n for _, n in flat])
        self.__init__()


def _packed(terms: list[bytes], docs: list[int], widths: list[int], sources: list[int], counts: list[int]) -> bytes:
    numbers = np.array([len(terms), len(sources), *docs, *widths, *sources, *counts], dtype="<i8")
    return zlib.compress(numbers.tobytes() + b" ".join(terms), 1)


def _postings(packed: bytes, names: list[str]) -> Iterator[tuple[bytes, int, list[tuple[str, int]]]]:
    """``term, documents, [(source, count)]`` of a chunk, in order."""
    data = zlib.decompress(packed)
    n, m = np.frombuffer(data, dtype="<i8", count=2).tolist()
    numbers = np.frombuffer(data, dtype="<i8", count=2 + 2 * n + 2 * m).tolist()
    docs, widths = numbers[2:2 + n], numbers[2 + n:2 + 2 * n]
    sources, counts = numbers[2 + 2 * n:2 + 2 * n + m], numbers[2 + 2 * n + m:]
    at = 0
    for term, d, w in zip(data[8 * len(numbers):].split(b" "), docs, widths, strict=True):
        yield term, d, [(names[sources[k]], counts[k]) for k in range(at, at + w)]
        at += w


def spilled_runs(docs: DataFrame, shards: int, block_postings: int) -> DataFrame:
    """The runs of every task, as rows of chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(*columns_of(batch, "lang", "source", "text"), strict=True):
                block.add(lang, source, text)
                if block.held >= block_postings:
                    yield from _row_batches(block.run(shards))
        yield from _row_batches(block.run(shards))

    return docs.mapInArrow(run, _RUN_SCHEMA)


def _row_batches(rows: Iterator[tuple], size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield rows_out(held, _RUN_TYPES)
            held = []
    yield rows_out(held, _RUN_TYPES)


_INDEX_TYPES = [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
_INDEX_SCHEMA = "lang string, term string, sources array<string>, counts array<bigint>"


def merged_terms(chunks: Iterator[tuple[str, bytes, list[str], bytes]], least_docs: int) -> Iterator[tuple]:
    """``lang, term, sources, counts`` of the kept terms, from chunks in the order of (language, first term)."""
    heap: list[tuple] = []  # (term, number of the chunk, documents, postings, rest of the chunk)
    opened = 0

    def upto(first: bytes | None) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """Terms before ``first`` (all, if None), each with its sums."""
        while heap and (first is None or heap[0][0] < first):
            term, docs, held = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, number, d, postings, rest = heap[0]
                docs += d
                held.append(postings)
                following = next(rest, None)
                if following is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (following[0], number, following[1], following[2], rest))
            if docs >= least_docs:
                sums: dict[str, int] = {}
                for postings in held:
                    for source, n in postings:
                        sums[source] = sums.get(source, 0) + n
                yield lang, term.decode("utf-8", "surrogatepass"), list(sums), list(sums.values())

    lang = None
    for chunk_lang, first, names, packed in chunks:
        yield from upto(first if chunk_lang == lang else None)
        lang, rest = chunk_lang, _postings(packed, names)
        term, d, postings = next(rest)
        opened += 1
        heapq.heappush(heap, (term, opened, d, postings, rest))
    yield from upto(None)


def term_index(docs: DataFrame, least_docs: int = LEAST_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, term, sources, counts``: the kept terms with their occurrences in each source that has them."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = spilled_runs(docs, SHARDS_PER_TASK * tasks, block_postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for batch in batches:
                yield from zip(*columns_of(batch, "lang", "first", "sources", "packed"), strict=True)

        held, size = [], 0
        for row in merged_terms(chunks(), least_docs):
            held.append(row)
            size += len(row[2]) + 1
            if size > 50_000:
                yield rows_out(held, _INDEX_TYPES)
                held, size = [], 0
        yield rows_out(held, _INDEX_TYPES)

    return (runs.repartition(tasks, "shard").sortWithinPartitions("lang", "first")
            .select("lang", "first", "sources", "packed").mapInArrow(run, _INDEX_SCHEMA))


def share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE (count + 1) / total)`` in decimals (null where the total is 0)."""
    exact = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.when(total > 0, F.call_function("div", exact, total.cast("decimal(19,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """As :func:`share` in 64-bit integers: three decimal digits at a time, for totals under 2^53."""
    rest = counts + 1
    p, rest = rest // totals, rest % totals
    for _ in range(3):
        rest = rest * 1000
        p, rest = p * 1000 + rest // totals, rest % totals
    return p + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_corrections(index: DataFrame, totals: dict[str, tuple[list[str], list[int]]]) -> DataFrame:
    """``lang, a, b, value``: sums over the terms that both sources ``a`` and ``b`` (numbers) hold, per task.

    ``totals`` has each language's sources and their ``N + V``.
    """
    shared = index.sparkSession.sparkContext.broadcast(totals)
    types = [("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {lang: {s: k for k, s in enumerate(names)} for lang, (names, _) in shared.value.items()}
        sizes = {lang: np.array(n, dtype=np.int64) for lang, (_, n) in shared.value.items()}
        sums: dict[str, dict[int, int] | np.ndarray] = {}

        def add(lang: str, at: np.ndarray, counts: np.ndarray) -> None:
            """Terms (rows) that as many sources hold."""
            n = sizes[lang]
            p, p0 = shares(counts, n[at]), shares(np.zeros_like(counts), n[at])
            left, left0, right, right0 = p[:, :, None], p0[:, :, None], p[:, None, :], p0[:, None, :]
            value = distances(left, right) - distances(left, right0) - distances(left0, right) + distances(left0, right0)
            keys = (at[:, :, None] * len(n) + at[:, None, :]).ravel()
            if len(n) ** 2 <= _PAIRS_HELD:
                np.add.at(sums.setdefault(lang, np.zeros(len(n) ** 2, dtype=np.int64)), keys, value.ravel())
                return
            keys, inverse = np.unique(keys, return_inverse=True)
            some, held = np.zeros(len(keys), dtype=np.int64), sums.setdefault(lang, {})
            np.add.at(some, inverse, value.ravel())
            for k, v in zip(keys.tolist(), some.tolist(), strict=True):
                held[k] = held.get(k, 0) + v

        def out() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                size = len(sizes[lang])
                pairs = enumerate(held.tolist()) if isinstance(held, np.ndarray) else held.items()
                yield rows_out([(lang, k // size, k % size, v) for k, v in pairs if v], types)
            sums.clear()

        for batch in batches:
            by_shape: dict[tuple[str, int], list] = {}
            for lang, sources, counts in zip(*columns_of(batch, "lang", "sources", "counts"), strict=True):
                if len(sources) > 1:
                    by_shape.setdefault((lang, len(sources)), []).append(([numbers[lang][s] for s in sources], counts))
            for (lang, width), rows in by_shape.items():
                step = max(1, 1_000_000 // width**2)
                for k in range(0, len(rows), step):
                    add(lang, np.array([r[0] for r in rows[k:k + step]], dtype=np.int64),
                        np.array([r[1] for r in rows[k:k + step]], dtype=np.int64))
            if sum(len(x) for x in sums.values() if isinstance(x, dict)) > _PAIRS_HELD:
                yield from out()
        yield from out()

    return index.select("lang", "sources", "counts").mapInArrow(run, "lang string, a int, b int, value long")


def pair_values(index: DataFrame, groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language.

    ``groups`` has ``lang, source, number, total, kept`` (``total`` = N + V, ``kept`` = V).
    """
    totals: dict[str, tuple[list[str], list[int]]] = {}
    for r in groups.orderBy("lang", "number").toLocalIterator():  # one row per source; the result has their square
        names, sizes = totals.setdefault(r["lang"], ([], []))
        names.append(r["source"])
        sizes.append(r["total"])
    corrections = (pair_corrections(index, totals).groupBy("lang", "a", "b")
                   .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("both")))
    side = groups.select("lang", F.col("source"), F.col("number"), "total", "kept", share(F.lit(0).cast("long"), F.col("total")).alias("p0"))
    left = side.select("lang", "source", F.col("number").alias("a"), F.col("total").alias("total_a"), "kept", F.col("p0").alias("p0_a"))
    right = side.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("total").alias("total_b"), F.col("p0").alias("p0_b"))
    pairs = left.join(right, "lang").where("a <> b")
    pairs = cut_lineage(pairs)  # as many rows as the result
    neither = F.col("kept").cast("decimal(38,0)") * apart(F.col("p0_a"), F.col("p0_b"))
    # how many terms a group holds so many times, and what that changes against each other group
    held = cut_lineage(postings.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")))
    terms = F.col("terms").cast("decimal(38,0)")
    zero = apart(F.col("p0_a"), F.col("p0_b"))
    by_left = (pairs.join(held, ["lang", "source"])
               .select("lang", "a", "b", (terms * (apart(share(F.col("count"), F.col("total_a")), F.col("p0_b")) - zero)).alias("v")))
    by_right = (pairs.join(held.withColumnRenamed("source", "item"), ["lang", "item"])
                .select("lang", "a", "b", (terms * (apart(F.col("p0_a"), share(F.col("count"), F.col("total_b"))) - zero)).alias("v")))
    parts = (pairs.select("lang", "a", "b", neither.alias("v")).unionByName(by_left).unionByName(by_right)
             .unionByName(corrections.select("lang", "a", "b", F.col("both").alias("v"))))
    value = parts.select("lang", "a", "b", F.col("v").cast("decimal(38,0)").alias("v")).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    return (pairs.select("lang", "source", "item", "a", "b").join(value, ["lang", "a", "b"])
            .select("lang", "source", "item", F.coalesce(F.col("v").cast("long"), F.lit(0).cast("long")).alias("value")))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS,
                  block_postings: int = BLOCK_POSTINGS, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far sources lie from each other, and what sets each apart."""
    empty = F.lit("")
    source = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(name)
                           for name, c in (("text", text_col), ("lang", lang_col), ("source", source_col))))
    index = cut_lineage(term_index(source, least_docs, block_postings))
    postings = index.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("z")) \
                    .select("lang", "term", F.col("z.sources").alias("source"), F.col("z.counts").alias("count"))
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    nothing = F.lit(0).cast("long")
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = (source.select("lang", "source").distinct().join(kept, "lang", "left").join(sums, ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("n", nothing).alias("n"), F.coalesce("kept", nothing).alias("kept"))
              .select("lang", "source", "kept", (F.col("n") + F.col("kept")).alias("total"),
                      (F.row_number().over(numbered) - 1).alias("number"), F.sum("n").over(Window.partitionBy("lang")).alias("lang_n")))
    groups = cut_lineage(groups)  # one row per source of a language

    pairs = pair_values(index, groups, postings)
    pair_rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_rows = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(pair_rank).alias("rank"))

    whole = F.aggregate("counts", nothing, lambda a, n: a + n)
    each = (index.select("lang", "term", whole.alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("z"))
            .select("lang", F.col("z.sources").alias("source"), F.col("term").alias("item"), "all", F.col("z.counts").alias("count"))
            .join(broadcast_if_small(groups.select("lang", "source", "total", "kept", "lang_n")), ["lang", "source"]))
    p, q = share(F.col("count"), F.col("total")), share(F.col("all"), F.col("lang_n") + F.col("kept"))
    above = each.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    valued = above.select("lang", "source", "item", apart(F.col("p"), F.col("q")).cast("long").alias("value"))
    term_rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    term_rows = (valued.withColumn("rank", F.row_number().over(term_rank)).where(F.col("rank") <= term_ranks)
                 .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return pair_rows.unionByName(term_rows)
