"""Language-model scoring of whole documents, learned from the corpus itself.

Counts: the training documents' tokens are counted over the whole corpus (by 64-bit word
hash, summed in tasks, then by a shuffle).  The ``known_words`` most frequent words, a table
bounded by that parameter, go to all tasks; the counts of other words reach the documents by a
join on the word hash.

Model: a gated recurrent network (``gru``) over symbols: the ``n_head`` most frequent
words, and ``n_tail`` classes of all other words by their ending.  A tail word's
probability is its class's probability times (count + 1) / (class total + words + 1), so every
word, seen or not, has one.  The partitions need a common start: the network is first fitted, in
one task, on ``first_rows`` documents (a parameter), ``FIRST_CHARS`` characters of each.  Then
every partition continues on all of its own training documents (``share`` 1), whole texts, and
the partitions' weights are averaged by tokens; so it learns from every training row.

Score: log10 probability of all tokens of a text, the state carried through windows.

Nulls and empty texts are the end token alone; a null id counts as empty text in the choice of
training rows.  Every row is scored by itself, repeats too; an empty frame gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.gru import Gru, pack_params, unpack_params
from basketcast.llm.shingles import hashes_and_endings
from basketcast.llm.text import columns_of, id_text, rows_out
from basketcast.session import cut_lineage

N_HEAD, N_TAIL, BLOCK, HIDDEN = 1024, 48, 32, 24
KNOWN_WORDS = 1 << 20
FIRST_ROWS = 400
FIRST_CHARS = 20_000
SHARE = 1.0
STREAMS = 256
END = b" "  # no word holds a space
MEMORY_WORDS = 400_000
_PART = 1 << 14
_SPAN = 1 << 22  # characters whose words are looked up together
LOG10 = np.log(10.0)


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tail_class(word: bytes, n_tail: int) -> int:
    """Class of a word outside the head, by its last two bytes."""
    return zlib.crc32(word[-2:]) % n_tail


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


@cache
def _classes(n_tail: int) -> np.ndarray:
    """``tail_class`` by ending, as ``hashes_and_endings`` numbers them; words hold no space."""
    pairs = (bytes((a, b)) if a != 32 else bytes((b,)) for a in range(256) for b in range(256))
    return np.array([tail_class(pair, n_tail) for pair in pairs], dtype=np.uint64)


@cache
def end_key(n_tail: int) -> int:
    return _signed((xxhash.xxh64_intdigest(END) & ~0xFF) | tail_class(END, n_tail))


def keys_of(text: str, n_tail: int) -> np.ndarray:
    """Per token of a text 56 bits of its hash and 8 bits of its tail class: a class total needs no spelling."""
    return keys_of_all([text], n_tail)[0]


def keys_of_all(texts: list[str], n_tail: int) -> tuple[np.ndarray, np.ndarray]:
    """``keys_of`` of many texts one after another, and where each ends."""
    hashes, endings, words = hashes_and_endings(texts)
    ends = np.cumsum(words + 1)
    out = np.empty(len(hashes) + len(texts), dtype=np.int64)
    word = np.ones(len(out), dtype=bool)
    word[ends - 1] = False
    out[word] = ((hashes & ~np.uint64(0xFF)) | _classes(n_tail)[endings]).view(np.int64)
    out[ends - 1] = end_key(n_tail)
    return out, ends


def keyed(word: bytes, n_tail: int) -> int:
    """The key of one word."""
    return end_key(n_tail) if word == END else int(keys_of(word.decode("utf-8", "surrogatepass"), n_tail)[0])


def word_counts(source: DataFrame, n_tail: int) -> DataFrame:
    """``word, n``: training tokens by keyed hash, over all training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merge():
            nonlocal keys, counts, held, size
            new, n = np.unique(np.concatenate(held), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
            held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            texts = [text for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True) if not held_out(doc_id)]
            for lo, hi in _spans(texts, _SPAN):
                held.append(keys_of_all(texts[lo:hi], n_tail)[0])
                size += len(held[-1])
                if size > 1_500_000:
                    merge()
                    if len(keys) > 800_000:
                        yield out()
                        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if held:
            merge()
        yield out()

    return (source.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """What every task knows: the known words' counts, the head's symbols, the tail's totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, train_tokens: int, n_words: int,
                 class_mass: np.ndarray, n_head: int, n_tail: int):
        self.train_tokens, self.n_words, self.n_tail = train_tokens, n_words, n_tail
        end = keyed(END, n_tail)
        first = np.r_[end, words[words != end]][:n_head]  # the end is always in the head
        self.n_head = len(first)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        at = np.minimum(np.searchsorted(self.words, first), max(len(self.words) - 1, 0))
        found = self.words[at] == first if len(self.words) else np.zeros(len(first), bool)
        self.head_counts = np.where(found, self.counts[at], 0) if len(self.words) else np.zeros(len(first), np.int64)
        self.head_order = np.argsort(first)
        self.head_words = first[self.head_order]
        # class totals over all words, less the head's
        mass = class_mass.astype(float).copy()
        for w, c in zip(first.tolist(), self.head_counts.tolist(), strict=True):
            if c:
                mass[w & 0xFF] -= c + 1
        self.tail_mass = mass + 1  # and one for words never seen

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.head_counts, self.tail_mass])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per keyed hash: symbol, count (0 if not known here), log10 of the last factor's divisor, the key
        again where its count is not known here (else 0)."""
        counts = np.zeros(len(keys), dtype=np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
            counts = np.where(self.words[at] == keys, self.counts[at], 0)
        at = np.minimum(np.searchsorted(self.head_words, keys), self.n_head - 1)
        in_head = self.head_words[at] == keys
        cls = keys & 0xFF
        symbols = np.where(in_head, self.head_order[at], self.n_head + cls)
        divisor = np.where(in_head, 0.0, np.log10(self.tail_mass)[cls])
        return symbols, counts, divisor, np.where(in_head | (counts > 0), 0, keys)


class _Known:
    """Places of words in a table of their facts: the known words, then the others as they come."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.facts = vocabulary.look_up(vocabulary.words)
        # a known word's place by the top bits of its key; of words that share them the most frequent
        bits = max(8, len(vocabulary.words).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.places = np.zeros(1 << bits, dtype=np.int32)
        rising = np.argsort(vocabulary.counts, kind="stable")
        self.places[(vocabulary.words.view(np.uint64) >> self.shift)[rising]] = rising

    def __len__(self) -> int:
        return len(self.facts[0]) - len(self.vocabulary.words)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's tokens."""
        words = self.vocabulary.words
        flat, ends = keys_of_all(texts, self.vocabulary.n_tail)
        place = np.zeros(len(flat), dtype=np.int32)
        rest = np.arange(len(flat))
        if len(words):
            place = self.places[flat.view(np.uint64) >> self.shift]
            rest = np.flatnonzero(words[place] != flat)
            at = np.minimum(np.searchsorted(words, flat[rest]), len(words) - 1)
            found = words[at] == flat[rest]
            place[rest[found]] = at[found]
            rest = rest[~found]
        if len(rest):
            new, back = np.unique(flat[rest], return_inverse=True)
            place[rest] = len(self.facts[0]) + back
            self.facts = tuple(np.concatenate(both) for both in zip(self.facts, self.vocabulary.look_up(new), strict=True))
        return np.split(place, ends[:-1]) if texts else []


def gather_vocabulary(counts: DataFrame, n_head: int, n_tail: int, known_words: int) -> Vocabulary:
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    by_class = counts.groupBy(F.col("word").bitwiseAND(F.lit(0xFF)).alias("cls")).agg(F.sum(F.col("n") + 1).alias("mass")).collect()
    mass = np.zeros(n_tail)
    for row in by_class:  # n_tail rows
        mass[row["cls"]] = row["mass"]
    # the most frequent words down to a step of counts at which at most known_words are taken
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()),
                   reverse=True)
    taken, lowest = 0, 10**6
    for at, words in steps:
        if taken + words > known_words and taken:
            break
        taken, lowest = taken + words, at
    end = keyed(END, n_tail)
    top = counts.where((step >= lowest) | (F.col("word") == end)).toArrow().to_pandas()
    top["other"] = top["word"] != end  # the end is always known
    top = top.sort_values(["other", "n", "word"], ascending=[True, False, True]).iloc[:known_words]
    return Vocabulary(top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64), int(totals[0] or 0), int(totals[1]), mass,
                      n_head, n_tail)


def _symbols(vocabulary: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    known = _Known(vocabulary)
    rows = known.rows(texts)
    return [known.facts[0][r] for r in rows]


def fit(source: DataFrame, vocabulary: Vocabulary, first_rows: int = FIRST_ROWS, share: float = SHARE, hidden: int = HIDDEN,
        block: int = BLOCK) -> Gru:
    """The network: fitted on ``first_rows`` training documents, then on ``share`` of all of them in the partitions."""
    spark = source.sparkSession
    model = Gru.start(vocabulary.symbol_counts(), vocabulary.n_head, block, hidden)
    training = source.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2)
    pick = F.xxhash64(F.col("doc_id"), F.lit(17))
    started = spark.sparkContext.broadcast((vocabulary, model))
    size = len(pack_params(model.p))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = started.value
        start.train(_symbols(vocab, [t for batch in batches for t in columns_of(batch, "text")[0]]), passes=2)
        yield rows_out([(pack_params(start.p).tobytes(),)], [("weights", pa.binary())])

    sample = (training.select(pick.alias("pick"), "doc_id", F.substring("text", 1, FIRST_CHARS).alias("text"))
              .orderBy("pick", "doc_id").limit(first_rows).select("text"))
    for row in sample.mapInArrow(first, "weights binary").toLocalIterator():  # one task, one model
        model.p = unpack_params(np.frombuffer(row["weights"]), model.p)

    shared = spark.sparkContext.broadcast((vocabulary, model))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = shared.value
        own = Gru(start.n_head, start.n_tail, start.block, {n: a.copy() for n, a in start.p.items()})
        known, rows, held, seen = _Known(vocab), [], 0, 0

        def train() -> int:
            return own.train(rows, streams=STREAMS, rate=0.004)

        for batch in batches:
            texts = columns_of(batch, "text")[0]
            for lo, hi in _spans(texts, _SPAN):
                if len(known) > MEMORY_WORDS:
                    known = _Known(vocab)
                places = known.rows(texts[lo:hi])
                for place in places:
                    rows.append(known.facts[0][place])
                    held += len(place)
                    if held > 700_000:
                        seen += train()
                        rows, held = [], 0
        seen += train()
        types = [("part", pa.int32()), ("weights", pa.binary()), ("seen", pa.int64())]
        flat = pack_params(own.p) * seen
        yield rows_out([(k, flat[k * _PART:(k + 1) * _PART].tobytes(), seen) for k in range(-(-len(flat) // _PART))] if seen else [],
                       types)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, weights, seen in zip(*columns_of(batch, "part", "weights", "seen"), strict=True):
                more = np.frombuffer(weights)
                old = sums.get(part)
                sums[part] = [old[0] + more, old[1] + seen] if old else [more, seen]
        yield rows_out([(k, w.tobytes(), n) for k, (w, n) in sums.items()],
                       [("part", pa.int32()), ("weights", pa.binary()), ("seen", pa.int64())])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, weights binary, seen long"
    chosen = training.where(F.pmod(pick, F.lit(100_000)) < round(100_000 * share)).select("text")
    flat, found = np.zeros(size), False
    for row in chosen.mapInArrow(learn, schema).repartition(n, "part").mapInArrow(add, schema).toLocalIterator():  # one model
        at = row["part"] * _PART
        flat[at:at + _PART] = np.frombuffer(row["weights"]) / row["seen"]
        found = True
    if found:
        model.p = unpack_params(flat, model.p)
    return model


_SCORE_TYPES = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                ("n_known", pa.int64()), ("log_counts", pa.float64()), ("log_model", pa.float64()),
                ("word", pa.int64()), ("times", pa.int64())]
_SCORE_SCHEMA = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double, "
                 "word long, times long")


def _rare_rows(row: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """How often each word occurs in each row; all other columns are null."""
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])][:len(row)])
    known = {"row": row[first], "word": word[first], "times": np.diff(np.r_[first, len(row)])}
    return pa.RecordBatch.from_arrays([pa.array(known[n], kind) if n in known else pa.nulls(len(first), kind) for n, kind in _SCORE_TYPES],
                                      schema=pa.schema(_SCORE_TYPES))


def _score_rows(shared):
    """A row per document, and a row per (document, word) whose count is not known in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        known, row_no = _Known(vocab), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = columns_of(batch, "doc_id", "text")
            for lo, hi in _spans(texts):
                if len(known) > MEMORY_WORDS:
                    known = _Known(vocab)
                rows = [r for at, end in _spans(texts[lo:hi], _SPAN) for r in known.rows(texts[lo + at:lo + end])]
                symbol, count, divisor, key = known.facts
                flat, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
                symbols = symbol[flat]
                scores = model.score(np.split(symbols, ends[:-1])) / LOG10
                tail = symbols >= vocab.n_head
                log_count = np.log10(count + 1.0)[flat]
                # a tail word: its class's probability times (count + 1) / total of the class
                gain = (log_count - divisor[flat])[tail]
                bounds = np.r_[0, ends]
                tails, seen = (np.r_[0, np.cumsum(a)][bounds].tolist() for a in (tail, count[flat] > 0))
                yield rows_out([(row_no + k, ids[lo + k], held_out(ids[lo + k]), len(r), seen[k + 1] - seen[k],
                                 float(log_count[bounds[k]:bounds[k + 1]].sum()),
                                 scores[k] + float(gain[tails[k]:tails[k + 1]].sum()), None, None) for k, r in enumerate(rows)],
                               _SCORE_TYPES)
                key = key[flat]
                rare = np.flatnonzero(key)
                yield _rare_rows(row_no + np.searchsorted(ends, rare, side="right"), key[rare])
                row_no += len(rows)
    return run


def _spans(texts: list[str], size: int = 32 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def score_documents(docs: DataFrame, n_head: int = N_HEAD, n_tail: int = N_TAIL, known_words: int = KNOWN_WORDS,
                    first_rows: int = FIRST_ROWS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10) of every document."""
    if not 0 < n_tail <= 256:
        raise ValueError("n_tail must be 1 to 256")
    source = id_text(docs, id_col, text_col)
    counts = cut_lineage(word_counts(source, n_tail))
    vocabulary = gather_vocabulary(counts, n_head, n_tail, known_words)
    model = fit(source, vocabulary, first_rows, share)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    scored = cut_lineage(source.mapInArrow(_score_rows(shared), _SCORE_SCHEMA))
    # words that tasks did not know: their counts, by the word's hash
    rare = scored.where("word IS NOT NULL").select("row", "word", "times").join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("times").alias("more_known"),
                                   F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    total = float(np.log10(vocabulary.train_tokens + vocabulary.n_words + 1))
    log_counts = F.col("log_counts") + F.coalesce("more_log", F.lit(0.0))
    return scored.where("word IS NULL").drop("word", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.train_tokens).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("log_model") + F.coalesce("more_log", F.lit(0.0))).alias("score"))
