"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade 0..K-1.  A text is the set of its hashed features: words, their first
letters, and how many marks, doubled marks, capitals and repeated words there are for
each word, in steps.  One weight vector is shared by all grades, and K-1 ordered thresholds turn the score into a distribution:

    P(grade <= k) = logistic(threshold_k - score).

From it follow the expected grade and the tail probability P(grade >= wanted), by
which documents are selected.

The model is fitted on at most ``max_rows`` labelled rows (a parameter; the rows of
smallest id hash, so the same at every run) in one task, which holds their hashed features; the driver
receives the weights.  Features are screened first: those whose mean grade differs from the
overall mean by fewer than ``least_z`` standard errors get no weight, so the many words
without meaning for the grade cannot add up in long texts.  Scoring reads every
document and whole texts, with the weights as a broadcast of at most ``max_features``.

Null and empty texts have no features and score 0.  Labels with a null or an unknown
id are not used; with no usable label every document has the top grade.  A document
labelled more than once counts once per label.  Rows are scored one by one; an empty
frame gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketcast.llm.shingles import mix
from basketcast.llm.text import columns_of, id_text, rows_out

DIMENSIONS = 1 << 20
MAX_ROWS = 20_000
MAX_FEATURES = 4096
_SHARES = (0.05, 0.1, 0.25, 0.5)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# bytes of words: ASCII letters and digits, and all bytes of other characters
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self):
        self.up, self.down = (np.ones(1, dtype=np.uint64) for _ in range(2))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _numbered(values: np.ndarray, kind: int) -> np.ndarray:
    return (mix(values + np.uint64(kind * 0xD1B54A32D192ED03 % (1 << 64))) & np.uint64(DIMENSIONS - 1)).astype(np.int32)


def raw_features(text: str) -> np.ndarray:
    """Feature numbers of a whole text, with repeats.

    Words are hashed by prefix sums: with S the running sum of byte * base^-place, the
    value of bytes s..e is (S[e] - S[s]) * base^s, whatever the place.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    total = len(start)
    shares = []
    if total:
        up, down = _POWERS.upto(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
        scale = up[start]
        word = (sums[end] - sums[start]) * scale
        far = end - start > 5  # beginnings of longer words
        numbers = [_numbered(word, 1)] + [
            _numbered((sums[start[far] + k] - sums[start[far]]) * scale[far], k) for k in (4, 5)]
        again = np.count_nonzero(word[1:] == word[:-1])
        shares += [(10, again)]
        if len(np.unique(word)) <= total / 2:
            shares += [(11 + total.bit_length(), total - len(np.unique(word)))]
    else:
        numbers, total = [np.empty(0, dtype=np.int32)], 1
    if len(data):
        # how many marks, doubled marks and capital letters there are for each word
        counts = np.bincount(data, minlength=256)
        twice = np.bincount(data[1:][data[1:] == data[:-1]], minlength=256)
        shares += [(100 + b, counts[b]) for b in _MARKS[counts[_MARKS] > 0].tolist()]
        shares += [(400 + b, twice[b]) for b in _MARKS[twice[_MARKS] > 0].tolist()]
        capitals = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        shares += [(700, np.count_nonzero((capitals >= 65) & (capitals <= 90)) / 2)]
        numbers.append(_numbered(np.array([1000 * kind + k for kind, n in shares for k, share in enumerate(_SHARES)
                                           if n and n >= share * total], dtype=np.uint64), 9))
    return np.concatenate(numbers)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    return np.unique(raw_features(text))


@dataclass
class OrdinalModel:
    """Weights of the kept features and the ordered thresholds."""

    kept: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.table = np.zeros(DIMENSIONS, dtype=np.float32)
        self.table[self.kept] = self.weights

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sum of the weights of each text's distinct features (repeats in ``sets`` count once)."""
        return np.array([self.table[np.unique(s[self.table[s] != 0])].sum() for s in sets], dtype=float)

    def grade_probabilities(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade = k)``, a row per score."""
        upto = 1.0 / (1.0 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))
        upto = np.hstack([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))])
        return np.diff(upto, axis=1)


_CHUNK_SETS = 500  # sets that are looked at together: the arrays of all would be many times as large as the sets


def screen(sets: list[np.ndarray], grades: np.ndarray, least_z: float, max_features: int) -> np.ndarray:
    """Features whose documents' mean grade is far from the overall mean, in standard errors."""
    spread = grades.std()
    if not spread:
        return np.empty(0, dtype=np.int32)
    n, total = np.zeros(DIMENSIONS, dtype=np.int64), np.zeros(DIMENSIONS)
    for k in range(0, len(sets), _CHUNK_SETS):
        part = sets[k:k + _CHUNK_SETS]
        cols = np.concatenate(part)
        n += np.bincount(cols, minlength=DIMENSIONS)
        away = np.repeat(grades[k:k + len(part)] - grades.mean(), [len(s) for s in part])
        total += np.bincount(cols, weights=away, minlength=DIMENSIONS)
    z = np.abs(total) / (spread * np.sqrt(np.maximum(n, 1)))
    z[n < max(3, len(grades) // 400)] = 0  # too rare to tell
    best = np.argsort(-z, kind="stable")[:max_features]
    return np.sort(best[z[best] >= least_z]).astype(np.int32)


def fit(sets: list[np.ndarray], grades: np.ndarray, n_grades: int, least_z: float = 5.0, max_features: int = MAX_FEATURES,
        rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood (with a small weight penalty) by Adam over the whole sample."""
    n = len(sets)
    if not n:
        return OrdinalModel(np.empty(0, np.int32), np.empty(0), np.full(n_grades - 1, -50.0))
    grades = np.asarray(grades, dtype=int)
    kept = screen(sets, grades.astype(float), least_z, max_features)
    place = np.full(DIMENSIONS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    found = [place[s] for s in sets]
    found = [f[f >= 0] for f in found]
    rows = np.repeat(np.arange(n), [len(f) for f in found])
    at = np.concatenate(found)
    # thresholds = first, then first + cumulated exp(steps): ordered whatever the steps are
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(kept)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v, k = np.zeros_like(params), np.zeros_like(params), len(kept)
    for t in range(1, rounds + 1):
        steps = np.exp(params[k + 1:])
        thresholds = params[k] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(rows, weights=params[:k][at], minlength=n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        with np.errstate(over="ignore"):
            hi = 1 / (1 + np.exp(-(edges[grades + 1] - score)))
            lo = 1 / (1 + np.exp(-(edges[grades] - score)))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_score = (d_hi - d_lo) / n  # of the mean negative log likelihood
        g = np.zeros_like(params)
        g[:k] = np.bincount(at, weights=by_score[rows], minlength=k) + decay * params[:k]
        edge_hi = np.bincount(grades, weights=d_hi, minlength=n_grades)[:-1]
        edge_lo = np.bincount(grades, weights=d_lo, minlength=n_grades)[1:]
        by_edge = (edge_lo - edge_hi) / n
        g[k] = by_edge.sum()
        g[k + 1:] = np.cumsum(by_edge[::-1])[::-1][1:] * steps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    thresholds = params[k] + np.concatenate([[0.0], np.cumsum(np.exp(params[k + 1:]))])
    return OrdinalModel(kept, params[:k], thresholds)


def rated_features(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``grade, features`` of at most ``max_rows`` rated documents; ``ratings`` has ``doc_id, grade``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("doc_id", pa.int64()), ("grade", pa.int32()), ("features", pa.binary())]
        for batch in batches:
            rows = zip(*columns_of(batch, "doc_id", "grade", "text"), strict=True)
            yield rows_out([(i, g, features(t).astype("<i4").tobytes()) for i, g, t in rows], types)

    order = [F.xxhash64("doc_id"), "doc_id", "grade"]
    chosen = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").orderBy(*order).limit(max_rows)
    # at most max_rows ids, a bound set by a parameter; an id that many rows repeat is limited after the join
    rated = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    return (rated.mapInArrow(run, "doc_id long, grade int, features binary")
            .orderBy(*order, "features").limit(max_rows).select("grade", "features"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> OrdinalModel:
    """The fit runs in one task over the ``max_rows`` rows; the driver receives the kept weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*columns_of(batch, "features", "grade"), strict=True)]
        rows.sort(key=lambda r: (r[1], r[0]))  # the order of tasks must not matter
        model = fit([np.frombuffer(x, dtype="<i4") for x, _ in rows], np.array([g for _, g in rows], dtype=int), n_grades)
        yield rows_out([(model.kept.astype("<i4").tobytes(), model.weights.astype("<f8").tobytes(),
                         model.thresholds.astype("<f8").tobytes())],
                       [(name, pa.binary()) for name in ("kept", "weights", "thresholds")])

    rated = rated_features(id_text(docs, id_col, text_col), ratings, max_rows).coalesce(1)
    found = rated.mapInArrow(run, "kept binary, weights binary, thresholds binary").collect()
    if not found:
        return fit([], np.empty(0, dtype=int), n_grades)
    return OrdinalModel(np.frombuffer(found[0].kept, dtype="<i4"), np.frombuffer(found[0].weights), np.frombuffer(found[0].thresholds))


def grade(docs: DataFrame, model: OrdinalModel, wanted: int, least_tail: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability, keep`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns_of(batch, "doc_id", "text")
            p = shared.value.grade_probabilities(shared.value.scores([raw_features(t) for t in texts]))
            tail = p[:, wanted:].sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(tail >= least_tail)],
                names=["doc_id", "expected_grade", "tail_probability", "keep"])

    return source.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def select_rows(docs: DataFrame, model: OrdinalModel, wanted: int, least_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose tail probability is at least ``least_tail``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            p = shared.value.grade_probabilities(shared.value.scores([raw_features(t or "") for t in texts]))
            yield batch.filter(pa.array(p[:, wanted:].sum(axis=1) >= least_tail))

    return docs.mapInArrow(run, docs.schema)
