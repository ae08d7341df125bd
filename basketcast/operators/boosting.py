"""Gradient-boosted regression trees with rows and columns sampled once per tree.

Squared error: a tree fits the residuals ``r`` of the trees before it. With ``S`` the sum of residuals and
``n`` the rows in a node, the node's value is ``S / (n + l2)`` and a split gains
``SL^2 / (nL + l2) + SR^2 / (nR + l2) - S^2 / (n + l2)``; the best cut of the tree's columns is taken if it gains
anything, down to ``max_depth``. A row goes left when its value is below the cut; missing values go right.

* **Bins.** Cuts are up to ``max_bins - 1`` quantiles per column (one aggregate). Rows travel as blocks of one
  byte per column and row, with the residual and a hash of the row's key.
* **One job per level.** Tasks add up sums and counts per (node, column, bin) of their blocks with numpy; the
  histograms of up to ``FAN_IN`` tasks go to the driver, more are added up in levels first. The driver holds
  a histogram and the trees, whatever the number of rows. Where all rows are one task's
  (``ROWS_PER_TASK``), that task's histograms are already whole: it grows the trees itself, in one job,
  by the same function.
* **Sampling.** A tree's rows are those whose key hash, mixed with the tree's number, falls under the
  share; its columns are drawn by the seed. Both are the same at every run and for every split into tasks.
* **Residuals** are brought up to date and checkpointed every ``CHECKPOINT_TREES`` trees; in between, tasks
  add the few newest trees themselves, so a lost executor costs the recomputation of one job.

A model is a node table; :func:`node_table` and :func:`from_node_table` write and read it. Rows are scored in Arrow
batches; :meth:`BoostedTrees.score` compiles a model to one column expression (for some 1,000 nodes: larger
expressions pass the size that Spark compiles).
"""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from basketcast.session import cut_lineage, keep

CHECKPOINT_TREES = 10
FAN_IN = 32
BLOCK_ROWS = 1 << 16
ROWS_PER_TASK = 250_000
LEAST_GAIN = 1e-6
NODE_SCHEMA = "tree int, node int, feature string, cut double, yes int, no int, value double, gain double"


@dataclass
class Tree:
    """Nodes in arrays: ``column`` -1 marks a leaf; ``yes`` is taken when the value is below ``cut``."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    yes: list[int] = field(default_factory=list)
    no: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for part, x in ((self.column, -1), (self.bin, 0), (self.cut, 0.0), (self.yes, -1), (self.no, -1), (self.value, value),
                        (self.gain, 0.0)):
            part.append(x)
        return len(self.column) - 1

    def leaf_of(self, x: np.ndarray, cut: list | None = None) -> np.ndarray:
        """Node of every row (a column of ``x``: bins, or values with ``cut``) as far as the tree has grown."""
        column, yes, no = (np.array(part, dtype=np.int64) for part in (self.column, self.yes, self.no))
        cut = np.array(self.bin if cut is None else cut)
        at = np.zeros(x.shape[1], dtype=np.int64)
        rows = np.arange(x.shape[1])
        while True:
            inner = column[at] >= 0
            if not inner.any():
                return at
            left = x[column[at], rows] < cut[at]
            at = np.where(inner, np.where(left, yes[at], no[at]), at)


@dataclass
class BoostedTrees:
    features: list[str]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def tree_sql(self, tree: Tree, node: int = 0) -> str:
        if tree.column[node] < 0:
            return f"{float(tree.value[node] * self.rate)!r}D"
        return (f"CASE WHEN `{self.features[tree.column[node]]}` < {float(tree.cut[node])!r}D THEN {self.tree_sql(tree, tree.yes[node])}"
                f" ELSE {self.tree_sql(tree, tree.no[node])} END")

    def score(self) -> Column:
        """The model as one expression over the feature columns."""
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + F.expr(self.tree_sql(tree))
        return total

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        """Predictions from one array per feature."""
        x = np.stack(columns)
        out = np.full(x.shape[1], float(self.base))
        for tree in self.trees:
            out += self.rate * np.array(tree.value)[tree.leaf_of(x, tree.cut)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its ``prediction``."""
        shared, names = df.sparkSession.sparkContext.broadcast(self), df.columns
        at = [names.index(f) for f in self.features]
        schema = StructType([*df.schema.fields, StructField("prediction", DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.predict(columns))], names=[*names, "prediction"])

        return df.mapInArrow(run, schema)

    def importances(self) -> dict[str, float]:
        """Each feature's mean gain per split, as a share of all; features never split on have 0."""
        total, splits = dict.fromkeys(self.features, 0.0), dict.fromkeys(self.features, 0)
        for tree in self.trees:
            for column, gain in zip(tree.column, tree.gain, strict=True):
                if column >= 0:
                    total[self.features[column]] += gain
                    splits[self.features[column]] += 1
        mean = {f: total[f] / splits[f] if splits[f] else 0.0 for f in self.features}
        whole = sum(mean.values())
        return {f: x / whole if whole else 0.0 for f, x in mean.items()}


def node_table(model: BoostedTrees, spark: SparkSession) -> DataFrame:
    """One row per node: an inner one has ``feature, cut, yes, no, gain``, a leaf its ``value`` times the rate.
    The row of tree -1 holds the base."""
    rows = [(-1, 0, None, None, None, None, float(model.base), None)]
    for t, tree in enumerate(model.trees):
        for n, column in enumerate(tree.column):
            rows.append((t, n, None, None, None, None, float(tree.value[n] * model.rate), None) if column < 0 else
                        (t, n, model.features[column], float(tree.cut[n]), tree.yes[n], tree.no[n], None, float(tree.gain[n])))
    return spark.createDataFrame(rows, NODE_SCHEMA)


def from_node_table(nodes: DataFrame, features: list[str]) -> BoostedTrees:
    """The model of a written node table (its size is set by trees and depth, not by data)."""
    model = BoostedTrees(list(features), 0.0, 1.0)
    for r in nodes.orderBy("tree", "node").collect():
        if r.tree < 0:
            model.base = r.value
            continue
        while len(model.trees) <= r.tree:
            model.trees.append(Tree())
        tree = model.trees[r.tree]
        at = tree.add(r.value or 0.0)
        if r.feature is not None:
            tree.column[at], tree.cut[at], tree.yes[at], tree.no[at] = features.index(r.feature), r.cut, r.yes, r.no
            tree.gain[at] = r.gain or 0.0
    return model


def split_passes(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """``feature, rows``: how often rows of ``df`` come to a split on each feature, over all trees."""
    passes = {f: [] for f in model.features}
    for tree in model.trees:
        reached = {0: F.lit(True)}
        for node, column in enumerate(tree.column):  # children come after their parent
            if column >= 0:
                f = model.features[column]
                passes[f].append(reached[node].cast("long"))
                below = F.coalesce(F.col(f"`{f}`") < F.lit(float(tree.cut[node])), F.lit(False))
                reached[tree.yes[node]], reached[tree.no[node]] = reached[node] & below, reached[node] & ~below
    used = {f: sum(p[1:], p[0]) for f, p in passes.items() if p}
    if not used:
        return df.sparkSession.createDataFrame([], "feature string, rows long")
    sums = df.agg(*(F.sum(c).alias(f) for f, c in used.items()))
    return sums.unpivot([], list(used), "feature", "rows").select("feature", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def column_cuts(frame: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """Sorted distinct cuts per column: quantiles, without the least value (nothing is below it)."""
    marks = [k / max_bins for k in range(1, max_bins)]
    row = frame.agg(*(F.struct(F.percentile_approx(F.col(f"`{f}`").cast("double"), marks, 10_000).alias("q"),
                               F.min(F.col(f"`{f}`").cast("double")).alias("least")).alias(f"c{k}")
                      for k, f in enumerate(features))).first()
    return [np.array([x for x in sorted(set(c.q or [])) if x > c.least], dtype=float) for c in row]


_BLOCK_SCHEMA = "keys binary, bins binary, rest binary"
_BLOCK_TYPES = pa.schema([("keys", pa.binary()), ("bins", pa.binary()), ("rest", pa.binary())])


def _blocks(frame: DataFrame, features: list[str], target: str, key: Column, cuts: list[np.ndarray], base: float) -> DataFrame:
    """``keys, bins, rest``: up to ``BLOCK_ROWS`` rows as bytes, column after column, with their residuals."""
    values = frame.select(key.alias("_key"), F.col(target).cast("double").alias("_y"),
                          *(F.col(f"`{f}`").cast("double").alias(f"x{k}") for k, f in enumerate(features)))

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        columns = [c.to_numpy() for c in table.columns]
        # NaN is above every cut: missing values go right
        bins = np.stack([np.searchsorted(c, x, side="right") for c, x in zip(cuts, columns[2:], strict=True)]).astype(np.uint8)
        rest = columns[1].astype(float) - base
        return pa.RecordBatch.from_arrays([pa.array([columns[0].astype("<i8").tobytes()], pa.binary()),
                                           pa.array([bins.tobytes()], pa.binary()), pa.array([rest.tobytes()], pa.binary())],
                                          schema=_BLOCK_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    return values.mapInArrow(run, _BLOCK_SCHEMA)


def _arrays(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for keys, bins, rest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            keys = np.frombuffer(keys, dtype="<i8")
            yield keys, np.frombuffer(bins, dtype=np.uint8).reshape(columns, len(keys)), np.frombuffer(rest, dtype=float)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees."""
    if share >= 1:
        return np.ones(len(keys), dtype=bool)
    own = _mixed(np.array([seed * 1_000_003 + tree + 1], dtype=np.uint64))
    return (_mixed(keys.view(np.uint64) ^ own) >> np.uint64(11)).astype(float) < share * float(1 << 53)


@dataclass
class _Fit:
    """What the tasks know of a fit."""

    cuts: list[np.ndarray]
    rate: float
    row_share: float
    column_share: float
    l2: float
    max_depth: int
    seed: int

    @property
    def bins(self) -> int:
        return max((len(c) for c in self.cuts), default=0) + 1

    def columns_of(self, number: int) -> list[int]:
        """The columns that a tree may split on."""
        n = len(self.cuts)
        return sorted(random.Random(self.seed * 1_000_003 + number).sample(range(n), max(1, int(self.column_share * n))))

    def count(self, total: np.ndarray, tree: Tree, nodes: list[int], columns: list[int], bins: np.ndarray, rest: np.ndarray) -> None:
        """Add rows to ``total``, ``[2, node, column, bin]``: sums of residuals and counts."""
        place, width = np.full(len(tree.column), -1), self.bins
        place[nodes] = np.arange(len(nodes))
        at = place[tree.leaf_of(bins)]
        here = at >= 0
        bins, rest, at = bins[:, here], rest[here], at[here] * width
        for k, c in enumerate(columns):
            cell = at + bins[c]
            total[0, :, k] += np.bincount(cell, weights=rest, minlength=len(nodes) * width).reshape(-1, width)
            total[1, :, k] += np.bincount(cell, minlength=len(nodes) * width).reshape(-1, width)

    def shape(self, nodes: list[int], columns: list[int]) -> tuple[int, ...]:
        return 2, len(nodes), len(columns), self.bins

    def grow(self, columns: list[int], histograms) -> Tree:
        """A tree, level by level; ``histograms(tree, nodes, columns)`` gives the sums of its rows."""
        tree = Tree()
        nodes = [tree.add(0.0)]
        for depth in range(self.max_depth):
            both, grown = histograms(tree, nodes, columns), []
            for k, node in enumerate(nodes):
                sums, counts = both[0, k], both[1, k]
                if not depth:
                    tree.value[0] = float(sums[0].sum() / (counts[0].sum() + self.l2))
                gain, c, first = _best_split(sums, counts, self.l2)
                if gain <= LEAST_GAIN:
                    continue
                tree.column[node], tree.bin[node], tree.gain[node] = columns[c], first, gain
                tree.cut[node] = float(self.cuts[columns[c]][first - 1])
                for side, part in ((tree.yes, slice(None, first)), (tree.no, slice(first, None))):
                    side[node] = tree.add(float(sums[c, part].sum() / (counts[c, part].sum() + self.l2)))
                    grown.append(side[node])
            nodes = grown
            if not nodes:
                break
        return tree

    def grow_here(self, trees: int, keys: np.ndarray, bins: np.ndarray, rest: np.ndarray) -> Iterator[Tree]:
        """All trees from rows that lie in one task."""
        rest = rest.copy()
        for number in range(trees):
            seen = np.flatnonzero(sampled(keys, number, self.seed, self.row_share))
            some, residual = bins[:, seen], rest[seen]

            def here(tree: Tree, nodes: list[int], columns: list[int], some=some, residual=residual) -> np.ndarray:
                total = np.zeros(self.shape(nodes, columns))
                self.count(total, tree, nodes, columns, some, residual)
                return total

            tree = self.grow(self.columns_of(number), here)
            rest -= self.rate * np.array(tree.value)[tree.leaf_of(bins)]
            yield tree


def _histograms(blocks: DataFrame, tasks: int, fit: _Fit, number: int, recent: list[Tree], tree: Tree, nodes: list[int],
                columns: list[int]) -> np.ndarray:
    """The sums of a tree's rows over all blocks; ``recent`` trees are not yet in the residuals."""
    shape = fit.shape(nodes, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for keys, bins, rest in _arrays(batches, len(fit.cuts)):
            seen = np.flatnonzero(sampled(keys, number, fit.seed, fit.row_share))
            bins, rest = bins[:, seen], rest[seen]
            for old in recent:
                rest = rest - fit.rate * np.array(old.value)[old.leaf_of(bins)]
            fit.count(total, tree, nodes, columns, bins, rest)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = blocks.mapInArrow(run, "sums binary")
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(add, "sums binary")
    total = np.zeros(shape)
    for r in parts.collect():  # at most FAN_IN histograms
        total += np.frombuffer(r.sums).reshape(shape)
    return total


def _best_split(sums: np.ndarray, counts: np.ndarray, l2: float) -> tuple[float, int, int]:
    """``(gain, column place, first bin on the right)`` of a node; the first of equals."""
    left_s, left_n = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(counts, axis=1)[:, :-1]
    s, n = sums.sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
    right_s, right_n = s - left_s, n - left_n
    gain = left_s**2 / (left_n + l2) + right_s**2 / (right_n + l2) - s**2 / (n + l2)
    gain[(left_n < 1) | (right_n < 1)] = -np.inf
    if not gain.size:
        return -np.inf, 0, 0
    k = int(np.argmax(gain))
    return float(gain.flat[k]), k // gain.shape[1], k % gain.shape[1] + 1


def fit_boosted_trees(frame: DataFrame, features: list[str], target: str, key: Column, trees: int = 100, max_depth: int = 6,
                      rate: float = 0.1, row_share: float = 0.8, column_share: float = 0.8, l2: float = 1.0,
                      max_bins: int = 256, seed: int = 42, rows_per_task: int = ROWS_PER_TASK) -> BoostedTrees:
    """Fit on the rows of ``frame``; ``key`` is a 64-bit hash that names a row (for sampling)."""
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins must be between 2 and 256")
    stats = frame.agg(F.count(F.lit(1)), F.avg(F.col(target).cast("double"))).first()
    if not stats[0]:
        raise ValueError("no rows to fit trees on")
    cuts = column_cuts(frame, features, max_bins)
    model = BoostedTrees(list(features), float(stats[1]), rate)
    tasks = max(1, math.ceil(stats[0] / rows_per_task))
    fit = _Fit(cuts, rate, row_share, column_share, l2, max_depth, seed)
    blocks = cut_lineage(_blocks(frame.repartition(tasks), features, target, key, cuts, model.base))
    if tasks == 1:
        model.trees = _fit_in_one_task(blocks, fit, trees)
        return model
    blocks, recent = keep(blocks), []
    try:
        for number in range(trees):
            tree = fit.grow(fit.columns_of(number),
                            lambda *level, n=number, b=blocks: _histograms(b, tasks, fit, n, recent, *level))
            model.trees.append(tree)
            recent.append(tree)
            if len(recent) == CHECKPOINT_TREES and number < trees - 1:
                older, blocks = blocks, keep(_brought_up_to_date(blocks, recent, fit))
                older.unpersist()
                recent = []
    finally:
        blocks.unpersist()
    return model


def _fit_in_one_task(blocks: DataFrame, fit: _Fit, trees: int) -> list[Tree]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(_arrays(batches, len(fit.cuts)))  # at most the rows of one task
        if parts:
            grown = fit.grow_here(trees, *(np.concatenate([p[k] for p in parts], axis=-1) for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(list(grown))], pa.binary())], names=["trees"])

    rows = blocks.coalesce(1).mapInArrow(run, "trees binary").collect()
    return pickle.loads(rows[0].trees)


def _brought_up_to_date(blocks: DataFrame, recent: list[Tree], fit: _Fit) -> DataFrame:
    """The blocks with the newest trees taken off the residuals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bins, rest in _arrays(batches, len(fit.cuts)):
            for tree in recent:
                rest = rest - fit.rate * np.array(tree.value)[tree.leaf_of(bins)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (keys.tobytes(), bins.tobytes(), rest.tobytes())],
                                             schema=_BLOCK_TYPES)

    return cut_lineage(blocks.mapInArrow(run, _BLOCK_SCHEMA))
