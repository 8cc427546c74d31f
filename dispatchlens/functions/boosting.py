"""Gradient-boosted regression trees: those of ``GBTRegressor`` (squared loss, all rows and inputs in each tree), fitted by NumPy.

Inputs are binned once, by the split points that the estimator itself finds, and a partition's bins, labels and predictions are kept
as three arrays. A level of a tree is one job: each partition adds up count, sum and sum of squares of its residuals by node, input
and bin, in the order of its rows. Only these sums reach the driver (a number for each of at most 2^(depth - 1) nodes and all bins,
whatever the number of rows), are added up in the order of the partitions and give the best splits by the estimator's own
arithmetic, so trees and ties come out the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 2.0**-52
INVALID = -np.finfo(float).max


@dataclass
class Bins:
    """Of each input: its split points, or the number of its categories."""

    points: list[np.ndarray]
    categories: dict[int, int]

    def counts(self) -> list[int]:
        return [self.categories.get(i, len(p) + 1) for i, p in enumerate(self.points)]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value, an input a row."""
        kind = np.uint8 if max(self.counts(), default=0) <= 256 else np.int32
        return np.array([c.astype(kind) if i in self.categories else np.searchsorted(self.points[i], c).astype(kind) for i, c in enumerate(x.T)])


@dataclass
class Tree:
    """Nodes by number (1 is the root, 2n and 2n + 1 are n's children): input (-1 in a leaf), bins that go left, prediction."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: dict[int, float] = field(default_factory=dict)  # times the node's rows

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row is in after ``depth`` steps, or the leaf that it ended in."""
        n = bins.shape[1]
        node, flat, at, width = np.ones(n, np.intp), bins.reshape(-1), np.arange(n), self.left.shape[1]
        start, inner, left = np.maximum(self.feature, 0) * n, self.feature >= 0, self.left.reshape(-1)
        for _ in range(depth):
            if not inner.any():
                break
            right = ~left[node * width + flat[start[node] + at]]
            node = np.where(inner[node], 2 * node + right, node)
        return node


@dataclass
class Boosted:
    bins: Bins
    trees: list[Tree]
    weights: list[float]
    depth: int
    label: str

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each input in the gains of all splits, each times its rows."""
        total = np.zeros(len(self.bins.points))
        for t in self.trees:
            for node, gain in t.gain.items():
                total[t.feature[node]] += gain
        return DenseVector(total / total.sum() if total.sum() else total)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Label and prediction of each row."""

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y in unpacked(batches):
                bins = self.bins.of(x)
                p = sum((t.value[t.nodes(bins, self.depth)] * w for t, w in zip(self.trees, self.weights)), np.zeros(len(y)))
                yield pa.RecordBatch.from_arrays([y, pa.array(p)], names=[self.label, "prediction"])

        return plain(rows, self.label).mapInArrow(predict, f"`{self.label}` double, prediction double")


def plain(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1)


def split_points(estimator: GBTRegressor, rows: DataFrame) -> Bins:
    """The split points that ``estimator`` finds in its sample of ``rows``, and the categories of its inputs."""
    jvm = rows.sparkSession._jvm
    single = lambda name: getattr(getattr(jvm, name + "$"), "MODULE$")
    ml = "org.apache.spark.ml"
    estimator._transfer_params_to_java()
    own = estimator._java_obj
    kinds = single(f"{ml}.util.MetadataUtils").getCategoricalFeatures(rows._jdf.schema().apply(estimator.getFeaturesCol()))
    strategy = own.getOldBoostingStrategy(kinds, single("org.apache.spark.mllib.tree.configuration.Algo").Regression()).treeStrategy()
    instances = single(f"{ml}.util.DatasetUtils").extractInstances(own, rows._jdf, jvm.scala.Option.empty())
    metadata = single(f"{ml}.tree.impl.DecisionTreeMetadata").buildMetadata(instances, strategy, 1, estimator.getFeatureSubsetStrategy())
    found = single(f"{ml}.tree.impl.RandomForest").findSplits(instances, metadata, estimator.getSeed())
    categories = {i: kinds.apply(i) for i in range(len(found)) if kinds.contains(i)}
    return Bins([np.array([] if i in categories else [s.threshold() for s in f]) for i, f in enumerate(found)], categories)


def sums_by_bin(bins: np.ndarray, residual: np.ndarray, local: np.ndarray, nodes: int, counts: list[int]) -> list[np.ndarray]:
    """Of each input: count, sum and sum of squares of ``residual`` by node and bin; rows in node ``nodes`` are left out."""
    square, out = residual * residual, []
    for own, n in zip(bins, counts):
        at, size = local * n + own, (nodes + 1) * n
        three = [np.bincount(at, minlength=size), *(np.bincount(at, w, size) for w in (residual, square))]
        out.append(np.array(three, float).reshape(3, nodes + 1, n)[:, :-1])
    return out


def impurity(s: np.ndarray) -> np.ndarray:
    """Variance from count, sum and sum of squares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] == 0, 0.0, (s[2] - s[1] * s[1] / s[0]) / s[0])


def best_splits(sums: list[np.ndarray], bins: Bins, parent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Of each node: gain, input, bins that go left, sums of all rows as the first input has them, of the left and of the right child.

    ``parent``: the nodes' impurity, None for the root. Of equal gains the first input and split wins."""
    nodes = sums[0].shape[1]
    width = max(bins.counts())
    gain, feature = np.full(nodes, -np.inf), np.full(nodes, -1)
    left_bins, child, whole = np.zeros((nodes, width), bool), np.zeros((2, 3, nodes)), sums[0].sum(2)
    first = True
    for i, s in enumerate(sums):
        n = s.shape[2]
        if n < 2:
            continue
        order = np.broadcast_to(np.arange(n), (nodes, n))
        if i in bins.categories:
            with np.errstate(divide="ignore", invalid="ignore"):
                order = np.argsort(np.where(s[0] == 0, np.finfo(float).max, s[1] / s[0]), axis=1, kind="stable")
            s = np.take_along_axis(s, np.broadcast_to(order, s.shape), 2)
        run = np.cumsum(s, 2)
        left, right = run[:, :, :-1], run[:, :, -1:] - run[:, :, :-1]
        if first:
            whole = left[:, :, 0] + right[:, :, 0]
            parent = impurity(whole) if parent is None else parent
            first = False
        count = left[0] + right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            g = parent[:, None] - left[0] / count * impurity(left) - right[0] / count * impurity(right)
        g = np.where((left[0] < 1) | (right[0] < 1) | ~(g >= 0), INVALID, g)
        at, every = g.argmax(1), np.arange(nodes)
        own = g[every, at]
        better = own > gain
        gain, feature = np.where(better, own, gain), np.where(better, i, feature)
        for k, side in enumerate((left, right)):
            child[k][:, better] = side[:, every, at][:, better]
        goes = np.zeros((nodes, width), bool)
        np.put_along_axis(goes, order.copy(), np.arange(n) <= at[:, None], 1)
        left_bins[better] = goes[better]
    return gain, feature, left_bins, whole, child[0], child[1]


def mean(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] == 0, 0.0, s[1] / s[0])


def grown(level_sums, bins: Bins, depth: int) -> Tree:
    """A tree; ``level_sums(tree, level, numbers)`` gives the sums of the nodes with these numbers."""
    size = 2 ** (depth + 1)
    tree = Tree(np.full(size, -1), np.zeros((size, max(bins.counts(), default=1)), bool), np.zeros(size))
    numbers, parent = np.array([1]), None
    for level in range(depth):
        gain, feature, left, whole, *children = best_splits(level_sums(tree, level, numbers), bins, parent)
        if level == 0:
            tree.value[1] = mean(whole)[0]
            count = whole[0]
        inner = gain > 0
        split = numbers[inner]
        tree.feature[split], tree.left[split] = feature[inner], left[inner]
        tree.gain |= dict(zip(split.tolist(), (gain[inner] * count[inner]).tolist()))
        after = []
        for k, s in enumerate(children):
            own = s[:, inner]
            tree.value[2 * split + k] = mean(own)
            after += [(2 * n + k, v, c) for n, v, c in zip(split.tolist(), impurity(own).tolist(), own[0].tolist()) if abs(v) >= EPSILON]
        if not after:
            break
        after.sort()
        numbers, parent, count = (np.array(x) for x in zip(*after))
    for n in range(size // 2 - 1, 0, -1):  # two leaves that say the same are one
        if tree.feature[n] >= 0 and tree.feature[2 * n] < 0 and tree.feature[2 * n + 1] < 0 and tree.value[2 * n] == tree.value[2 * n + 1]:
            tree.feature[n], tree.value[n] = -1, tree.value[2 * n]
            del tree.gain[n]
    return tree


def fit(estimator: GBTRegressor, rows: DataFrame) -> Boosted:
    """The trees of ``estimator`` for ``rows``, whose scan order must not change between jobs (written tables)."""
    label, depth, step = estimator.getLabelCol(), estimator.getMaxDepth(), estimator.getStepSize()
    bins = split_points(estimator, rows)
    counts = bins.counts()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(bins.of(x), y.to_numpy()) for x, y in unpacked(batches)]
        if parts:
            b, y = np.hstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (b, y)], names=["b", "y"])

    kind = np.uint8 if max(counts, default=0) <= 256 else np.int32

    def arrays(r):
        y = np.frombuffer(r["y"])
        return np.frombuffer(r["b"], kind).reshape(-1, len(y)), y, np.zeros(len(y))

    parts = plain(rows, label).mapInArrow(packed, "b binary, y binary").rdd.mapPartitionsWithIndex(lambda i, x: ((i, *arrays(r)) for r in x))
    # a task a core, each for several parts: a round's work on one part is shorter than a task's start
    state = kept(parts.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)))
    trees, weights = [], []
    for k in range(estimator.getMaxIter()):
        before = state
        if k:
            state = kept(state.map(updated(trees[-1], weights[-1], depth)))

        def level_sums(tree: Tree, level: int, numbers: np.ndarray, state=state, k=k) -> list[np.ndarray]:
            where = np.full(2 ** (depth + 1), len(numbers))
            where[numbers] = np.arange(len(numbers))
            found = sorted(state.map(summed(tree, level, where, len(numbers), counts, k)).collect(), key=lambda x: x[0])
            return [total(x) for x in zip(*(sums for _, sums in found))]

        trees.append(grown(level_sums, bins, depth))
        weights.append(step if k else 1.0)
        if before is not state:
            before.unpersist()
    state.unpersist()
    return Boosted(bins, trees, weights, depth, label)


def total(parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sum, in the order of the partitions."""
    out = parts[0].copy()
    for p in parts[1:]:
        out += p
    return out


def kept(rdd):
    return rdd.persist(StorageLevel.MEMORY_AND_DISK)


def updated(tree: Tree, weight: float, depth: int):
    def step(part):
        i, b, y, p = part
        return i, b, y, p + tree.value[tree.nodes(b, depth)] * weight

    return step


def summed(tree: Tree, level: int, where: np.ndarray, nodes: int, counts: list[int], k: int):
    def step(part):
        i, b, y, p = part
        return i, sums_by_bin(b, 2.0 * (y - p) if k else y, where[tree.nodes(b, level)], nodes, counts)

    return step
