"""Surrogate tree of a labeling, as a few dozen numbers that score rows anywhere."""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.blocks import matrix

RELIABLE, CAUTION = 0.80, 0.65
SPLIT = re.compile(r"If \(feature (\d+) <= ([-+.\dEe]+|[-+]?Infinity)\)")


@dataclass(frozen=True)
class Leaf:
    """A leaf with the tests on its path: ``(feature, threshold, goes left, node)``."""

    path: tuple
    counts: np.ndarray  # rows per class


@dataclass(frozen=True)
class SurrogateTree:
    names: tuple[str, ...]
    classes: tuple[int, ...]
    feature: np.ndarray  # per node, -1 for a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_no: np.ndarray  # per node, -1 for an inner node
    cover: np.ndarray  # training rows per node
    leaves: tuple[Leaf, ...]
    importances: np.ndarray
    fidelity: float

    @property
    def probabilities(self) -> np.ndarray:
        counts = np.array([leaf.counts for leaf in self.leaves])
        return counts / np.maximum(counts.sum(1, keepdims=True), 1)

    @property
    def predicted(self) -> np.ndarray:
        return np.array(self.classes)[np.array([leaf.counts for leaf in self.leaves]).argmax(1)]

    @property
    def base_values(self) -> np.ndarray:
        counts = np.array([leaf.counts for leaf in self.leaves])
        return (counts.sum(1) / counts.sum()) @ self.probabilities

    def leaf_rows(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of every row."""
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            at = node[inner]
            goes_left = x[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])
        return self.leaf_no[node]

    def leaf_column(self, features: str = "features") -> Column:
        """Leaf number as a plain expression."""
        x = F.col(features)

        def at(node: int) -> Column:
            if self.feature[node] < 0:
                return F.lit(int(self.leaf_no[node]))
            test = x[int(self.feature[node])] <= float(self.threshold[node])
            return F.when(test, at(int(self.left[node]))).otherwise(at(int(self.right[node])))

        return at(0)

    def predict(self, features: str = "features") -> Column:
        table = F.array(*[F.lit(int(c)) for c in self.predicted])
        return F.element_at(table, self.leaf_column(features) + 1)

    def class_index(self, cluster: str = "cluster") -> Column:
        return F.array_position(F.array(*[F.lit(int(c)) for c in self.classes]), F.col(cluster)) - 1

    def importance_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(v)) for n, v in zip(self.names, self.importances)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def rules_df(self, spark: SparkSession) -> DataFrame:
        """``conditions, predicted_class, samples, depth, rank``, most samples first."""
        rows = []
        for leaf, cls in zip(self.leaves, self.predicted):
            tests = [f"{self.names[f]} {'<=' if is_left else '>'} {t:.2f}" for f, t, is_left, _ in leaf.path]
            rows.append((" AND ".join(tests), f"Cluster {cls}", int(leaf.counts.sum()), len(tests)))
        rows.sort(key=lambda r: (-r[2], r[0]))
        return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "conditions string, predicted_class string, samples bigint, depth int, rank int")

    def shap_tables(self) -> list[tuple[list, np.ndarray]]:
        """Per leaf: the merged tests ``(feature, low, high)`` of its path, one for each distinct
        feature, and the share of training rows that each lets through."""
        out = []
        for leaf in self.leaves:
            merged: dict[int, list] = {}
            for f, t, is_left, node in leaf.path:
                low, high, share = merged.get(f, [-np.inf, np.inf, 1.0])
                child = self.left[node] if is_left else self.right[node]
                share *= self.cover[child] / max(self.cover[node], 1)
                merged[f] = [low, min(high, t), share] if is_left else [max(low, t), high, share]
            out.append(([(f, low, high) for f, (low, high, _) in merged.items()], np.array([m[2] for m in merged.values()])))
        return out


def leaf_shapley(passed: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the tests of one leaf (of value 1), for each row of ``passed`` tests.

    The game is a product: a known feature contributes whether it passes, an unknown one the share
    of rows its test lets through. The sum over all sets of known features of one size is a
    coefficient of the product of ``share + passed * z`` over the other features, so the work
    grows with the cube of the number of features, not with the number of their sets.
    """
    n, m = passed.shape
    size_weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    out = np.zeros((n, m))
    for i in range(m):
        sets = np.zeros((n, m))
        sets[:, 0] = 1.0
        for j in range(m):
            if j != i:
                sets = sets * share[j] + np.pad(sets[:, :-1], ((0, 0), (1, 0))) * passed[:, j, None]
        out[:, i] = sets @ size_weights * (passed[:, i] - share[i])
    return out


def shap_rows(tree: SurrogateTree, tables: list, x: np.ndarray, cls: np.ndarray | None) -> np.ndarray:
    """Shapley values: rows x features for one class per row, or x classes for all."""
    p = tree.probabilities
    out = np.zeros((len(x), len(tree.names)) if cls is not None else (len(x), len(tree.names), len(tree.classes)))
    for leaf, (tests, share) in enumerate(tables):
        if not tests or not len(x):
            continue
        passed = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high in tests], axis=1).astype(float)
        kinds, which = np.unique(passed, axis=0, return_inverse=True)  # few: rows pass alike
        phi = leaf_shapley(kinds, share)[which.reshape(-1)]
        for i, (f, _, _) in enumerate(tests):
            if cls is None:
                out[:, f, :] += phi[:, i, None] * p[leaf][None, :]
            else:
                out[:, f] += phi[:, i] * p[leaf][cls]
    return out


def shap_column(tree: SurrogateTree, features: str = "features", cluster: str = "cluster") -> Column:
    """``array<double>``: Shapley values of the row for its own cluster."""
    tables, width = tree.shap_tables(), len(tree.names)

    @F.arrow_udf("array<double>")
    def shap(v: pa.Array, c: pa.Array) -> pa.Array:
        phi = shap_rows(tree, tables, matrix(v, width), c.to_numpy().astype(int))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, width, dtype=np.int32)), pa.array(phi.ravel()))

    return shap(F.col(features), tree.class_index(cluster))


def _parse(debug: str) -> tuple[list, list, list, list]:
    """Nodes in preorder from the model's printed form."""
    lines = iter([line.strip() for line in debug.splitlines() if line.strip().startswith(("If", "Else", "Predict"))])
    feature, threshold, left, right = [], [], [], []

    def node() -> int:
        here, line = len(feature), next(lines)
        for column in (feature, threshold, left, right):
            column.append(-1)
        if not line.startswith("Predict"):
            found = SPLIT.match(line)
            feature[here], threshold[here] = int(found[1]), float(found[2])
            left[here] = node()
            next(lines)  # the Else of this split
            right[here] = node()
        return here

    node()
    return feature, threshold, left, right


def train_surrogate(
    df: DataFrame, names, max_depth: int = 5, max_bins: int = 256, seed: int = 42, classes: tuple[int, ...] | None = None
) -> SurrogateTree:
    """Fit a tree to ``features, cluster``; covers come from one grouped count."""
    if classes is None:
        classes = tuple(sorted(r.cluster for r in df.select("cluster").distinct().collect()))
    index = F.array_position(F.array(*[F.lit(int(c)) for c in classes]), F.col("cluster")) - 1
    data = df.select("features", index.cast("double").alias("label")).persist()
    learner = DecisionTreeClassifier(maxDepth=max_depth, maxBins=max_bins, seed=seed)
    model = learner.fit(data.select(array_to_vector("features").alias("features"), "label"))
    feature, threshold, left, right = (np.array(c) for c in _parse(model.toDebugString))
    leaf_no = np.full(len(feature), -1)
    leaf_no[feature < 0] = np.arange((feature < 0).sum())
    shape = SurrogateTree(tuple(names), classes, feature, threshold.astype(float), left, right, leaf_no, np.zeros(0), (), np.zeros(0), 0.0)
    counts = np.zeros((int((feature < 0).sum()), len(classes)))
    for r in data.groupBy(shape.leaf_column().alias("leaf"), "label").agg(F.count("*").alias("n")).collect():
        counts[r.leaf, int(r.label)] = r.n
    data.unpersist()
    cover, leaves = np.zeros(len(feature)), []

    def walk(node: int, path: tuple) -> float:
        if feature[node] < 0:
            leaves.append(Leaf(path, counts[leaf_no[node]]))
            cover[node] = counts[leaf_no[node]].sum()
        else:
            test = (int(feature[node]), float(threshold[node]))
            cover[node] = walk(left[node], (*path, (*test, True, node))) + walk(right[node], (*path, (*test, False, node)))
        return cover[node]

    walk(0, ())
    weights = np.zeros(len(names))
    for i, v in zip(model.featureImportances.indices, model.featureImportances.values):
        weights[i] = v
    fidelity = float(counts.max(1).sum() / counts.sum())
    return SurrogateTree(tuple(names), classes, feature, threshold.astype(float), left, right, leaf_no, cover, tuple(leaves), weights, fidelity)


def fidelity_band(df: DataFrame, predicted: str = "predicted", cluster: str = "cluster") -> DataFrame:
    """Share of rows whose prediction is their cluster, and how far to trust it."""
    share = df.agg(F.avg((F.col(predicted) == F.col(cluster)).cast("double")).alias("fidelity"))
    band = F.when(F.col("fidelity") >= RELIABLE, "reliable").when(F.col("fidelity") >= CAUTION, "caution").otherwise("low")
    return share.select("fidelity", band.alias("band"))


def rule_coverage(df: DataFrame, rules: dict[str, tuple[Column, int]], cluster: str = "cluster") -> DataFrame:
    """``rule, n, purity``: rows each rule covers and how many are of its class."""
    hits = F.array(*[F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(cls).alias("cls"))) for name, (test, cls) in rules.items()])
    rows = df.select(cluster, F.inline(F.filter(hits, lambda h: h.isNotNull())))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.avg((F.col(cluster) == F.col("cls")).cast("double")).alias("purity"))
