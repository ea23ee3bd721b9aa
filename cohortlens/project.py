"""Projection to a few dimensions by principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.blocks import matrix
from cohortlens.clustering.model import CentersModel
from cohortlens.runtime import dim


def covariance_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, cov`` (sample covariance, upper triangle with diagonal)."""
    _, cov = _moments(df, len(names))
    rows = [(names[i], names[j], float(cov[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, cov double")


def _moments(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance in one pass; tasks reduce to d x d numbers each.

    Tasks report count, mean and centered products, which merge without cancellation.
    """

    def reduce_rows(batches):
        n, mean, m2 = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("features"), width)
            if not len(x):
                continue
            own = x.mean(0)
            delta, total = own - mean, n + len(x)
            m2 += (x - own).T @ (x - own) + np.outer(delta, delta) * n * len(x) / total
            mean, n = mean + delta * len(x) / total, total
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})

    parts = df.select("features").mapInArrow(reduce_rows, "n bigint, mean array<double>, m2 array<double>")
    long = parts.select("n", F.posexplode("mean").alias("i", "v"))
    first = {r.i: (r.s, r.n) for r in long.groupBy("i").agg(F.sum(F.col("n") * F.col("v")).alias("s"), F.sum("n").alias("n")).collect()}
    total = first[0][1]
    mean = np.array([first[i][0] for i in range(width)]) / total
    center = F.array(*[F.lit(float(v)) for v in mean])
    i, j = (F.col("k") / width).cast("int"), F.col("k") % width
    shifted = F.col("v") + F.col("n") * (F.col("mean")[i] - center[i]) * (F.col("mean")[j] - center[j])
    cells = parts.select("n", "mean", F.posexplode("m2").alias("k", "v")).groupBy("k").agg(F.sum(shifted).alias("c")).collect()
    cov = np.zeros(width * width)
    for r in cells:
        cov[r.k] = r.c
    return mean, cov.reshape(width, width) / (total - 1)


@dataclass(frozen=True)
class PcaModel:
    mean: np.ndarray
    components: np.ndarray  # n_components x d, sign fixed by the largest loading
    explained_variance_ratio: np.ndarray

    def project(self, features: Column | str = "features") -> Column:
        model = self

        @F.arrow_udf("array<double>")
        def run(v: pa.Array) -> pa.Array:
            out = (matrix(v, len(model.mean)) - model.mean) @ model.components.T
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))

        return run(features)

    def transform(self, df: DataFrame) -> DataFrame:
        """``pc1 .. pcn`` next to the row's other columns."""
        p = df.withColumn("__p", self.project())
        return p.select(*[c for c in df.columns if c != "features"], *[F.col("__p")[i].alias(f"pc{i + 1}") for i in range(len(self.components))])

    def loadings_df(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """``component, explained_variance_ratio, feature, loading``."""
        rows = [
            (i + 1, float(r), n, float(v))
            for i, (c, r) in enumerate(zip(self.components, self.explained_variance_ratio)) for n, v in zip(names, c)
        ]
        return spark.createDataFrame(rows, "component int, explained_variance_ratio double, feature string, loading double")


def pca_fit(df: DataFrame, n_components: int = 2) -> PcaModel:
    """The rows are read in one distributed pass; the d x d eigenproblem is solved locally."""
    width = dim(df)
    mean, cov = _moments(df, width)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:n_components]
    axes = vectors[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return PcaModel(mean, axes, values[order] / values.sum())


def reduce_dimensions(df: DataFrame, method: str = "pca", n_components: int = 2) -> tuple[PcaModel, DataFrame]:
    if method.lower() != "pca":
        raise ValueError(f"unknown method {method}")
    model = pca_fit(df, n_components)
    return model, model.transform(df)


def scatter_points(df: DataFrame, model: PcaModel, centers: CentersModel | None = None) -> DataFrame:
    """``kind, id, cluster, pc1, pc2``: the projected rows and cluster centers."""
    points = model.transform(df.select("id", "cluster", "features")).select(F.lit("point").alias("kind"), "id", "cluster", "pc1", "pc2")
    if centers is None:
        mid = points.where("cluster >= 0").groupBy("cluster").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
    else:
        mid = model.transform(centers.centers_df(df.sparkSession).withColumnRenamed("center", "features"))
    mid = mid.select(F.lit("center").alias("kind"), F.lit(None).cast("bigint").alias("id"), "cluster", "pc1", "pc2")
    return points.unionByName(mid)
