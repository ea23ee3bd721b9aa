"""Gaussian mixtures: any covariance form, and k chosen by BIC."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.blocks import matrices, matrix, packed
from cohortlens.clustering.partition import SAMPLE_ROWS, hashed_sample, kmeans_many
from cohortlens.runtime import shape

FORMS = ("full", "tied", "diag", "spherical")
REG = 1e-6


@dataclass(frozen=True)
class MixtureModel:
    """``covs`` is k x d x d for full, d x d for tied, k x d for diag, k for spherical."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    form: str = "full"

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def labels(self) -> tuple[int, ...]:
        return tuple(range(self.k))

    @property
    def centers(self) -> np.ndarray:
        return self.means

    def nearest(self, features: Column | str = "features") -> Column:
        """Label of the most probable component."""
        p = self.probability(features)
        return (F.array_position(p, F.array_max(p)) - 1).cast("int")

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of every row and component."""
        d = x.shape[1]
        out = np.empty((len(x), self.k))
        for c in range(self.k):
            diff = x - self.means[c]
            if self.form in ("full", "tied"):
                low = np.linalg.cholesky(self.covs[c] if self.form == "full" else self.covs)
                # one product: a threaded solve of many right sides can take the driver minutes
                scaled = np.linalg.inv(low) @ diff.T
                quad, logdet = (scaled**2).sum(0), 2 * np.log(np.diag(low)).sum()
            else:
                var = np.broadcast_to(self.covs[c], (d,))
                quad, logdet = (diff**2 / var).sum(1), np.log(var).sum()
            out[:, c] = math.log(self.weights[c]) - 0.5 * (d * math.log(2 * math.pi) + logdet + quad)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logp = self.log_densities(x)
        top = logp.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logp - top).sum(1))
        return np.exp(logp - norm[:, None]), norm

    def probability(self, features: Column | str = "features") -> Column:
        model = self

        @F.arrow_udf("array<double>")
        def posterior(v: pa.Array) -> pa.Array:
            p, _ = model.responsibilities(matrix(v, model.means.shape[1]))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, model.k, dtype=np.int32)), pa.array(p.ravel()))

        return posterior(features)

    def posterior(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", self.probability())

    def assign(self, df: DataFrame) -> DataFrame:
        p = self.posterior(df)
        return p.withColumn("cluster", (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))

    def log_likelihood(self, df: DataFrame) -> tuple[float, int]:
        """Total log-likelihood and number of rows."""
        model = self

        @F.arrow_udf("double")
        def loglik(v: pa.Array) -> pa.Array:
            return pa.array(model.responsibilities(matrix(v, model.means.shape[1]))[1])

        row = df.agg(F.sum(loglik("features")).alias("ll"), F.count("*").alias("n")).first()
        return float(row.ll), int(row.n)

    def n_parameters(self) -> int:
        k, d = self.means.shape
        shape = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.form]
        return k - 1 + k * d + shape

    def bic(self, df: DataFrame) -> float:
        return bic_of(self, *self.log_likelihood(df))

    def components_df(self, spark: SparkSession) -> DataFrame:
        """``cluster, weight, mean, covariance`` with the covariance flattened."""
        rows = [
            (c, float(self.weights[c]), self.means[c].tolist(), np.ravel(self.covs if self.form == "tied" else self.covs[c]).tolist())
            for c in range(self.k)
        ]
        return spark.createDataFrame(rows, "cluster int, weight double, mean array<double>, covariance array<double>")


def bic_of(model: MixtureModel, ll: float, n: int) -> float:
    return -2.0 * ll + model.n_parameters() * math.log(n)


def _start(centers: np.ndarray, spread: np.ndarray, form: str) -> MixtureModel:
    k = len(centers)
    first = {
        "full": np.tile(np.diag(spread), (k, 1, 1)), "tied": np.diag(spread), "diag": np.tile(spread, (k, 1)), "spherical": np.full(k, spread.mean()),
    }[form]
    return MixtureModel(np.full(k, 1.0 / k), centers, first, form)


def _stats(x: np.ndarray, model: MixtureModel) -> np.ndarray:
    """E-step of some rows: per component the weight, the log-likelihood, the vector sum
    and the second moment (outer products for full and tied, squares otherwise)."""
    r, norm = model.responsibilities(x)
    if model.form in ("full", "tied"):
        s2 = np.stack([((x * r[:, c, None]).T @ x).ravel() for c in range(model.k)])
    else:
        s2 = r.T @ (x * x)
    return np.column_stack([r.sum(0), np.full(model.k, norm.sum()), r.T @ x, s2])


def e_pass(df: DataFrame, models: list[MixtureModel]) -> list[np.ndarray]:
    """:func:`_stats` of all rows for all models in one pass; tasks reduce before the shuffle."""
    d = models[0].means.shape[1]
    columns = 2 + d + (d * d if models[0].form in ("full", "tied") else d)

    def reduce_rows(batches):
        acc, seen = [0.0] * len(models), False
        for x in matrices(batches, d):
            seen = seen or len(x) > 0
            acc = [a + _stats(x, m) for a, m in zip(acc, models)]
        if seen:
            for i, full in enumerate(acc):
                c, p = np.indices(full.shape).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"m": np.full(full.size, i, np.int32), "c": c.astype(np.int32), "p": p.astype(np.int32), "v": full.ravel()})

    parts = (df if df.columns == ["block"] else df.select("features")).mapInArrow(reduce_rows, "m int, c int, p int, v double")
    full = [np.zeros((m.k, columns)) for m in models]
    for row in parts.groupBy("m", "c", "p").agg(F.sum("v").alias("v")).collect():
        full[row.m][row.c, row.p] = row.v
    return full


def _m_step(full: np.ndarray, d: int, form: str) -> MixtureModel:
    n, s1, s2 = full[:, 0] + 10 * np.finfo(float).eps, full[:, 2 : 2 + d], full[:, 2 + d :]
    if form in ("full", "tied"):
        s2 = s2.reshape(-1, d, d)
    means = s1 / n[:, None]
    if form == "full":
        covs = s2 / n[:, None, None] - means[:, :, None] * means[:, None, :] + REG * np.eye(d)
    elif form == "tied":
        covs = (s2.sum(0) - (means.T * n) @ means) / n.sum() + REG * np.eye(d)
    else:
        covs = np.maximum(s2 / n[:, None] - means**2, 0.0) + REG
        covs = covs if form == "diag" else covs.mean(1)
    return MixtureModel(n / n.sum(), means, covs, form)


def em_round(df: DataFrame, model: MixtureModel) -> MixtureModel:
    """One round of expectation and maximisation over all rows."""
    return _m_step(e_pass(df, [model])[0], model.means.shape[1], model.form)


def mixtures_many(
    df: DataFrame, ks, form: str = "full", seed: int = 42, max_iter: int = 100, tol: float = 1e-3
) -> dict[int, tuple[MixtureModel, float, int]]:
    """``k -> (model, log-likelihood, rows)`` for several k, all sharing each pass.

    Starts at K-Means centers; a model is done when the mean log-likelihood per row changes
    by less than ``tol``.
    """
    if form not in FORMS:
        raise ValueError(f"unknown covariance form {form}")
    ks = [int(k) for k in ks]
    # second moments lose their digits far from zero, so all work is about the mean
    means = df.select(F.posexplode("features").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m")).collect()
    middle = np.array([r.m for r in sorted(means, key=lambda r: r.p)], float)
    about = F.array(*[F.lit(float(v)) for v in middle])
    data = df.select("id", F.zip_with("features", about, lambda v, m: v - m).alias("features")).persist()
    rows, d = shape(data)
    begin = kmeans_many(data, ks, seed, n_init=1)
    sample = hashed_sample(data, max(SAMPLE_ROWS, 20 * max(ks)), seed, rows)
    models = {k: _settle(_start(begin[k].centers, sample.var(0) + REG, form), sample, max_iter, tol) for k in ks}
    blocks = packed(data).persist()
    loglik, live = {k: -math.inf for k in ks}, list(ks)
    for _ in range(max_iter):
        for k, full in zip(list(live), e_pass(blocks, [models[k] for k in live])):
            models[k] = _m_step(full, d, form)
            if abs(full[0, 1] - loglik[k]) < tol * rows:
                live.remove(k)
            loglik[k] = full[0, 1]
        if not live:
            break
    final = e_pass(blocks, [models[k] for k in ks])
    blocks.unpersist()
    data.unpersist()
    moved = {k: replace(models[k], means=models[k].means + middle) for k in ks}
    return {k: (moved[k], float(f[0, 1]), rows) for k, f in zip(ks, final)}


def _settle(model: MixtureModel, sample: np.ndarray, max_iter: int, tol: float) -> MixtureModel:
    """Rounds on the bounded sample, so that few passes over all rows are left."""
    before = -math.inf
    for _ in range(max_iter):
        full = _stats(sample, model)
        model = _m_step(full, sample.shape[1], model.form)
        if abs(full[0, 1] - before) < tol * len(sample):
            break
        before = full[0, 1]
    return model


def mixture_fit(df: DataFrame, k: int = 3, form: str = "full", seed: int = 42, max_iter: int = 100, tol: float = 1e-3) -> MixtureModel:
    return mixtures_many(df, [k], form, seed, max_iter, tol)[k][0]


def mixture_auto(df: DataFrame, max_k: int = 10, form: str = "full", seed: int = 42) -> tuple[MixtureModel, dict[int, float]]:
    """Smallest BIC over k = 2..max_k, with all BICs."""
    fits = mixtures_many(df, range(2, max_k + 1), form, seed)
    bics = {k: bic_of(m, ll, n) for k, (m, ll, n) in fits.items()}
    return fits[min(bics, key=lambda k: (bics[k], k))][0], bics
