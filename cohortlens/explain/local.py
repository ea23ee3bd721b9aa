"""Explanations of single assignments, for a whole DataFrame of ids at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.blocks import matrix
from cohortlens.clustering.model import CentersModel, group_means
from cohortlens.explain.tree import SurrogateTree, shap_column, train_surrogate
from cohortlens.quantiles import group_quantiles
from cohortlens.runtime import small

METHODS = ("shap", "lime", "distance", "probabilistic")


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


# ------------------------------------------------------------------ Shapley values


def _folds(df: DataFrame, names, folds: int, seed: int, max_depth: int):
    """Per fold the rows to explain and a tree that has not seen them."""
    marked = df.withColumn("__fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds))).persist()
    classes = tuple(sorted(r.cluster for r in marked.select("cluster").distinct().collect()))
    for i in range(folds):
        tree = train_surrogate(marked.where(F.col("__fold") != i), names, max_depth, seed=seed, classes=classes)
        yield marked.where(F.col("__fold") == i).drop("__fold"), tree


def local_shap(df: DataFrame, names: Sequence[str], folds: int = 3, seed: int = 42, max_depth: int = 5) -> DataFrame:
    """``id, cluster, feature, value, shap, base_value, fidelity`` for the row's own cluster.

    Cross-fitted: a row is explained by the tree of the other folds, never by one it trained.
    """
    parts = []
    for rows, tree in _folds(df, names, folds, seed, max_depth):
        base = F.element_at(F.array(*[F.lit(float(b)) for b in tree.base_values]), (tree.class_index() + 1).cast("int"))
        zipped = F.arrays_zip("features", shap_column(tree).alias("shap"))
        long = rows.select("id", "cluster", base.alias("base_value"), F.lit(tree.fidelity).alias("fidelity"), F.posexplode(zipped).alias("pos", "z"))
        parts.append(long.select(
            "id", "cluster", _names(names)[F.col("pos")].alias("feature"), F.col("z.features").alias("value"),
            F.col("z.shap").alias("shap"), "base_value", "fidelity",
        ))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ local linear weights

# fixed values: samples per row, kernel width factor, ridge penalty, quantile grid per bin
LIME_SAMPLES, KERNEL, RIDGE, GRID = 5000, 0.75, 1.0, 64


def lime_bins(df: DataFrame, width: int) -> tuple[list, list, list]:
    """Quartile edges, bin frequencies and in-bin value tables of every coordinate."""
    long = df.select(F.posexplode("features").alias("pos", "value"))
    quart = {r.pos: r.q for r in group_quantiles(long, ["pos"], [0.25, 0.5, 0.75]).collect()}
    edges = [np.unique(quart[p]) for p in range(width)]
    cuts = F.array(*[F.array(*[F.lit(float(e)) for e in edges[p]]) for p in range(width)])
    bin_no = F.size(F.filter(cuts[F.col("pos")], lambda e: e < F.col("value")))
    stats = long.groupBy("pos", bin_no.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    ).collect()
    normal, freq, values = NormalDist(), [], []
    for p in range(width):
        share, table = np.zeros(len(edges[p]) + 1), np.zeros((len(edges[p]) + 1, GRID))
        for r in (r for r in stats if r.pos == p):
            share[r.bin] = r.n
            if r.s and r.hi > r.lo:  # normal with the bin's moments, cut to the bin
                a, b = normal.cdf((r.lo - r.m) / r.s), normal.cdf((r.hi - r.m) / r.s)
                u = np.clip(np.linspace(a, b, GRID), 1e-12, 1 - 1e-12)
                table[r.bin] = np.clip([r.m + r.s * normal.inv_cdf(float(v)) for v in u], r.lo, r.hi)
            else:
                table[r.bin] = r.m
        freq.append(np.cumsum(share / share.sum()))
        values.append(table)
    return edges, freq, values


def lime_weights(x: np.ndarray, cls: int, seed: int, tree: SurrogateTree, bins, n_samples: int) -> np.ndarray:
    """Ridge weights of "same quartile bin as the row" around one row."""
    edges, freq, values = bins
    d = len(x)
    rng = np.random.default_rng(seed)
    pick, inside = rng.random((n_samples, d)), rng.random((n_samples, d)) * (GRID - 1)
    z, sample = np.ones((n_samples, d)), np.tile(x, (n_samples, 1))
    for f in range(d):
        own = np.searchsorted(edges[f], x[f])
        drawn = np.minimum(np.searchsorted(freq[f], pick[1:, f], side="right"), len(freq[f]) - 1)
        low = inside[1:, f].astype(int)
        table = values[f][drawn]
        rows = np.arange(len(drawn))
        frac = inside[1:, f] - low
        z[1:, f] = drawn == own
        sample[1:, f] = table[rows, low] * (1 - frac) + table[rows, np.minimum(low + 1, GRID - 1)] * frac
    y = tree.probabilities[tree.leaf_rows(sample), cls]
    w = np.sqrt(np.exp(-(1 - z).sum(1) / (KERNEL**2 * d)))
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    return np.linalg.solve((zc * w[:, None]).T @ zc + RIDGE * np.eye(d), (zc * w[:, None]).T @ yc)


def lime_column(tree: SurrogateTree, bins, n_samples: int):
    """UDF of (features, class index, row seed)."""
    width = len(tree.names)

    @F.arrow_udf("array<double>")
    def weights(v: pa.Array, c: pa.Array, s: pa.Array) -> pa.Array:
        rows = zip(matrix(v, width), c.to_pylist(), s.to_pylist())
        out = np.array([lime_weights(x, int(k), abs(int(h)), tree, bins, n_samples) for x, k, h in rows]).reshape(-1, width)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))

    return weights


def local_lime(
    df: DataFrame, names: Sequence[str], folds: int = 3, seed: int = 42, max_depth: int = 5,
    n_samples: int = LIME_SAMPLES, rows_per_task: int = 2000,
) -> DataFrame:
    """``id, cluster, feature, value, lime, probability, fidelity``.

    A row's samples depend on its id and the seed only; they are drawn and reduced inside
    the task that holds the row, so nothing but the weights is shuffled or written.
    """
    width, parts = len(names), []
    parallel = df.sparkSession.sparkContext.defaultParallelism
    bins = lime_bins(df, width)
    for rows, tree in _folds(df, names, folds, seed, max_depth):
        # sampling is costly per row: small tasks, however few files the input has
        tasks = int(max(parallel, -(-rows.count() // rows_per_task)))
        spread = rows.repartition(tasks, "id")
        scored = spread.withColumn("w", lime_column(tree, bins, n_samples)("features", tree.class_index(), F.xxhash64("id", F.lit(seed))))
        table = F.array(*[F.array(*[F.lit(float(p)) for p in row]) for row in tree.probabilities])
        prob = F.element_at(table, tree.leaf_column() + 1)[tree.class_index().cast("int")]
        long = scored.select("id", "cluster", prob.alias("probability"), F.lit(tree.fidelity).alias("fidelity"), F.posexplode(F.arrays_zip("features", "w")).alias("pos", "z"))
        parts.append(long.select(
            "id", "cluster", _names(names)[F.col("pos")].alias("feature"), F.col("z.features").alias("value"),
            F.col("z.w").alias("lime"), "probability", "fidelity",
        ))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ distance and membership


def centers_of(df: DataFrame, model=None) -> DataFrame:
    """``cluster, center``: the model's own centers, or the mean of the members."""
    if isinstance(model, CentersModel):
        return model.centers_df(df.sparkSession)
    means = getattr(model, "means", None)
    if means is not None:
        return CentersModel(tuple(range(len(means))), means).centers_df(df.sparkSession)
    return group_means(df.where("cluster >= 0")).select("cluster", "center")


def local_distance(df: DataFrame, names: Sequence[str], model=None) -> DataFrame:
    """``id, cluster, feature, value, center_value, distance, contribution, total_distance,
    rank``: how each feature adds to the distance from the own center.

    Ranking happens inside the row's array, so the long table needs no shuffle.
    """
    joined = df.select("id", "cluster", "features").join(small(centers_of(df, model), len(names)), "cluster")
    gap = F.zip_with("features", "center", lambda a, b: F.abs(a - b))
    joined = joined.withColumn("gap", gap)
    total = F.aggregate("gap", F.lit(0.0), lambda s, g: s + g)
    joined = joined.withColumn("all", total + 1e-10).withColumn("far", F.sqrt(F.aggregate("gap", F.lit(0.0), lambda s, g: s + g * g)))
    order = F.array_sort(F.transform("gap", lambda g, i: F.struct((-g).alias("g"), i.alias("i"))))
    long = joined.select("id", "cluster", "features", "center", "all", "far", F.posexplode(order).alias("r", "o"))
    i = F.col("o.i")
    return long.select(
        "id", "cluster", _names(names)[i].alias("feature"), F.col("features")[i].alias("value"), F.col("center")[i].alias("center_value"),
        (-F.col("o.g")).alias("distance"), (-F.col("o.g") / F.col("all")).alias("contribution"), F.col("far").alias("total_distance"),
        (F.col("r") + 1).alias("rank"),
    )


def local_membership(df: DataFrame, model=None) -> DataFrame:
    """``id, cluster, center_cluster, probability, distance, certainty``.

    A mixture gives its posterior; every other method is certain of the assigned cluster.
    """
    centers = CentersModel.from_frame(centers_of(df, model))
    rows = model.posterior(df) if hasattr(model, "posterior") and not isinstance(model, CentersModel) else centers.posterior(df)
    rows = rows.withColumn("far", centers.distances())
    labels = F.array(*[F.lit(c) for c in centers.labels])
    own = F.col("probability")[(F.array_position(labels, F.col("cluster")) - 1).cast("int")]
    long = rows.select("id", "cluster", own.alias("certainty"), F.posexplode(F.arrays_zip("probability", "far")).alias("p", "z"))
    return long.select(
        "id", "cluster", labels[F.col("p")].alias("center_cluster"), F.col("z.probability").alias("probability"), F.col("z.far").alias("distance"), "certainty"
    )


def explain_all(df: DataFrame, names: Sequence[str], methods: Sequence[str] = METHODS, model=None, **options) -> DataFrame:
    """``method, id, cluster, item, value, score, error``: several explanations as one table.

    A method that fails becomes one row with its error; the others go on.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    spark, parts = df.sparkSession, []
    schema = "method string, id bigint, cluster int, item string, value double, score double, error string"
    for name in methods:
        try:
            if name == "shap":
                one = local_shap(df, names).select("id", "cluster", F.col("feature").alias("item"), "value", F.col("shap").alias("score"))
            elif name == "lime":
                one = local_lime(df, names, **options.get("lime", {})).select("id", "cluster", F.col("feature").alias("item"), "value", F.col("lime").alias("score"))
            elif name == "distance":
                one = local_distance(df, names, model).select("id", "cluster", F.col("feature").alias("item"), "value", F.col("contribution").alias("score"))
            else:
                one = local_membership(df, model).select(
                    "id", "cluster", F.col("center_cluster").cast("string").alias("item"), F.col("distance").alias("value"), F.col("probability").alias("score"))
            one.limit(1).count()  # surface lazy failures here
            parts.append(one.select(F.lit(name).alias("method"), "*", F.lit(None).cast("string").alias("error")))
        except Exception as exc:
            parts.append(spark.createDataFrame([(name, None, None, None, None, None, f"{type(exc).__name__}: {exc}"[:500])], schema))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ report tables


def top_contributions(long: DataFrame, score: str, n: int = 10) -> DataFrame:
    """The n largest absolute scores per row, with direction and share of the row's total."""
    w = Window.partitionBy("id")
    ranked = long.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs(score)), "feature")))
    share = F.abs(score) / F.nullif(F.sum(F.abs(score)).over(w), F.lit(0.0)) * 100
    ranked = ranked.withColumn("share_pct", F.coalesce(share, F.lit(0.0)))
    return ranked.where(F.col("rank") <= n).withColumn("direction", F.when(F.col(score) > 0, "Positive").otherwise("Negative"))


def extremes(long: DataFrame, score: str) -> DataFrame:
    """``id, strongest_positive, strongest_negative, total_impact``; NULL where there is none."""
    v = F.col(score)
    per = long.groupBy("id").agg(
        F.min(F.when(v > 0, F.struct((-v).alias("s"), "feature"))).alias("p"),
        F.min(F.when(v < 0, F.struct(v.alias("s"), "feature"))).alias("n"),
        F.sum(F.abs(v)).alias("total_impact"),
    )
    return per.select("id", F.col("p.feature").alias("strongest_positive"), F.col("n.feature").alias("strongest_negative"), "total_impact")
