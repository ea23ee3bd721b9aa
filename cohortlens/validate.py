"""Scores of labelings, for any number of labelings in one pass.

``features`` is ``id, features array<double>``; ``labels`` is ``id, method, cluster`` with
one row per labeling. Noise (-1) never counts towards an internal score. A labeling with
fewer than two clusters scores NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.blocks import (
    BLOCK_ROWS, BROADCAST_BYTES, fits_broadcast, matrix, n_blocks,
)
from cohortlens.clustering.model import group_means
from cohortlens.runtime import shape, small, spread


def one_method(df: DataFrame, method: str = "labels") -> DataFrame:
    return df.select("id", F.lit(method).alias("method"), "cluster")


def _marked(features: DataFrame, labels: DataFrame, include_noise: bool = False) -> DataFrame:
    """``id, features, marks array<struct<method, cluster>>``: features are shuffled once
    however many labelings there are."""
    kept = labels if include_noise else labels.where("cluster >= 0")
    marks = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("method", "cluster"))).alias("marks"))
    return features.select("id", "features").join(marks, "id")


def _slots(labels: DataFrame, include_noise: bool = False) -> list:
    """(method, cluster, n) in order: the clusters of all labelings."""
    kept = labels if include_noise else labels.where("cluster >= 0")
    rows = kept.groupBy("method", "cluster").agg(F.count("*").alias("n")).collect()
    return sorted((r.method, r.cluster, r.n) for r in rows)


def _slot_index(marks: pa.Array, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot number of every mark of a batch."""
    if isinstance(marks, pa.ChunkedArray):
        marks = marks.combine_chunks()
    flat = marks.flatten()
    row = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy())
    pairs = zip(flat.field("method").to_pylist(), flat.field("cluster").to_pylist())
    return row, np.array([index[p] for p in pairs], int)


def _one_hot(marks, index) -> np.ndarray:
    row, slot = _slot_index(marks, index)
    hot = np.zeros((len(marks), len(index)))
    hot[row, slot] = 1.0
    return hot


#: Rows and columns of a table of distances that is summed at once.
SUM_TILE = (128, 1024)


def _runs(hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of the same slots stand together, and the first place of each run."""
    _, kind = np.unique(np.packbits(hot > 0, axis=1), axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0]) if len(kind) else np.empty(0, int)


def _slot_sums(x: np.ndarray, y: np.ndarray, hot_y: np.ndarray, hot_x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For every row of ``x`` its summed distance to the rows of ``y`` in every slot; with ``hot_x`` also
    the other way round. Distances to rows of the same slots are added up before slots are looked at."""
    n_slots = hot_y.shape[1]
    out_x, out_y = np.zeros((len(x), n_slots)), None if hot_x is None else np.zeros((len(y), n_slots))
    if not len(x) or not len(y):
        return out_x, out_y
    at_y, run_y = _runs(hot_y)
    at_x, run_x = (np.arange(len(x)), None) if hot_x is None else _runs(hot_x)
    middle = y.mean(0)
    a, b, hot_y = x[at_x] - middle, y[at_y] - middle, hot_y[at_y]
    left = np.column_stack([-2.0 * a, (a * a).sum(1), np.ones(len(a))])
    right = np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T.copy()
    sums_x, sums_y = np.zeros((len(x), n_slots)), None if hot_x is None else np.zeros((n_slots, len(y)))
    hot_x = None if hot_x is None else hot_x[at_x]

    room = np.empty(SUM_TILE[0] * SUM_TILE[1])

    def starts(run, begin, end):
        return np.r_[begin, run[np.searchsorted(run, begin, "right") : np.searchsorted(run, end)]]

    tiles = [(s, min(len(y), s + SUM_TILE[1])) for s in range(0, len(y), SUM_TILE[1])]
    tiles = [(s, e, starts(run_y, s, e)) for s, e in tiles]
    for top in range(0, len(x), SUM_TILE[0]):
        end = min(len(x), top + SUM_TILE[0])
        heads = None if hot_x is None else starts(run_x, top, end)
        for s, e, cols in tiles:
            d = np.matmul(left[top:end], right[:, s:e], out=room[: (end - top) * (e - s)].reshape(end - top, e - s))
            np.maximum(d, 0.0, out=d)
            np.sqrt(d, out=d)
            if len(cols) * 8 <= e - s:
                sums_x[top:end] += np.add.reduceat(d, cols - s, axis=1) @ hot_y[cols]
            else:
                sums_x[top:end] += d @ hot_y[s:e]
            if heads is None:
                continue
            if len(heads) * 8 <= end - top:
                each = np.stack([d[i:j].sum(0) for i, j in zip(heads - top, np.r_[heads[1:], end] - top)])
                sums_y[:, s:e] += hot_x[heads].T @ each
            else:
                sums_y[:, s:e] += hot_x[top:end].T @ d
    out_x[at_x] = sums_x
    if out_y is not None:
        out_y[at_y] = sums_y.T
    return out_x, out_y


def _distance_sums(points: DataFrame, slots: list, broadcast_bytes: int, block_rows: int) -> DataFrame:
    """Adds ``sums``: summed Euclidean distance of the row to the members of every slot."""
    index = {(m, c): i for i, (m, c, _) in enumerate(slots)}
    n_slots, (n_rows, width) = len(slots), shape(points)
    if fits_broadcast(n_rows, width + n_slots, broadcast_bytes):
        table = points.select("features", "marks").toArrow()
        shared = points.sparkSession.sparkContext.broadcast((matrix(table["features"], width), _one_hot(table["marks"], index)))

        @F.arrow_udf("array<double>")
        def sums(v: pa.Array) -> pa.Array:
            x, (y, hot) = matrix(v, width), shared.value
            flat = _slot_sums(x, y, hot)[0].ravel()
            return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n_slots, dtype=np.int32)), pa.array(flat))

        return spread(points).withColumn("sums", sums("features"))

    # a distance counts for both of its rows, so each pair of blocks meets once: block b goes to
    # the pairs (lo, hi) in which it is either; in (b, b) it is its own opposite
    rows = points.select(F.col("id").cast("bigint").alias("id"), "features", "marks")
    blocks = n_blocks(n_rows, block_rows, width + n_slots)
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = rows.withColumn("b", own).withColumn("o", F.explode(every))
    dealt = dealt.select("id", "features", "marks", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def reduced(key, table):
        x, hot = matrix(table["features"], width), _one_hot(table["marks"], index)
        first = table["b"].to_numpy() == key[0].as_py()
        if key[0] == key[1]:
            total, _ = _slot_sums(x, x, hot)
        else:
            total = np.zeros((len(x), n_slots))
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            total[a], total[b] = _slot_sums(x[a], x[b], hot[b], hot[a])
        cols = [pa.array(c) for c in np.ascontiguousarray(total.T)]
        return pa.table([table["id"].combine_chunks(), *cols], names=["id", *names])

    names = [f"s{i}" for i in range(n_slots)]
    schema = "id bigint, " + ", ".join(f"{c} double" for c in names)
    parts = dealt.groupBy("lo", "hi").applyInArrow(reduced, schema)
    full = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
    return points.join(full.select("id", F.array(*names).alias("sums")), "id")


def _squared_sums(points: DataFrame, slots: list) -> DataFrame:
    """As above for squared distances, from each slot's count, vector sum and norm sum."""
    members = points.select("features", F.inline("marks"))
    means = {(r.method, r.cluster): r.center for r in group_means(members, ("method", "cluster")).collect()}
    y = np.array([means[m, c] for m, c, _ in slots], float)
    n = np.array([s[2] for s in slots], float)
    middle = y.mean(0)  # sums of squares are taken about it, so that large offsets cost no digits
    y = y - middle
    about = F.array(*[F.lit(float(v)) for v in middle])
    norm = F.aggregate(F.zip_with("features", about, lambda v, m: (v - m) * (v - m)), F.lit(0.0), lambda s, v: s + v)
    norms = {(r.method, r.cluster): r.t for r in members.groupBy("method", "cluster").agg(F.sum(norm).alias("t")).collect()}
    psi = np.array([norms[m, c] for m, c, _ in slots], float)
    width = y.shape[1]

    @F.arrow_udf("array<double>")
    def sums(v: pa.Array) -> pa.Array:
        x = matrix(v, width) - middle
        total = np.maximum((x * x).sum(1)[:, None] * n - 2.0 * (x @ y.T) * n + psi, 0.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, len(n), dtype=np.int32)), pa.array(total.ravel()))

    return points.withColumn("sums", sums("features"))


def silhouette_points(
    features: DataFrame,
    labels: DataFrame,
    form: str = "euclidean",
    include_noise: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, method, cluster, silhouette`` of every row.

    ``euclidean`` needs every pairwise distance, so its work is quadratic in the rows (in
    balanced blocks); ``squared`` is the linear-time form for very large tables.
    """
    slots = _slots(labels, include_noise)
    points = _marked(features, labels, include_noise)
    if not slots:
        return points.select("id", F.inline("marks")).withColumn("silhouette", F.lit(None).cast("double"))
    if form == "euclidean":
        summed = _distance_sums(points, slots, broadcast_bytes, block_rows)
    elif form == "squared":
        summed = _squared_sums(points, slots)
    else:
        raise ValueError(f"unknown silhouette form {form}")
    known = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(c).alias("c"), F.lit(float(n)).alias("n"), F.lit(i).alias("i"))
        for i, (m, c, n) in enumerate(slots)
    ])
    rows = summed.select("id", "sums", F.inline("marks"))
    mine = F.filter(known, lambda s: (s["m"] == F.col("method")) & (s["c"] == F.col("cluster")))[0]
    others = F.filter(known, lambda s: (s["m"] == F.col("method")) & (s["c"] != F.col("cluster")))
    rows = rows.withColumn("own", mine).withColumn("b", F.array_min(F.transform(others, lambda s: F.col("sums")[s["i"]] / s["n"])))
    a = F.col("sums")[F.col("own.i")] / F.nullif(F.col("own.n") - 1, F.lit(0.0))
    rows = rows.withColumn("a", a)
    top = F.greatest("a", "b")
    score = F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return rows.select("id", "method", "cluster", score.alias("silhouette")).where("cluster >= 0")


def silhouette(features: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return silhouette_points(features, labels, **how).groupBy("method").agg(F.avg("silhouette").alias("silhouette"))


def silhouette_per_cluster(features: DataFrame, labels: DataFrame, **how) -> DataFrame:
    points = silhouette_points(features, labels, **how)
    return points.groupBy("method", "cluster").agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def center_distance(a: str = "features", b: str = "center") -> Column:
    """Row-wise Euclidean distance of two vector columns."""

    @F.arrow_udf("double")
    def far(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        width = len(x[0])
        return pa.array(np.sqrt(((matrix(x, width) - matrix(y, width)) ** 2).sum(1)))

    return far(a, b)


def dispersion(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``method, cluster, n, center, spread, inertia``: mean and summed squared distance to
    the own center."""
    members = _marked(features, labels).select("id", "features", F.inline("marks"))
    centers = small(group_means(members, ("method", "cluster")), shape(features)[1])
    far = members.join(centers, ["method", "cluster"]).select("method", "cluster", center_distance().alias("d"))
    sums = far.groupBy("method", "cluster").agg(F.avg("d").alias("spread"), F.sum(F.col("d") * F.col("d")).alias("inertia"))
    return centers.join(sums, ["method", "cluster"])


def _sq(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def davies_bouldin(spread: DataFrame) -> DataFrame:
    """From :func:`dispersion`; pairs of the k centers only."""
    other = spread.select("method", *[F.col(c).alias(f"o_{c}") for c in ("cluster", "center", "spread")])
    pairs = spread.join(other, "method").where("cluster <> o_cluster")
    gap = F.sqrt(_sq("center", "o_center"))
    ratio = F.when(gap > 0, (F.col("spread") + F.col("o_spread")) / gap).otherwise(0.0)
    worst = pairs.groupBy("method", "cluster").agg(F.max(ratio).alias("r"))
    return worst.groupBy("method").agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(spread: DataFrame) -> DataFrame:
    """From :func:`dispersion`: the global center is the weighted mean of the centers."""
    long = spread.select("method", "n", "inertia", "cluster", F.posexplode("center").alias("pos", "v"))
    column = Window.partitionBy("method", "pos")  # as many rows as clusters
    low = F.min("v").over(column)
    long = long.withColumn("v", F.col("v") - low)  # small numbers: their mean keeps its digits
    middle = F.sum(F.col("n") * F.col("v")).over(column) / F.sum("n").over(column)
    long = long.withColumn("off", F.col("v") - middle)
    between = long.groupBy("method").agg(F.sum(F.col("n") * F.col("off") * F.col("off")).alias("between"))
    within = spread.groupBy("method").agg(F.sum("inertia").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    score = F.when(F.col("within") == 0, 1.0).otherwise(
        (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    )
    return within.join(between, "method").where("k >= 2").select("method", score.alias("calinski_harabasz"))


def contingency(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """``method, t, p, n``; ``truth`` is ``id, truth``."""
    both = labels.join(truth.select("id", "truth"), "id")
    return both.groupBy("method", F.col("truth").alias("t"), F.col("cluster").alias("p")).agg(F.count("*").alias("n"))


def external_scores(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information per method."""
    table = contingency(labels, truth)
    choose = lambda c: c * (c - 1) / 2
    cells = table.withColumn("a", F.sum("n").over(Window.partitionBy("method", "t"))).withColumn(
        "b", F.sum("n").over(Window.partitionBy("method", "p"))
    ).withColumn("all", F.sum("n").over(Window.partitionBy("method")).cast("double"))
    n, a, b, total = F.col("n"), F.col("a"), F.col("b"), F.col("all")
    # a marginal appears once per cell of its row: dividing by the cells' share undoes that
    sums = cells.groupBy("method").agg(
        F.first("all").alias("all"), F.sum(choose(n)).alias("sij"),
        F.sum(choose(a) * n / a).alias("sa"), F.sum(choose(b) * n / b).alias("sb"),
        F.sum(n / total * F.log(n * total / (a * b))).alias("mi"),
        F.sum(-n / total * F.log(a / total)).alias("ht"), F.sum(-n / total * F.log(b / total)).alias("hp"),
    )
    expected = F.col("sa") * F.col("sb") / choose(F.col("all"))
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise((F.col("sij") - expected) / (top - expected))
    half = (F.col("ht") + F.col("hp")) / 2
    nmi = F.when(half < 1e-12, 1.0).otherwise(F.col("mi") / half)
    return sums.select("method", ari.alias("ari"), nmi.alias("nmi"))


def confusion_matrix(labels: DataFrame, truth: DataFrame, names: dict | None = None) -> DataFrame:
    """One row per true label, one column ``pred_<label>`` per label of either side.

    With more than one method in ``labels`` there is a matrix for each, told apart by the column
    ``method``. ``names`` gives labels other names, in rows and columns.
    """
    table = contingency(labels, truth).persist()
    seen = table.select(F.col("t").alias("l")).union(table.select("p")).distinct()
    values = sorted(r.l for r in seen.collect())
    methods = table.select("method").distinct()
    wide = table.groupBy("method", F.col("t").alias("truth")).pivot("p", values).agg(F.sum("n"))
    # every label of either side is a row of every matrix
    rows = methods.select("method", F.explode(F.array(*[F.lit(v) for v in values])).alias("truth"))
    full = rows.join(wide, ["method", "truth"], "left").fillna(0)
    called = {v: (names or {}).get(v, v) for v in values}
    shown = F.col("truth")
    if names:
        shown = F.coalesce(*[F.when(F.col("truth") == v, F.lit(str(n))) for v, n in called.items()])
    columns = [F.col(str(v)).cast("bigint").alias(f"pred_{called[v]}") for v in values]
    return full.select(*(["method"] if methods.count() > 1 else []), shown.alias("truth"), *columns)


def compare_methods(features: DataFrame, labels: DataFrame, truth: DataFrame | None = None, **how) -> DataFrame:
    """All scores of all methods, with the number of clusters and of noise rows."""
    spread = dispersion(features, labels).persist()
    counts = labels.groupBy("method").agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
        F.sum((F.col("cluster") == -1).cast("bigint")).alias("noise_points"),
    )
    out = counts.join(silhouette(features, labels, **how), "method", "left")
    out = out.join(davies_bouldin(spread), "method", "left").join(calinski_harabasz(spread), "method", "left")
    cols = ["method", "silhouette", "davies_bouldin", "calinski_harabasz"]
    if truth is not None:
        out = out.join(external_scores(labels, truth), "method", "left")
        cols += ["ari", "nmi"]
    return out.select(*cols, "n_clusters", "noise_points")


def best_methods(scores: DataFrame) -> DataFrame:
    """``metric, method``: the best method per metric; ties go to the first name."""
    picks = [("silhouette", -1), ("davies_bouldin", 1), ("calinski_harabasz", -1)]
    row = scores.agg(*[
        F.min(F.when(F.col(m).isNotNull(), F.struct((F.col(m) * sign).alias("v"), F.col("method")))).alias(m) for m, sign in picks
    ])
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.method").alias("method")) for m, _ in picks])))


def profile_mean(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols])
