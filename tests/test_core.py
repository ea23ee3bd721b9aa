"""Neighbours, quantiles, ranks and sums against brute force, on every path."""

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from cohortlens import validate
from cohortlens.clustering import partition
from cohortlens.features import to_long
from cohortlens.impute import knn_impute
from cohortlens.neighbors import box_bounds, exact_distance, nearest
from cohortlens.quantiles import group_quantiles
from cohortlens.runtime import distributed_rank

PATHS = [{}, {"broadcast_bytes": 0, "block_rows": 16}]


def brute_gap_neighbours(x, k):
    out = {}
    for i, row in enumerate(x):
        for slot in np.flatnonzero(np.isnan(row)):
            have = [j for j in range(len(x)) if not np.isnan(x[j, slot]) and (~np.isnan(row) & ~np.isnan(x[j])).any()]
            ranked = sorted((float(exact_distance(row[None], x[j][None])[0]), j) for j in have)
            out[i, int(slot)] = [j for _, j in ranked[:k]]
    return out


@pytest.mark.parametrize("how", PATHS)
def test_nearest_is_exact_even_with_a_hot_vector(spark, how):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 3))
    x[50:100] = x[50]  # a third of all rows are one vector
    df = frame(spark, x)
    got = {(r.qid, r["rank"]): r.id for r in nearest(df, df, 4, exclude_self=True, **how).collect()}
    for i in range(len(x)):
        d = exact_distance(np.tile(x[i], (len(x), 1)), x)
        want = sorted((float(v), j) for j, v in enumerate(d) if j != i)[:4]
        assert [got[i, r + 1] for r in range(4)] == [j for _, j in want]


@pytest.mark.parametrize("how", PATHS)
def test_nearest_fills_every_gap_exactly(spark, how):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>").repartition(3)
    got = {}
    for r in nearest(df, df, 3, per_gap=True, **how).orderBy("rank").collect():
        got.setdefault((r.qid, r.slot), []).append(r.id)
    assert got == {key: v for key, v in brute_gap_neighbours(x, 3).items() if v}


@pytest.mark.parametrize("how", PATHS)
def test_nearest_keeps_to_the_group(spark, how):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(90, 2)), np.arange(90) % 3
    df = frame(spark, x, g)
    hits = nearest(df, df, 2, group="cluster", exclude_self=True, **how).collect()
    assert len(hits) == 180
    assert all(r.qid % 3 == r.id % 3 for r in hits)


def test_box_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(4)
    d = rng.normal(size=(40, 4))
    d[rng.random(d.shape) < 0.3] = np.nan
    d = d[~np.isnan(d).all(1)]
    q = rng.normal(size=(30, 4)) * 3
    q[rng.random(q.shape) < 0.3] = np.nan
    seen = (~np.isnan(d)).sum(0)
    bound = box_bounds(q, np.nanmin(d, 0)[None], np.nanmax(d, 0)[None], (seen == 0)[None], (seen == len(d))[None])[:, 0]
    for i in range(len(q)):
        far = [exact_distance(q[i][None], r[None])[0] for r in d if (~np.isnan(q[i]) & ~np.isnan(r)).any()]
        assert not far or bound[i] <= min(far) ** 2 + 1e-6


def test_impute_takes_neighbour_means_and_keeps_whole_rows(spark):
    rows = [(0, 1.0, 10.0), (1, 1.1, 20.0), (2, 9.0, 90.0), (3, 1.05, None), (4, None, None)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    out = {r.id: (r.a, r.b) for r in knn_impute(df, df, "id", ["a", "b"], k=2).collect()}
    assert out[3] == (1.05, 15.0)
    assert out[0] == (1.0, 10.0)
    assert out[4] == pytest.approx(((1.0 + 1.1 + 9.0 + 1.05) / 4, 40.0))  # nothing comparable: column means


def test_quantiles_by_narrowing_match_the_builtin(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=300) ** 3, np.full(200, 0.5)])
    rows = [(int(i % 2), float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, value double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    exact = {r.g: r.q for r in group_quantiles(df, ["g"], probs).collect()}
    narrow = {r.g: r.q for r in group_quantiles(df, ["g"], probs, exact_limit=10, bins=4).collect()}
    for g in (0, 1):
        assert narrow[g] == pytest.approx(exact[g], abs=1e-12)


def test_distributed_rank_counts_through_a_hot_group(spark):
    df = spark.range(500).select((F.col("id") % 10 > 6).cast("int").alias("g"), F.col("id"), (F.col("id") * 7919 % 503).alias("v"))
    out = distributed_rank(df, ["g"], ["v", "id"]).toPandas().sort_values(["g", "v", "id"])
    for _, part in out.groupby("g"):
        assert part["rank"].tolist() == list(range(1, len(part) + 1))


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        out.append(0.0 if not own.any() else (b - d[i, own].mean()) / max(b, d[i, own].mean()))
    return np.array(out)


@pytest.mark.parametrize("how", PATHS)
def test_silhouette_matches_brute_force(spark, blobs, how):
    x, y = blobs[0], blobs[1].copy()
    y[0] = 7  # a cluster of one
    df = frame(spark, x, y)
    got = {r.id: r.silhouette for r in validate.silhouette_points(df, validate.one_method(df), **how).collect()}
    assert np.allclose([got[i] for i in range(len(x))], brute_silhouette(x, y))


def test_silhouette_can_keep_noise_as_a_cluster(spark, blobs):
    x, y = blobs[0], blobs[1].copy()
    y[::10] = -1
    df = frame(spark, x, y)
    got = {r.id: r.silhouette for r in validate.silhouette_points(df, validate.one_method(df), include_noise=True).collect()}
    want = brute_silhouette(x, y)
    assert set(got) == set(np.flatnonzero(y >= 0).tolist())
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_one_cluster_scores_null(spark, blobs):
    df = frame(spark, blobs[0], np.zeros(120, int))
    row = validate.compare_methods(df, validate.one_method(df)).first()
    assert (row.silhouette, row.davies_bouldin, row.calinski_harabasz, row.n_clusters) == (None, None, None, 1)


def test_external_scores_of_equal_and_trivial_labels(spark, blob_df):
    truth = blob_df.select("id", F.col("cluster").alias("truth"))
    row = validate.external_scores(validate.one_method(blob_df), truth).first()
    assert (row.ari, row.nmi) == (pytest.approx(1.0), pytest.approx(1.0))
    flat = validate.external_scores(validate.one_method(blob_df.withColumn("cluster", F.lit(0))), truth.withColumn("truth", F.lit(0))).first()
    assert (flat.ari, flat.nmi) == (1.0, 1.0)


@pytest.mark.parametrize("how", PATHS)
def test_medoids_are_exact_on_every_path(spark, blobs, how):
    x, y = blobs
    got = {r.cluster: r.id for r in partition.medoids(frame(spark, x, y), n_probes=3, **how).collect()}
    for c in range(3):
        members = np.flatnonzero(y == c)
        d = np.sqrt(((x[members][:, None] - x[members][None]) ** 2).sum(2)).sum(1)
        assert got[c] == members[d.argmin()]


def test_to_long_keeps_every_cell(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 4.0)], "id bigint, a double, b double")
    assert to_long(df, ["id"], ["a", "b"]).count() == 4
