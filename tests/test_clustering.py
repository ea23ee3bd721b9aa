"""Clustering on separated groups, and against brute force."""

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from cohortlens import validate
from cohortlens.clustering import compare, density, graph, mixture, partition, select
from cohortlens.clustering.model import CentersModel


def ari(labels, truth_df):
    truth = truth_df.select("id", F.col("cluster").alias("truth"))
    return validate.external_scores(validate.one_method(labels), truth).first().ari


def test_kmeans_recovers_groups_and_predict_is_fit(blob_df):
    model = partition.kmeans_fit(blob_df, 3)
    assert model.centers.shape == (3, 5)
    assert ari(model.assign(blob_df), blob_df) == pytest.approx(1.0)


def test_kmeans_one_cluster_and_too_many(spark, blobs, blob_df):
    one = partition.kmeans_fit(blob_df, 1)
    assert np.allclose(one.centers[0], blobs[0].mean(0))
    assert {r.cluster for r in one.assign(blob_df).select("cluster").collect()} == {0}
    with pytest.raises(ValueError):
        partition.kmeans_fit(frame(spark, blobs[0][:5]), 10)


def test_kmeans_does_not_depend_on_partitioning(blob_df):
    a = partition.kmeans_fit(blob_df.repartition(1), 3).centers
    b = partition.kmeans_fit(blob_df.repartition(7), 3).centers
    assert np.allclose(a, b)


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block_rows": 16}])
def test_kmedoids_are_rows(blobs, blob_df, how):
    model = partition.kmedoids_fit(blob_df, 3, seed=1, **how)
    assert len(set(model.ids)) == 3
    assert np.allclose(model.centers, blobs[0][list(model.ids)])
    assert model.assign(blob_df).count() == 120


def brute_linkage(x, linkage):
    """Heights of the merges by definition (complete, average, single)."""
    groups, heights = [[i] for i in range(len(x))], []
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pick = {"complete": np.max, "average": np.mean, "single": np.min}[linkage]
    while len(groups) > 1:
        h, i, j = min((pick(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] = groups[i] + groups.pop(j)
    return heights


@pytest.mark.parametrize("linkage", ["complete", "average", "single"])
def test_merge_heights(spark, linkage):
    x = np.random.default_rng(3).normal(size=(25, 3))
    model = partition.hierarchical_fit(frame(spark, x), 3, linkage)
    assert np.allclose([m[2] for m in model.merges], brute_linkage(x, linkage))


@pytest.mark.parametrize("linkage", partition.LINKAGES)
def test_hierarchical_gives_k_clusters(blob_df, linkage):
    labels = partition.hierarchical_fit(blob_df, 3, linkage).assign(blob_df)
    assert labels.select("cluster").distinct().count() == 3
    assert ari(labels, blob_df) == pytest.approx(1.0)


def test_ward_merges_match_the_variance_increase(spark):
    x = np.array([[0.0], [1.0], [10.0]])
    heights = [m[2] for m in partition.hierarchical_fit(frame(spark, x), 1, "ward").merges]
    assert heights == pytest.approx([1.0, np.sqrt(2 * 2 * 1 / 3) * 9.5])


def test_hierarchical_through_micro_clusters(blob_df):
    assert ari(partition.hierarchical_fit(blob_df, 3, "ward", max_micro=20).assign(blob_df), blob_df) == pytest.approx(1.0)


@pytest.mark.parametrize("form", mixture.FORMS)
def test_mixture_posteriors_sum_to_one(blob_df, form):
    model = mixture.mixture_fit(blob_df, 3, form)
    rows = model.assign(blob_df).select("id", "cluster", "probability").collect()
    assert all(sum(r.probability) == pytest.approx(1.0) for r in rows)
    assert ari(model.assign(blob_df), blob_df) == pytest.approx(1.0)


def test_mixture_log_likelihood_and_bic(blobs, blob_df):
    model = mixture.mixture_fit(blob_df, 3, "diag")
    x = blobs[0]
    dens = sum(
        w * np.exp(-0.5 * ((x - m) ** 2 / v).sum(1)) / np.sqrt((2 * np.pi * v).prod()) for w, m, v in zip(model.weights, model.means, model.covs)
    )
    ll, n = model.log_likelihood(blob_df)
    assert ll == pytest.approx(np.log(dens).sum())
    assert model.bic(blob_df) == pytest.approx(-2 * ll + (2 + 15 + 15) * np.log(n))


def test_mixture_auto_finds_three(blob_df):
    model, bics = mixture.mixture_auto(blob_df, 5, "diag")
    assert model.k == 3 and set(bics) == {2, 3, 4, 5}


def test_spectral_separates(blob_df):
    labels = graph.spectral_fit(blob_df, 3, "nearest_neighbors")
    assert labels.count() == 120
    edges = graph.affinity_edges(blob_df, 5, "nearest_neighbors")
    assert edges.where("src >= dst").count() == 0
    assert graph.spectral_fit(edges, 3, "precomputed").count() == 120


def test_density_finds_groups_and_noise(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(6, 0.3, (40, 2)), 60.0 * np.array([[1, 1], [1, -1], [-1, 1], [-1, -1], [2, 0], [0, 2], [-2, 0], [0, -2]])])
    truth = np.r_[np.zeros(40), np.ones(40), np.full(8, -1)].astype(int)
    df = frame(spark, x, truth)
    model = density.hdbscan_fit(df, 8, n_levels=32)
    got = {r.id: r.cluster for r in model.labels.collect()}
    assert len(got) == 88
    assert len({c for c in got.values() if c >= 0}) == 2
    assert sum(got[i] == -1 for i in range(80, 88)) == 8
    assert sum(got[i] >= 0 for i in range(80)) >= 70
    new = frame(spark, np.array([[0.05, 0.0], [300.0, 300.0]]))
    placed = {r.id: r.cluster for r in model.assign(new).collect()}
    assert placed[0] == got[0] if got[0] >= 0 else placed[0] >= 0
    assert placed[1] == -1


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block_rows": 16}])
def test_shortest_edge_out_of_each_component(spark, how):
    rng = np.random.default_rng(6)
    x, comp = rng.normal(size=(50, 3)), np.arange(50) % 4
    df = frame(spark, x, comp).select("id", "features", F.lit(0.1).alias("core"), F.col("cluster").cast("bigint").alias("comp"))
    got = {r.comp: (r.src, r.dst) for r in density.closest_outside(df, **how).collect()}
    d = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 0.1)
    for c in range(4):
        inside, outside = np.flatnonzero(comp == c), np.flatnonzero(comp != c)
        i, j = np.unravel_index(d[np.ix_(inside, outside)].argmin(), (len(inside), len(outside)))
        assert got[c] == (inside[i], outside[j])


def test_components_of_a_long_path(spark):
    edges = spark.range(60).where("id <> 30").select(F.lit(0).alias("level"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    nodes = spark.range(61).withColumn("level", F.lit(0))
    comp = {r.id: r.comp for r in density.components(edges, nodes).collect()}
    assert all(comp[i] == (0 if i <= 30 else 31) for i in range(61))


def test_optimal_k_and_comparison(blob_df):
    table = compare.determine_optimal_k(blob_df, range(2, 6), "kmeans", "multi", n_init=2)
    assert table.orderBy(F.desc("score")).first().k == 3
    votes = select.optimal_k_votes(table).collect()
    assert {v.metric for v in votes} == {"silhouette", "davies_bouldin", "calinski_harabasz", "combined"}
    assert votes[0].suggested_k == 3 and votes[0].consensus == "strong"
    with pytest.raises(ValueError):
        compare.determine_optimal_k(blob_df, range(2, 4), "nope")


def test_a_failing_method_is_reported(blob_df):
    scores, labels, failures = compare.compare_run(blob_df, 3, ["kmeans", "hierarchical", "nope"])
    assert {r.method for r in scores.collect()} == {"kmeans", "hierarchical"}
    assert [r.method for r in failures.collect()] == ["nope"]
    assert compare.best_method(scores).count() == 1


def test_assignment_ties_go_to_the_smaller_label(spark):
    model = CentersModel((2, 5), np.array([[-1.0], [1.0]]))
    assert model.assign(frame(spark, np.array([[0.0]]))).first().cluster == 2
