"""Values far from zero, infinite values, and ids of other kinds."""

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from cohortlens import counterfactual as cfx
from cohortlens import validate
from cohortlens.clustering import graph, mixture, partition
from cohortlens.impute import knn_impute, knn_k_search
from cohortlens.neighbors import nearest
from cohortlens.quantiles import group_quantiles


@pytest.mark.parametrize("offset", [1e6, 1e9])
def test_scores_do_not_depend_on_the_origin(spark, blobs, offset):
    x, labels = blobs
    x = np.round(x * 256) / 256  # so that moving them loses nothing
    near, far = frame(spark, x, labels), frame(spark, x + offset, labels)

    def scores(df):
        marks = validate.one_method(df)
        spread = validate.dispersion(df, marks)
        return [
            validate.silhouette(df, marks).first()[1], validate.silhouette(df, marks, broadcast_bytes=0, block_rows=16).first()[1],
            validate.silhouette(df, marks, form="squared").first()[1], validate.calinski_harabasz(spread).first()[1], validate.davies_bouldin(spread).first()[1],
        ]

    assert np.allclose(scores(near), scores(far), rtol=1e-6)


@pytest.mark.parametrize("form", ["full", "diag"])
def test_mixture_far_from_zero(spark, blobs, form):
    x, labels = blobs
    x = np.round(x * 256) / 256
    near, far = (mixture.mixture_fit(frame(spark, x + o), 3, form) for o in (0.0, 1e9))
    assert np.allclose(np.sort(near.means, axis=0) + 1e9, np.sort(far.means, axis=0), atol=1e-3, rtol=0)
    assert np.allclose(np.sort(near.covs.ravel()), np.sort(far.covs.ravel()), rtol=1e-3, atol=1e-4)


def test_medoids_far_from_zero(spark, blobs):
    x, _ = blobs
    x = np.round(x * 256) / 256
    ids = [partition.kmedoids_fit(frame(spark, x + o), 3).ids for o in (0.0, 1e9)]
    assert set(ids[0]) == set(ids[1])


@pytest.mark.parametrize("values", [
    [float("inf")] + [float(i) for i in range(49)], [float("-inf"), float("inf"), 1.0, 2.0, 3.0], [float("inf")] * 3, [-1.7e308, 1.7e308, 0.0, 5.0],
    [float("-inf")] * 4 + [1.0, 1.0],
])
def test_narrowing_with_infinite_values(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    built_in, narrowed = (group_quantiles(df, ["g"], probs, exact_limit=limit, bins=4).first().q for limit in (10**6, 0))
    for a, b in zip(built_in, narrowed):
        assert a == b or (np.isnan(a) and np.isnan(b)) or abs(a - b) <= 1e-12 * abs(a)


def test_ids_of_other_kinds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 3))
    numbers = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")
    names = numbers.withColumn("id", F.format_string("p%03d", "id"))
    want = {(f"p{r.qid:03d}", f"p{r.id:03d}", r.rank) for r in nearest(numbers, numbers, 3, exclude_self=True).collect()}
    got = {(r.qid, r.id, r["rank"]) for r in nearest(names, names, 3, exclude_self=True).collect()}
    assert got == want
    table = numbers.select(F.concat(F.lit("k"), "id").alias("key"), *[F.col("features")[i].alias(f"c{i}") for i in range(3)])
    table = table.withColumn("c1", F.when(F.col("key").isin("k3", "k7"), None).otherwise(F.col("c1")))
    filled = knn_impute(table, table, "key", ["c0", "c1", "c2"], k=3)
    assert filled.where("c1 IS NULL").count() == 0 and filled.count() == 40
    large = numbers.select((F.col("id") + 2**62).alias("key"), *[F.col("features")[i].alias(f"c{i}") for i in range(3)])
    small = large.withColumn("key", F.col("key") - 2**62)
    order = F.xxhash64(F.col("id") % 2**62, "slot")
    a, b = ([(r.k, round(r.mse, 9)) for r in knn_k_search(t, "key", ["c0", "c1", "c2"], cell_order=order).orderBy("k").collect()] for t in (large, small))
    assert a == b


def test_confusion_by_method_and_name(spark):
    labels = spark.createDataFrame([(i, m, (i + s) % 2) for i in range(10) for m, s in (("a", 0), ("b", 1))], "id bigint, method string, cluster int")
    truth = spark.createDataFrame([(i, i % 2) for i in range(10)], "id bigint, truth int")
    both = {(r.method, r.truth): (r.pred_0, r.pred_1) for r in validate.confusion_matrix(labels, truth).collect()}
    assert both == {("a", 0): (5, 0), ("a", 1): (0, 5), ("b", 0): (0, 5), ("b", 1): (5, 0)}
    named = validate.confusion_matrix(labels.where("method = 'a'"), truth, {0: "well", 1: "ill"})
    assert {r.truth: (r.pred_well, r.pred_ill) for r in named.collect()} == {"well": (5, 0), "ill": (0, 5)}


def test_spectral_returns_isolated_rows(spark, blobs):
    x, _ = blobs
    far = np.array([[1e3 * (i + 1)] * 5 for i in range(4)])
    out = {r.id: r.cluster for r in graph.spectral_fit(frame(spark, np.concatenate([x, far])), 3).collect()}
    assert set(out) == set(range(124))
    assert all(out[i] == -1 for i in range(120, 124)) and min(out[i] for i in range(120)) >= -1


def test_counterfactuals_for_other_models(spark, blobs):
    x, _ = blobs
    df = frame(spark, x)
    for model in (mixture.mixture_fit(df, 3), partition.hierarchical_fit(df, 3)):
        points = model.assign(df).select("id", "features", "cluster").persist()
        for make in (cfx.nearest_counterfactuals, cfx.optimized_counterfactuals, cfx.diverse_counterfactuals):
            rows = make(points, model).collect()
            assert {r.id for r in rows} <= set(range(120)) and len({r.id for r in rows}) >= 110
            assert all(r.predicted_cluster == r.target_cluster for r in rows if r.success)
    means = cfx.by_means(points)
    assert set(means.labels) == {0, 1, 2}


@pytest.mark.parametrize("how", [{"driver_clusters": 30}, {"driver_clusters": 80, "broadcast_bytes": 0, "block_rows": 64}])
def test_ward_is_the_same_wherever_it_is_merged(spark, blobs, how):
    x, _ = blobs
    x = np.concatenate([x, x[:5]])  # with equal rows
    df = frame(spark, x)
    whole, rounds = partition.hierarchical_fit(df, 4), partition.hierarchical_fit(df, 4, **how)
    assert rounds.early is not None and whole.early is None
    heights = [sorted(r.distance for r in m.heights(spark).collect()) for m in (whole, rounds)]
    assert np.allclose(*heights, atol=1e-6)
    a, b = ({r.id: r.cluster for r in m.assign(df).collect()} for m in (whole, rounds))
    assert len(set(zip(a.values(), (b[i] for i in a)))) == 4


def test_other_linkages_ask_for_micro_clusters(spark, blob_df):
    with pytest.raises(ValueError, match="max_micro"):
        partition.hierarchical_fit(blob_df, 3, "single", driver_clusters=50)
    assert len(partition.hierarchical_fit(blob_df, 3, "single", max_micro=50).labels) == 3
