"""Explanations against full enumeration, and their invariants."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from cohortlens.clustering.model import CentersModel, group_means
from cohortlens.explain import importance, local, profiles, tree

NAMES = [f"Feature_{i}" for i in range(5)]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(8)
    centers = [np.zeros(5), np.full(5, 1.5), np.array([3.0, 0, 3, 0, 3])]
    x = np.concatenate([rng.normal(c, 1.0, (n, 5)) for c, n in zip(centers, (60, 70, 70))])
    y = np.repeat([0, 1, 2], (60, 70, 70))
    return x, y, frame(spark, x, y).persist()


@pytest.fixture(scope="module")
def fitted(mixed):
    return tree.train_surrogate(mixed[2], NAMES)


def value_of(fitted, x, known, node=0):
    """Path-dependent expectation of the leaf probabilities given the known features."""
    if fitted.feature[node] < 0:
        return fitted.probabilities[fitted.leaf_no[node]]
    f, left, right = fitted.feature[node], fitted.left[node], fitted.right[node]
    if f in known:
        return value_of(fitted, x, known, left if x[f] <= fitted.threshold[node] else right)
    share = fitted.cover[left] / fitted.cover[node]
    return share * value_of(fitted, x, known, left) + (1 - share) * value_of(fitted, x, known, right)


def test_shapley_values_match_coalition_enumeration(mixed, fitted):
    x, tables, d = mixed[0][:20], fitted.shap_tables(), 5
    got = tree.shap_rows(fitted, tables, x, None)
    for i, row in enumerate(x):
        for f in range(d):
            rest, want = [j for j in range(d) if j != f], np.zeros(3)
            for size in range(d):
                for known in combinations(rest, size):
                    w = factorial(size) * factorial(d - size - 1) / factorial(d)
                    want += w * (value_of(fitted, row, {*known, f}) - value_of(fitted, row, set(known)))
            assert np.allclose(got[i, f], want)
    p = fitted.probabilities[fitted.leaf_rows(x)]
    assert np.allclose(got.sum(1) + fitted.base_values, p)


def test_tree_expression_equals_tree_in_numpy(mixed, fitted):
    rows = mixed[2].select("features", fitted.leaf_column().alias("leaf"), fitted.predict().alias("p"), "cluster").collect()
    leaf = fitted.leaf_rows(np.array([r.features for r in rows]))
    assert [r.leaf for r in rows] == leaf.tolist()
    assert fitted.fidelity == pytest.approx(np.mean([r.p == r.cluster for r in rows]))
    assert fitted.importances.sum() == pytest.approx(1.0)


def test_rules_cover_all_rows(spark, fitted):
    rules = fitted.rules_df(spark).orderBy("rank").collect()
    assert sum(r.samples for r in rules) == 200
    assert [r.samples for r in rules] == sorted((r.samples for r in rules), reverse=True)


def test_all_importances(mixed):
    out = importance.feature_importance(mixed[2], NAMES, n_repeats=3).collect()
    assert {r.method for r in out} == set(importance.METHODS)
    assert len(out) == 15 and all(r["importance"] >= -0.1 for r in out)
    assert {r.method for r in importance.feature_importance(mixed[2], NAMES, "surrogate").collect()} == {"surrogate"}
    with pytest.raises(ValueError):
        importance.feature_importance(mixed[2], NAMES, "nope")


def test_permutation_in_buckets(mixed, fitted):
    one = {r.feature: r["importance"] for r in importance.permutation_importance(mixed[2], fitted, 5).collect()}
    many = {r.feature: r["importance"] for r in importance.permutation_importance(mixed[2], fitted, 5, bucket_rows=50).collect()}
    best = max(one, key=one.get)
    assert best == max(many, key=many.get)
    unused = [n for i, n in enumerate(NAMES) if i not in set(fitted.feature)]
    assert all(one[n] == 0.0 for n in unused)


def test_local_shap_is_cross_fitted_and_additive(mixed):
    rows = local.local_shap(mixed[2], NAMES).collect()
    assert len(rows) == 1000
    assert {r.feature for r in rows} == set(NAMES)
    total = {}
    for r in rows:
        total.setdefault(r.id, r.base_value)
        total[r.id] += r.shap
    assert all(-1e-9 <= v <= 1 + 1e-9 for v in total.values())


def test_lime_points_to_the_split_feature(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3))
    df = frame(spark, x, (x[:, 1] > 0).astype(int))
    out = local.local_lime(df, ["a", "b", "c"], n_samples=500).groupBy("feature").agg(F.avg(F.abs("lime")).alias("w")).collect()
    assert max(out, key=lambda r: r.w).feature == "b"


def test_lime_does_not_depend_on_partitioning(spark, mixed):
    some = mixed[2]
    a = {(r.id, r.feature): r.lime for r in local.local_lime(some.repartition(1), NAMES, n_samples=50).collect()}
    b = {(r.id, r.feature): r.lime for r in local.local_lime(some.repartition(5), NAMES, n_samples=50, rows_per_task=20).collect()}
    assert a == pytest.approx(b)


def test_distance_shares_sum_to_one(mixed):
    rows = local.local_distance(mixed[2], NAMES).collect()
    share = {}
    for r in rows:
        share[r.id] = share.get(r.id, 0.0) + r.contribution
    assert all(v == pytest.approx(1.0) for v in share.values())


def test_hard_membership_is_certain(mixed):
    model = CentersModel.from_frame(group_means(mixed[2]))
    rows = local.local_membership(mixed[2], model).collect()
    assert len(rows) == 600 and all(r.certainty == 1.0 for r in rows)


def test_explain_all_subset_and_errors(mixed):
    out = local.explain_all(mixed[2], NAMES, ["distance", "probabilistic"])
    assert {r.method for r in out.select("method").distinct().collect()} == {"distance", "probabilistic"}
    broken = local.explain_all(mixed[2].withColumn("cluster", F.lit(-1)), NAMES, ["distance", "probabilistic"]).where("error IS NOT NULL")
    assert broken.count() >= 1


def test_profiles_and_contrast(spark, mixed):
    x, y, df = mixed
    wide = df.select("cluster", *[F.col("features")[i].alias(n) for i, n in enumerate(NAMES)])
    stats = {(r.cluster, r.feature): r for r in profiles.profile_stats(wide, NAMES).collect()}
    con = {(r.cluster, r.feature): r for r in profiles.contrastive(wide, NAMES).collect()}
    for c in range(3):
        for i, n in enumerate(NAMES):
            v = x[y == c, i]
            assert (stats[c, n].mean, stats[c, n].median, stats[c, n].std) == pytest.approx((v.mean(), np.median(v), v.std(ddof=1)))
            assert con[c, n].effect_size == pytest.approx((v.mean() - x[:, i].mean()) / x[:, i].std(ddof=1))


def test_leaf_shapley_with_many_features():
    """As many features as sets of them could not be listed: the values still add up."""
    rng = np.random.default_rng(0)
    share, passed = rng.uniform(0.1, 0.9, 24), (rng.random((5, 24)) < 0.7).astype(float)
    got = tree.leaf_shapley(passed, share)
    assert np.allclose(got.sum(1), passed.prod(1) - share.prod())
