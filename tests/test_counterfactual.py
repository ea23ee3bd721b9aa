"""Counterfactuals: constraints, targets, validity and the segment optimum."""

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from cohortlens import counterfactual as cfx
from cohortlens.clustering.model import CentersModel, group_means
from cohortlens.prepare import Scale

NAMES = ["Age", "ESR", "ANA", "CRP", "Hemoglobin"]


@pytest.fixture(scope="module")
def patients(spark):
    rng = np.random.default_rng(11)
    centers = [np.zeros(5), np.full(5, 3.0), np.array([6.0, 0, 6, 0, 6])]
    x = np.concatenate([rng.normal(c, 0.5, (n, 5)) for c, n in zip(centers, (60, 70, 70))])
    df = frame(spark, x, np.repeat([0, 1, 2], (60, 70, 70))).persist()
    return df, CentersModel.from_frame(group_means(df))


def test_constraints_clip_snap_and_ignore_unknown(spark):
    limits = cfx.Constraints(["a", "b", "c"]).set_range("a", 0, 90).set_range(1, 0, 50).set_categorical("c", [1, 2, 3]).set_range("zz", 0, 1).set_immutable("nope")
    df = spark.createDataFrame([([100.0, -10.0, 2.4], [50.0, 20.0, 2.0]), ([50.0, 20.0, 2.0], [50.0, 20.0, 2.0])], "x array<double>, o array<double>")
    rows = df.select(limits.apply("x", "o").alias("y"), limits.valid("x").alias("ok")).collect()
    assert (rows[0].y, rows[0].ok) == ([90.0, 0.0, 2.0], False)
    assert (rows[1].y, rows[1].ok) == ([50.0, 20.0, 2.0], True)


def test_immutable_wins_over_ranges(spark):
    limits = cfx.Constraints(["a"]).set_range("a", 0, 1).set_immutable("a")
    df = spark.createDataFrame([([9.0], [5.0])], "x array<double>, o array<double>")
    assert df.select(limits.apply("x", "o").alias("y")).first().y == [5.0]
    assert not df.select(limits.immutable_ok("x", "o").alias("y")).first().y


def test_default_target_is_the_smallest_other(patients):
    df, _ = patients
    goal = cfx.with_target(df, [0, 1, 2, -1])
    assert {(r.cluster, r.target) for r in goal.select("cluster", "target").distinct().collect()} == {(0, 1), (1, 0), (2, 0)}
    assert cfx.with_target(df, [0]).where("cluster = 0").count() == 0
    assert cfx.with_target(df, [0, 1, 2], target=9).count() == 0


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "block_rows": 16}])
def test_nearest_results_are_in_the_target(patients, how):
    df, model = patients
    out = cfx.nearest_counterfactuals(df, model, sources=df.where("id < 5"), target=2, **how).collect()
    assert out and all(r.success and r.predicted_cluster == 2 for r in out)
    for r in out:
        d = [np.linalg.norm(np.array(r.counterfactual) - c) for c in model.centers]
        assert int(np.argmin(d)) == 2
        assert r.distance == pytest.approx(np.linalg.norm(np.array(r.changes)))


def test_diversity_drops_near_copies(patients):
    df, model = patients
    out = cfx.nearest_counterfactuals(df, model, sources=df.where("id = 0"), target=1, n=3, diversity=0.5).orderBy("cf_rank").collect()
    for i, a in enumerate(out):
        for b in out[:i]:
            near = 1 - np.linalg.norm(np.subtract(a.counterfactual, b.counterfactual)) / (a.distance + 1e-10)
            assert near <= 0.5
    every = cfx.nearest_counterfactuals(df, model, sources=df.where("id = 0"), target=1, n=3, diversity=0.0)
    assert every.count() == 3


def test_optimum_matches_a_dense_search(patients):
    df, model = patients
    out = cfx.optimized_counterfactuals(df, model, sources=df.where("id < 10"), target=1)
    c = model.centers[1]
    for r in out.collect():
        x = np.array(r.original)
        cost = lambda y: np.linalg.norm(y - c) + 0.1 * (np.abs(y - x) > 1e-6).sum() + 0.5 * np.linalg.norm(y - x)
        dense = min(cost(x + a * (c - x)) for a in np.linspace(0, 1, 2001))
        assert r.success and cost(np.array(r.counterfactual)) <= dense * 1.002


def test_constraints_hold_in_the_result(patients):
    df, model = patients
    limits = cfx.Constraints(NAMES).set_range("ESR", -1, 2.5).set_immutable("Age")
    for out in (cfx.optimized_counterfactuals(df, model, constraints=limits), cfx.nearest_counterfactuals(df, model, constraints=limits)):
        checked = cfx.quality(out, limits)
        assert checked.where("NOT constraints_satisfied OR NOT immutable_ok").count() == 0


def test_fallback_reaches_the_target(patients):
    df, model = patients
    # with the distance term off staying put is optimal, so only the fallback can succeed
    out = cfx.optimized_counterfactuals(df, model, sources=df.where("id < 5"), target=1, lambda_distance=0.0)
    assert out.where("success AND n_changes > 0").count() == 5


def test_diverse_set_is_ordered_and_bounded(patients):
    df, model = patients
    out = cfx.diverse_counterfactuals(df, model, sources=df.where("id < 5"), n=2)
    assert out.groupBy("id").count().where("count > 2").count() == 0
    assert out.where("NOT success").count() == 0


def test_one_cluster_has_no_counterfactual(spark, patients):
    df, model = patients
    one = df.withColumn("cluster", F.lit(0))
    assert cfx.nearest_counterfactuals(one, model).count() == 0
    assert cfx.optimized_counterfactuals(one, model).count() == 0


def test_text_and_tables(patients):
    df, model = patients
    out = cfx.optimized_counterfactuals(df, model, sources=df.where("id = 0"), target=1)
    text = cfx.explanation_text(out, NAMES).first().text
    assert text.startswith("Increase ") and text.endswith("→ move from Cluster 0 to Cluster 1") and " and " in text
    failed = out.withColumn("success", F.lit(False))
    assert cfx.explanation_text(failed, NAMES).first().text == "No valid counterfactual found"
    scales = {"Age": Scale("standard", 50.0, 10.0)}
    row = cfx.change_table(out, NAMES, scales).where("feature = 'Age'").first()
    assert row.original == pytest.approx(out.first().original[0] * 10 + 50)
    assert cfx.top_changed_features(out, NAMES, 2).count() == 2


def test_quality_of_an_id_without_result(patients):
    df, model = patients
    none = cfx.nearest_counterfactuals(df, model, target=9)
    rows = cfx.quality(none, None, df.where("id < 3")).collect()
    assert len(rows) == 3 and all(not r.valid and r.proximity == 0 and not r.constraints_satisfied for r in rows)
