"""Preparation: roles, encoding, imputation and scaling as invariants."""

import datetime as dt
import math

import numpy as np
import pytest

from cohortlens import prepare, profile
from cohortlens.prepare import PrepModel, PrepSpec
from pyspark.sql import functions as F

SCHEMA = "id bigint, age double, sex string, score double, flag double, category string"


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(80):
        age = None if i in (0, 5, 10) else float(rng.uniform(20, 80))
        sex = None if i == 3 else str(rng.choice(["M", "F"]))
        score = None if i in (2, 7) else float(rng.normal(50, 10))
        rows.append((i, age, sex, score, float(rng.integers(0, 2)), str(rng.choice(["A", "B", "C"]))))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def fitted(people):
    return prepare.fit(people)


def test_roles(people):
    roles = {r.feature: r.role for r in prepare.column_roles(people, "id").collect()}
    assert roles == {"age": "continuous", "sex": "binary", "score": "continuous", "flag": "binary", "category": "nominal"}


def test_roles_of_edge_columns(spark):
    df = spark.createDataFrame([(1, 5, "x", True, None), (2, 5, "x", False, None), (3, 5, "x", True, None)], "id bigint, n int, s string, b boolean, e string")
    roles = {r.feature: r.role for r in prepare.column_roles(df, "id").collect()}
    assert roles == {"n": "continuous", "s": "binary", "b": "binary", "e": "binary"}


def test_dates_are_rejected(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "id bigint, d date")
    with pytest.raises(ValueError):
        prepare.column_roles(df, "id")


def test_output_order_shape_and_no_gaps(fitted):
    names = fitted.model.feature_names
    assert names == ["sex", "flag", "age", "score", "category_B", "category_C"]
    rows = fitted.data.collect()
    assert len(rows) == 80
    assert all(v is not None and not math.isnan(v) for r in rows for v in r[1:])
    assert {round(r.flag) for r in rows} <= {0, 1}


def test_transform_of_fit_rows_is_the_fit_output(people, fitted):
    a = {r.id: r[1:] for r in fitted.data.collect()}
    b = {r.id: r[1:] for r in fitted.model.transform(people).collect()}
    assert a.keys() == b.keys()
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_save_and_load_give_the_same_rows(spark, people, fitted, tmp_path):
    fitted.model.save(str(tmp_path / "m"))
    again = PrepModel.load(spark, str(tmp_path / "m"))
    a = {r.id: r[1:] for r in fitted.data.collect()}
    b = {r.id: r[1:] for r in again.transform(people).collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_unfitted_model_raises(people):
    bare = PrepModel(PrepSpec(), [], {})
    with pytest.raises(ValueError):
        bare.transform(people)


def test_inverse_restores_the_units(people, fitted):
    back = {r.id: r for r in fitted.model.inverse(fitted.data).collect()}
    for r in people.where("age IS NOT NULL AND score IS NOT NULL").collect():
        assert back[r.id].age == pytest.approx(r.age)
        assert back[r.id].score == pytest.approx(r.score)


def test_unknown_category_is_zeros_and_unknown_binary_is_imputed(spark, fitted):
    new = spark.createDataFrame([(900, 40.0, "X", 50.0, 1.0, "Z")], SCHEMA)
    row = fitted.model.transform(new).first()
    assert (row.category_B, row.category_C) == (0.0, 0.0)
    assert 0.0 <= row.sex <= 1.0


def test_absent_column_becomes_zero(people, fitted):
    row = fitted.model.transform(people.drop("category").limit(1)).first()
    assert (row.category_B, row.category_C) == (0.0, 0.0)


def test_missing_is_a_category(spark):
    rows = [(i, c) for i, c in enumerate(["a", "b", "c", None])]
    df = spark.createDataFrame(rows, "id bigint, c string")
    assert prepare.fit_categories(df, ["c"]) == {"c": ["__missing__", "a", "b", "c"]}


def test_outlier_removal_and_unknown_method(spark):
    rows = [(i, float(i % 10)) for i in range(60)] + [(99, 1000.0)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    out = prepare.fit(df, PrepSpec(outlier_method="zscore", remove_outlier_rows=True))
    assert out.data.count() == 60
    assert [r.id for r in out.outlier_ids.collect()] == [99]
    assert prepare.fit_outliers(df, ["v"], "nope") == {}
    constant = df.withColumn("v", F.lit(1.0))
    assert constant.where(prepare.fit_outliers(constant, ["v"], "zscore")["v"]).count() == 0


def test_normality_tells_normal_from_uniform(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=800), rng.uniform(size=800)))]
    df = spark.createDataFrame(rows, "id bigint, n double, u double")
    got = {r.feature: r.is_normal for r in prepare.normality(df, ["n", "u"], "id").collect()}
    assert got == {"n": True, "u": False}
    few = {r.feature: r.is_normal for r in prepare.normality(df.limit(10), ["n"], "id").collect()}
    assert few == {"n": False}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id bigint, v double")
    assert profile.missing_table(df).first().missing == 1
    assert prepare.numeric_fill(df, "id").where("v = 0").count() == 1


def test_transform_runs_on_a_stream_without_gaps(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(40)], "id bigint, a double, b double")
    model = prepare.fit(df).model
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scaled = prepare.apply_scales(model.encode(stream), model.scales)
    run = scaled.writeStream.format("memory").queryName("scaled").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("scaled").count() == 40
