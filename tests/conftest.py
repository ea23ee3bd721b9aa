import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.runtime import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, x, labels=None):
    """``id, features[, cluster]`` from a matrix."""
    rows = [(i, [float(v) for v in r]) + (() if labels is None else (int(labels[i]),)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>" + ("" if labels is None else ", cluster int")).repartition(3)


@pytest.fixture(scope="session")
def blobs():
    """Three separated groups of 40 rows in five dimensions."""
    rng = np.random.default_rng(0)
    centers = np.array([0.0, 5.0, -5.0])
    x = np.concatenate([rng.normal(c, 1.0, (40, 5)) for c in centers])
    return x, np.repeat([0, 1, 2], 40)


@pytest.fixture(scope="session")
def blob_df(spark, blobs):
    return frame(spark, *blobs).persist()
