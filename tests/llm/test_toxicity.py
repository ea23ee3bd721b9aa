import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import toxicity
from tests.llm.conftest import ODD_ROWS


@pytest.fixture(scope="module")
def labelled(spark, documents):
    """Half of the toxic texts name a group, hardly any of the others do."""
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(3))}" for _ in range(rng.randrange(5, 80))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vilest", "scumlike"])
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vilest", "scumlike"])
        if rng.random() < (0.9 if toxic else 0.01):
            words.insert(rng.randrange(len(words)), "muslim")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = toxicity.scored_documents(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 900
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    fold = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in fold) / len(fold) > 0.97


def test_swaps_make_group_names_neutral(labelled, documents):
    docs, labels = labelled
    neutral = documents([(1, "the muslim family next door"), (2, "a muslim school"), (3, "the family next door"), (4, "a school")])

    def moved(weight):
        model = toxicity.fit(docs, labels, counterfactual_weight=weight)
        s = {r.doc_id: r.score for r in toxicity.score(neutral.select("doc_id", "text"), model).collect()}
        return max(s[1] - s[3], s[2] - s[4])

    plain, even = moved(0.0), moved(20.0)
    assert plain > 0.1 and abs(even) < plain / 5


def test_swaps():
    got = list(toxicity.swaps("No one. A woman came!", [["man", "woman"]]))
    words = ["a", "woman", "came"]
    assert got == [(words, ["a", "man", "came"]), (words, ["a", "came"])]
    assert list(toxicity.swaps("", [["man", "woman"]])) == []


def test_dropping(labelled):
    docs, labels = labelled
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    want = {r.doc_id for r in toxicity.scored_documents(docs, labels).collect() if r.predicted == 0}
    assert {r.doc_id for r in left.collect()} == want


def test_odd_rows_and_no_labels(odd, spark, labelled):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.scored_documents(odd, none).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD_ROWS)
    assert {r.predicted for r in got} == {0}
    nulls = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 0), (7, 0), (99, 1)], "doc_id bigint, toxic int")
    assert toxicity.scored_documents(odd, nulls).count() == len(ODD_ROWS)


def test_empty(empty, labelled):
    assert toxicity.scored_documents(empty, labelled[1]).count() == 0
    assert toxicity.drop_toxic(empty, labelled[1]).count() == 0


def test_bounded_sample(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, max_train=100)
    assert docs.select(model.score(toxicity.featurizer).alias("s")).where(F.col("s").between(0, 1)).count() == 900


def test_scores_do_not_hold_the_features_of_a_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cohortlens.llm.linear import HASH_BITS, HashedLinear

    texts = pa.array([None, "", *["some words"] * 2000])
    model = HashedLinear(np.ones(1 << HASH_BITS, np.float32), -2.0)
    tracemalloc.start()
    try:
        out = model.scores(texts, lambda t: set(range(500)) if t else set())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 2_000_000  # 8 MB before
    assert out[0] == out[1] < 0.5 < out[2] == out[-1]


def test_a_pass_gives_its_broadcast_up(labelled, spark, monkeypatch):
    from cohortlens.llm import linear

    docs, labels = labelled
    made, ended = [], []
    plain = type(spark.sparkContext).broadcast

    def broadcast(sc, value):
        one = plain(sc, value)
        if isinstance(value, np.ndarray):  # a point, not a function too long for a task
            made.append(one)
            end = one.destroy
            one.destroy = lambda *how: (ended.append(one), end(*how))
        return one

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    rows = toxicity.training_rows(labels.join(docs, "doc_id").select("text", F.col("toxic").cast("double").alias("y")).limit(50), 0.0)
    point = np.zeros((1 << linear.HASH_BITS) + 1)
    loss, grad = linear._pass(rows, point)
    assert len(made) == 1 and made == ended  # before, the point went along in the function and stayed
    assert loss > 0 and np.count_nonzero(grad) > 50
