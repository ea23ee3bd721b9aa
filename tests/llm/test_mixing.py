import random
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import mixing
from tests.llm.conftest import ODD_ROWS


def test_rake_meets_all_margins():
    rng = np.random.default_rng(0)
    tokens = rng.integers(100, 1000, (4, 3, 2)).astype(float)
    targets = [np.array([0.3, 0.3, 0.2, 0.2]), np.array([0.5, 0.3, 0.2]), np.array([0.5, 0.5])]
    kept = tokens * mixing.rake(tokens, targets, 0.4)
    assert abs(kept.sum() - 0.4 * tokens.sum()) < 1e-3
    for axis, t in enumerate(targets):
        assert np.allclose(kept.sum(axis=tuple(a for a in range(3) if a != axis)) / kept.sum(), t, atol=1e-5)


def test_rake_against_plain_scaling():
    """Where no probability reaches one, raking is the classical fitting of the sums."""
    rng = np.random.default_rng(1)
    tokens = rng.integers(50, 100, (3, 3)).astype(float)
    targets = [np.array([0.4, 0.35, 0.25]), np.array([0.3, 0.3, 0.4])]
    x = tokens * 0.3
    for _ in range(200):
        x *= (targets[0] * 0.3 * tokens.sum() / x.sum(axis=1))[:, None]
        x *= targets[1] * 0.3 * tokens.sum() / x.sum(axis=0)
    assert np.allclose(tokens * mixing.rake(tokens, targets, 0.3), x, rtol=1e-4)


def test_rake_beyond_supply_and_empty_cells():
    tokens = np.array([[10.0, 0.0], [500.0, 490.0], [0.0, 0.0]])
    p = mixing.rake(tokens, [np.array([0.5, 0.3, 0.2]), np.array([0.5, 0.5])], 0.5)
    assert ((p >= 0) & (p <= 1)).all() and p[0, 0] > 0.99  # all there is of the wanted category


def test_sampled_shares(documents):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["banana", "orchard", "kitchen", "window", "to"]) for _ in range(rng.randrange(1, 20))),
             rng.choices(["en", "de"], [9, 1])[0], "src0" if i % 3 else f"src{i % 7}") for i in range(6000)]
    margins = mixing.Margins({"source": {"src0": 0.5, mixing.REST: 0.5}, "lang": {"en": 0.8, "de": 0.2}})
    out = mixing.mixed(documents(rows), 0.3, margins).collect()
    assert len(out) == 6000
    kept = [r for r in out if r.kept]
    total = sum(r.n_tokens for r in kept)
    assert abs(total / sum(r.n_tokens for r in out) - 0.3) < 0.03
    assert abs(sum(r.n_tokens for r in kept if r.lang == "de") / total - 0.2) < 0.04
    assert abs(sum(r.n_tokens for r in kept if r.source == "src0") / total - 0.5) < 0.04
    again = mixing.sample(documents(rows, parts=5), 0.3, margins)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept)
    assert again.columns == documents(rows).columns


def test_default_margins_sum_to_one(documents):
    df = documents([(i, f"word{i % 3} letters", "en", f"s{i % 5}") for i in range(100)])
    rows = df.select("doc_id", "source", "lang", mixing.topic_and_tokens().alias("t")).selectExpr("source", "lang", "t.topic", "t.n_tokens")
    margins = mixing.smoothed_margins(rows, ["source", "lang", "topic"], least=0.3)
    assert margins.shares["source"] == {mixing.REST: 1.0}
    assert all(abs(sum(s.values()) - 1) < 1e-9 for s in margins.shares.values())


def test_odd_rows(odd):
    out = mixing.mixed(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in ODD_ROWS)
    assert all(r.topic == "none" and r.n_tokens == 0 for r in out if r.doc_id in (2, 3, 5))
    assert mixing.sample(odd).columns == odd.columns


def test_nulls_in_source_and_lang(documents, spark):
    df = documents([(1, "some letters here"), (2, "more letters here")]).selectExpr("doc_id", "text", "CAST(null AS string) lang", "CAST(null AS string) source")
    assert mixing.mixed(df).count() == 2


def test_empty(empty):
    assert mixing.mixed(empty).count() == 0
    assert mixing.sample(empty).count() == 0


def test_too_many_cells(documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    with pytest.raises(ValueError):
        mixing.mixed(documents([(i, "w", "en", f"s{i}") for i in range(5)])).count()


def test_rows_of_one_id_have_lots_of_their_own(documents):
    rows = [(None if i % 3 else 7, f"orchard {i}") for i in range(1500)]
    df = documents(rows)
    out = mixing.mixed(df, 0.5).collect()
    for doc in (None, 7):
        kept = [r.kept for r in out if r.doc_id == doc]
        assert 0.4 < sum(kept) / len(kept) < 0.6
    assert mixing.sample(df, 0.5).count() == sum(r.kept for r in out)
