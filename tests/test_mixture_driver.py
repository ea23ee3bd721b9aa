"""Densities on the driver take no solve of many right sides, which threads can slow to minutes."""

import numpy as np
import pytest

from cohortlens.clustering import mixture


@pytest.mark.parametrize("form", ["full", "tied"])
def test_densities_are_those_of_the_solve(monkeypatch, form):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * np.logspace(-3, 3, 8)
    cov = np.cov(x.T) + 1e-6 * np.eye(8)
    model = mixture.MixtureModel(np.array([0.3, 0.7]), x[:2], np.stack([cov, 2 * cov]) if form == "full" else cov, form)
    want = []
    for c, s in enumerate(model.covs if form == "full" else [cov, cov]):
        diff = x - x[c]
        quad = (diff * np.linalg.solve(s, diff.T).T).sum(1)
        want.append(np.log(model.weights[c]) - 0.5 * (8 * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + quad))
    monkeypatch.setattr(np.linalg, "solve", lambda *a: pytest.fail("a solve of all rows"))
    assert np.allclose(model.log_densities(x), np.column_stack(want), rtol=1e-9)
