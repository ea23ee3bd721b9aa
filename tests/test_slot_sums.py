"""Distances are added up by rows of the same slots before slots are looked at."""

import numpy as np
import pytest

from cohortlens import validate


@pytest.mark.parametrize("labelings", [2, 40])
def test_sums_by_runs_equal_the_plain_ones(monkeypatch, labelings):
    monkeypatch.setattr(validate, "SUM_TILE", (16, 32))
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 3)) + 1e6, rng.normal(size=(101, 3)) + 1e6
    hots = [np.hstack([np.eye(3)[rng.integers(0, 3, n)] * (rng.random((n, 1)) > 0.1) for _ in range(labelings)]) for n in (70, 101)]
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    one, two = validate._slot_sums(x, y, hots[1], hots[0])
    assert np.allclose(one, d @ hots[1]) and np.allclose(two, d.T @ hots[0])
    assert np.allclose(validate._slot_sums(x, y, hots[1])[0], one) and validate._slot_sums(x, y, hots[1])[1] is None
    assert [len(s) for s in validate._slot_sums(x[:0], y, hots[1], hots[0][:0])] == [0, 101]


def test_few_kinds_of_rows_are_few_columns(monkeypatch):
    """Ninety slots of ten kinds of rows: what is multiplied by slots is ten columns wide, not as many as rows."""
    seen, add = [], np.add

    class Counted:
        @staticmethod
        def reduceat(d, at, axis):
            seen.append(len(at))
            return add.reduceat(d, at, axis=axis)

    kinds = np.arange(1000) % 10
    hot = np.hstack([np.eye(10)[(kinds * m + m) % 10] for m in range(1, 10)])
    x = np.random.default_rng(1).normal(size=(1000, 2))
    monkeypatch.setattr(validate.np, "add", Counted)
    validate._slot_sums(x, x, hot)
    assert seen and max(seen) <= 10
