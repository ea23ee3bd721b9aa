import random
from collections import Counter

import numpy as np

from cohortlens.llm import weak_quality as wq
from tests.llm.conftest import ODD_ROWS


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    n = 40_000
    kind = rng.choice(3, n, p=[0.7, 0.2, 0.1])  # good, and two faults
    says_bad = np.array([[0.01, 0.015, 0.02, 0.01, 0.015], [0.9, 0.8, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.9, 0.6]])
    votes = np.where(rng.random((n, 5)) < says_bad[kind], -1, 1) * (rng.random((n, 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = wq.estimate(patterns.astype(float), counts.astype(float))
    assert abs(got.shares[0] - 0.7) < 0.05
    assert np.allclose(got.right_on_good(), 1 - says_bad[0], atol=0.01)
    assert np.allclose(got.right_on_bad(), (2 * says_bad[1] + says_bad[2]) / 3, atol=0.1)
    right = np.mean((got.posterior(votes.astype(float)) > 0.5) == (kind == 0))
    # as good as with the true accuracies, and better than the majority of votes
    best = np.mean((wq.Accuracies(np.array([0.7, 0.2, 0.1]), says_bad).posterior(votes.astype(float)) > 0.5) == (kind == 0))
    assert right > best - 0.015 and right > np.mean((votes.sum(axis=1) > 0) == (kind == 0)) + 0.1


def test_faults_that_one_heuristic_sees():
    rng = np.random.default_rng(1)
    n = 20_000
    fault = rng.choice(4, n, p=[0.85, 0.05, 0.05, 0.05])  # 0 is good
    votes = np.where(rng.random((n, 3)) < 0.005, -1, 1)
    for k in (1, 2, 3):
        votes[fault == k, k - 1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = wq.estimate(patterns.astype(float), counts.astype(float)).posterior(votes.astype(float))
    assert np.mean((got > 0.5) == (fault == 0)) > 0.98


def text(rng, good):
    if good:
        words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300))]
        return " ".join(w + (". " if i % 12 == 11 else "") for i, w in enumerate(words))
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(["buy", "now", "$$$", "%%%", "###"]) for _ in range(80))
    if kind == 1:
        return "click here\n" * 40
    return " ".join(str(rng.randrange(10**9)) for _ in range(70))


def test_bad_texts_score_low(documents):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 5 > 0)) for i in range(500)]
    got = {r.doc_id: r for r in wq.scored(documents(rows)).collect()}
    assert len(got) == 500
    right = [got[i].kept == (i % 5 > 0) for i, _ in rows]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and len(r.pattern) == len(wq.LABELLERS) for r in got.values())


def test_odd_rows(odd):
    got = wq.scored(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD_ROWS)
    assert all(0 <= r.score <= 1 for r in got)


def test_empty(empty):
    assert wq.scored(empty).count() == 0
