"""Exact density clustering against a brute-force reading of the same definitions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.blocks import squared_distances
from cohortlens.clustering import condensed, density
from tests.conftest import frame

ZERO = condensed.LAMBDA_OF_ZERO

#: A whole exact fit is some hundreds of checkpointed Spark jobs: minutes on one machine.
slow = pytest.mark.skipif(not os.environ.get("COHORTLENS_SLOW"), reason="whole exact fits: set COHORTLENS_SLOW=1")


def brute(x, core, mcs):
    """Labels (numbered by their smallest id) and the merges of the Kruskal tree."""
    n = len(x)
    d = np.maximum(np.sqrt(squared_distances(x, x)), np.maximum(core[:, None], core[None, :])).round(9)
    pairs = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    tree = []
    for w, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            tree.append((w, i, j))
    # Kruskal tree: node ids 0..n-1 points, n + r the r-th merge
    owner = list(range(n))  # union-find over points -> current tree node
    uf = list(range(n))

    def top(i):
        while uf[i] != i:
            i = uf[i]
        return i

    kids, size, weight, parent = {}, {i: 1 for i in range(n)}, {}, {}
    for r, (w, i, j) in enumerate(tree):
        a, b = owner[top(i)], owner[top(j)]
        node = n + r
        kids[node], weight[node] = (a, b), w
        size[node] = size[a] + size[b]
        parent[a] = parent[b] = node
        uf[top(i)] = top(j)
        owner[top(j)] = node
    lam = lambda w: 1 / w if w > 0 else ZERO
    # condensed tree
    starts = {m for m in kids if m not in parent or all(size[k] >= mcs for k in kids[parent[m]])}
    home = {}
    for m in sorted(kids, reverse=True):
        home[m] = m if m in starts else home[parent[m]]
    stab, up = {}, {}
    for c in starts:
        birth = lam(weight[parent[c]]) if c in parent else 0.0
        stab[c] = -birth * size[c]
        up[c] = home[parent[c]] if c in parent else None
    for m in kids:
        s1, s2 = (size[k] for k in kids[m])
        split = s1 >= mcs and s2 >= mcs
        leaving = s1 + s2 if split else (s1 if s1 < mcs else 0) + (s2 if s2 < mcs else 0)
        stab[home[m]] += leaving * lam(weight[m])
    children = {c: [k for k in starts if up[k] == c] for c in starts}

    best, own = {}, {}

    def solve(c):
        kids_best = sum(solve(k) for k in children[c]) if children[c] else None
        own[c] = up[c] is not None and (kids_best is None or stab[c] >= kids_best)
        best[c] = stab[c] if own[c] or kids_best is None else kids_best
        return best[c]

    label = {}

    def mark(c, above):
        label[c] = above if above is not None else (c if own[c] else None)
        for k in children[c]:
            mark(k, label[c])

    for c in starts:
        if up[c] is None:
            solve(c)
            mark(c, None)
    point = [label.get(home[parent[i]]) if i in parent else None for i in range(n)]
    first = {}
    for i, c in enumerate(point):
        if c is not None:
            first.setdefault(c, i)
    number = {c: k for k, c in enumerate(sorted(first, key=first.get))}
    return [number[c] if c is not None else -1 for c in point], tree


def check(spark, x, mcs, ms, **how):
    df = frame(spark, x)
    model = condensed.exact_hdbscan_fit(df, mcs, ms, **how)
    got = {r.id: r.cluster for r in model.labels.collect()}
    core = {r.id: r.core for r in model.train.collect()}
    want, tree = brute(x, np.array([core[i] for i in range(len(x))]), mcs)
    assert [got[i] for i in range(len(x))] == want
    return model, tree


@slow
def test_random_points_with_ties(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (14, 2)), rng.normal(5, 0.5, (12, 2)), rng.uniform(-8, 12, (6, 2))]).round(1)
    x = np.concatenate([x, x[:4]])  # repeated rows: zero distances and equal cores
    model, tree = check(spark, x, 4, 3)
    assert len({c for c in model.labels.toPandas().cluster if c >= 0}) >= 2


def test_spanning_tree_is_the_minimum_one(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (60, 2)).astype(float)  # many equal distances
    df = frame(spark, x)
    core = density.core_distances(df.select("id", "features"), 3)
    got = sorted((r.weight, r.src, r.dst) for r in condensed.spanning_tree(df.select("id", "features"), core).collect())
    c = {r.id: r.core for r in core.collect()}
    _, tree = brute(x, np.array([c[i] for i in range(len(x))]), 3)
    assert got == sorted((float(w), i, j) for w, i, j in tree)


@slow
@pytest.mark.parametrize("how", [{"broadcast_bytes": 0, "block_rows": 16}])
def test_blocks_and_sizes(spark, how):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.2, (12, 3)), rng.normal(3, 0.2, (10, 3)), rng.normal(-3, 1.5, (4, 3))])
    check(spark, x, 4, 3, **how)


def test_kruskal_tree_of_a_path(spark):
    # a path whose weights rise: one merge after another, the deepest tree there is
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") * 1.0 + 1).alias("weight"))
    merges, leaves = condensed.kruskal_tree(edges, spark.range(41))
    rows = {r.rank: r for r in merges.collect()}
    assert all(rows[r].size == r + 2 and rows[r].parent == (r + 1 if r < 39 else None) for r in range(40))
    first = {r.id: r.parent for r in leaves.collect()}
    assert first[0] == 0 and all(first[i] == i - 1 for i in range(1, 41))


def test_single_row_and_empty(spark):
    one = frame(spark, np.array([[1.0, 2.0]]))
    assert [r.cluster for r in condensed.exact_hdbscan_fit(one, 5).labels.collect()] == [-1]
