"""What must not grow with the square of the rows, or with the rounds of a loop."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens import neighbors, validate
from cohortlens.blocks import MOST_BLOCKS, block_pairs, n_blocks, packed
from cohortlens.clustering import density, merging, mixture, partition
from cohortlens.neighbors import nearest
from tests.conftest import frame


def test_blocks_of_a_side_do_not_grow_with_the_rows(spark):
    assert n_blocks(100, 64, 64) == 2 and n_blocks(0, 64, 64) == 1
    assert n_blocks(100_000, 64, 64) == MOST_BLOCKS == n_blocks(600_000, 64, 64)
    rows = spark.range(1000).withColumn("g", F.lit(0))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table({"l": [left.num_rows], "r": [right.num_rows]})

    pairs = block_pairs(rows, rows, ["g"], count, "l bigint, r bigint", block_rows=4).collect()
    assert len(pairs) <= MOST_BLOCKS**2  # 250 blocks a side before
    assert sum(p.l * p.r for p in pairs) == 1000 * 1000


def test_block_sums_equal_the_broadcast_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    df = frame(spark, x, rng.integers(-1, 3, 300))
    labels = validate.one_method(df)
    near, far = ({r.id: r.silhouette for r in validate.silhouette_points(df, labels, **how).collect()} for how in ({}, {"broadcast_bytes": 0, "block_rows": 8}))
    assert near.keys() == far.keys() and np.allclose([near[i] for i in near], [far[i] for i in near])


def test_cells_in_bundles_find_what_the_broadcast_finds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>").repartition(3)
    for gaps in (False, True):
        one, two = (sorted(map(tuple, nearest(df, df, 4, per_gap=gaps, exclude_self=True, **how).drop("value").collect()))
                    for how in ({}, {"broadcast_bytes": 0, "block_rows": 8}))
        assert one == two and one


def test_queries_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def told(i):
        seen.add(1)
        return i

    df = frame(spark, np.random.default_rng(1).normal(size=(200, 3))).withColumn("id", told("id"))
    assert nearest(df, df, 3, exclude_self=True, broadcast_bytes=0, block_rows=16).count() == 600
    assert seen.value == 200


def test_train_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(i):
        seen.add(1)
        return 0.1

    x = np.random.default_rng(1).normal(size=(100, 3))
    train = frame(spark, x, np.zeros(100)).withColumn("core", told("id"))
    births = spark.createDataFrame([(0, 100.0)], "cluster int, birth double")
    got = density.density_assign(frame(spark, x[:20]), train, births, 5).collect()
    assert len(got) == 20 and {r.cluster for r in got} == {0}
    assert seen.value == 100


def _size(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_estimates_do_not_grow_with_the_rounds(spark):
    path = spark.range(40).select(F.lit(0).alias("level"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = density.components(path, spark.range(41).select(F.lit(0).alias("level"), "id"))
    assert {r.comp for r in found.collect()} == {0}
    assert _size(found) < 1 << 40
    clusters, member, _ = merging.ward_rounds(frame(spark, np.random.default_rng(2).normal(size=(40, 3))), 3, 12)
    assert clusters.count() <= 12 and member.count() == 40
    assert _size(clusters) < 10 ** 400  # linear in the digits; it doubled them every round


def test_passes_over_packed_vectors_give_the_same_sums(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 3))
    df = frame(spark, x)
    blocks = packed(df)
    assert blocks.columns == ["block"] and blocks.count() <= 3  # a row for each vector before
    centers = [x[:4], x[10:12]]
    for one, two in zip(partition._cluster_sums(df, centers), partition._cluster_sums(blocks, centers)):
        assert np.array_equal(one.round(9), two.round(9))
    model = mixture._start(x[:2], x.var(0), "full")
    assert np.array_equal(mixture.e_pass(df, [model])[0].round(9), mixture.e_pass(blocks, [model])[0].round(9))


def test_queries_with_a_gap_have_cells_of_what_they_know(spark, monkeypatch):
    """A coordinate that a query lacks, however wide, does not decide which donors share a cell."""
    visited, pairs = [], neighbors.block_pairs

    def counted(left, right, *how):
        visited.append(left.agg(F.sum(F.size("cells"))).first()[0] or 0)
        return pairs(left, right, *how)

    monkeypatch.setattr(neighbors, "block_pairs", counted)
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3)) * [1e6, 1e3, 1.0]
    rows = [(i, [None if i % 10 == 0 else a, None if i % 50 == 1 else b, c]) for i, (a, b, c) in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "id bigint, features array<double>")
    asked = df.where("id % 10 = 0 or id % 50 = 1")
    want = nearest(asked, df, 3, per_gap=True).orderBy("qid", "slot", "rank").collect()
    got = nearest(asked, df, 3, per_gap=True, broadcast_bytes=0, block_rows=30).orderBy("qid", "slot", "rank").collect()
    assert got == want and len(got) == 3 * 360
    assert sum(visited) < 0.25 * 360 * 100  # nearly all of the 100 cells for each of 300 queries before


def test_more_kinds_of_gaps_than_have_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "GAP_KINDS", 1)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")
    near, far = (sorted(map(tuple, nearest(df, df, 2, per_gap=True, **how).collect())) for how in ({}, {"broadcast_bytes": 0, "block_rows": 20}))
    assert near == far and near


def test_a_query_is_copied_once_per_bundle(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.normal(size=(600, 6)))
    copies = []

    def counted(left, right, group, kernel, schema, *how):
        def count(a: pa.Table, b: pa.Table) -> pa.Table:
            return pa.table({"l": [a.num_rows]})

        copies.append((left.count(), sum(r.l for r in block_pairs(left, right, group, count, "l bigint", *how).collect())))
        return block_pairs(left, right, group, kernel, schema, *how)

    monkeypatch.setattr(neighbors, "block_pairs", counted)
    far = nearest(df, df, 3, exclude_self=True, broadcast_bytes=0, block_rows=8).collect()
    assert len(copies) == 2 and all(came == sent for sent, came in copies)  # 5 blocks of donors a bundle before
    near = nearest(df, df, 3, exclude_self=True).collect()
    assert {(r.qid, r.id, r.rank, r.dist) for r in far} == {(r.qid, r.id, r.rank, r.dist) for r in near}


def test_screened_neighbours_are_the_nearest(monkeypatch):
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=(300, 8)), rng.normal(size=(300, 8)) * 1e-3 + 1e6, rng.normal(size=(300, 8)) * 1e-20, np.repeat(rng.normal(size=(30, 8)), 10, axis=0)):
        ids = rng.permutation(300)
        plain = neighbors.top_k(x, ids, x, ids, 4, False, True)
        most = np.zeros(300)
        np.maximum.at(most, plain[0], plain[3])
        for got in (neighbors.top_k(x, ids, x, ids, 4, False, True, most), neighbors.top_k(x, ids, x, ids, 4, False, True, most * 1.5)):
            order, want = np.lexsort((got[4], got[0])), np.lexsort((plain[4], plain[0]))
            assert all((g[order] == p[want]).all() for g, p in zip(got, plain))
    x = rng.normal(size=(300, 8))
    row, col = neighbors.screen_of(x)(x[:5], np.full(5, 2.0))
    near = np.sqrt(((x[:5, None] - x[None]) ** 2).sum(2)) <= 2.0
    assert set(zip(*np.nonzero(near))) <= set(zip(row, col)) and len(row) < 10 * near.sum()
