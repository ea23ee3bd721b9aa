"""Exact k nearest neighbours between two tables, with missing coordinates allowed.

Distance between a query and a donor is ``sqrt(width / present * sum(diff^2))`` over the
coordinates both have; without gaps this is the Euclidean distance. With ``per_gap`` every
missing coordinate of a query is a slot of its own, answered by the nearest donors that
have that coordinate.

A donor side whose size is checked to be small is broadcast and searched in one map.
Otherwise donors are put into cells around sampled pivots (the sample only shapes the cells,
never the result), a query first visits its closest cells, and then every cell whose
bounding box could still hold a closer donor than the k-th found so far. Cells side by side
form bundles; a query is copied once per bundle, with the list of the cells it visits there, and
a task reports the k best of a whole bundle, so that neither queries nor hits grow with the
number of cells where no cell can be left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.blocks import BLOCK_ROWS, BROADCAST_BYTES, CHUNK_CELLS, MOST_BLOCKS, block_pairs, chunks, fits_broadcast, fitting_rows, matrix
from cohortlens.runtime import cut, hash_first, shape, spread


def gap_squared_distances(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing-aware squared distances and the rounding slack of each query row."""
    qm, dm = ~np.isnan(q), ~np.isnan(d)
    qz, dz = np.where(qm, q, 0.0), np.where(dm, d, 0.0)
    qq, dd = qz * qz, dz * dz
    width = q.shape[1]
    if qm.all() and dm.all():
        d2 = qq.sum(1)[:, None] - 2.0 * (qz @ dz.T) + dd.sum(1)[None, :]
    else:
        qf, df = qm.astype(float), dm.astype(float)
        present = qf @ df.T
        d2 = qq @ df.T - 2.0 * (qz @ dz.T) + qf @ dd.T
        with np.errstate(divide="ignore", invalid="ignore"):
            d2 = np.where(present > 0, d2 * width / present, np.inf)
    slack = 1e-13 * width * width * (qq.sum(1) + (dd.sum(1).max() if len(dd) else 0.0))
    return np.where(np.isfinite(d2), np.maximum(d2, 0.0), np.inf), slack


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded to 9 decimals, so that distances equal up to summation order tie by id."""
    diff2 = (a - b) ** 2
    present = (~np.isnan(diff2)).sum(1)
    return np.round(np.sqrt(np.nansum(diff2, axis=1) * a.shape[1] / present), 9)


#: Donors that are screened at once, and the most pairs that may pass of one screen.
TILE = 4096
MOST_PASSING = 1 << 17


def screen_of(d):
    """For donors ``d`` a function from queries, and the most distance for each, to ``(query rows, donor
    rows)`` that hold every pair no farther than that.

    Squares are worked out in single precision, and the limit is widened by its largest rounding
    error. None where that would pass too many pairs, or the numbers are out of its range.
    """
    middle = d.mean(0)
    off = d - middle
    dd = (off * off).sum(1)
    far, width = dd.max(), d.shape[1]
    right = np.column_stack([off, dd]).astype(np.float32)

    def screen(q, most):
        q = q - middle
        qq = (q * q).sum(1)
        if not (far > 1e-25 and qq.max() + far < 1e30):
            return None
        limit = (most + 2e-9) ** 2 + (4 * width + 32) * 2.0**-24 * (qq + far)
        # |q - d|^2 <= limit where 2qd - dd >= qq - limit
        left = np.column_stack([2.0 * q, np.full(len(q), -1.0)]).astype(np.float32)
        floor = (qq - limit).astype(np.float32)[:, None]
        found = [(np.empty(0, int), np.empty(0, int))]
        for at in range(0, len(right), TILE):
            tile = right[at : at + TILE]
            hits = np.flatnonzero(left @ tile.T >= floor)
            if len(hits) > MOST_PASSING:
                return None
            row, col = np.divmod(hits, len(tile))
            found.append((row, col + at))
        return tuple(np.concatenate(c) for c in zip(*found))

    return screen


def top_k(q, qid, d, did, k, per_gap, exclude_self, most=None):
    """``(query row, slot, donor row, distance, rank)`` of the k best donors of each slot.

    ``most``: for each query a distance beyond which no donor is asked for."""
    found = []

    def keep_best(qi, slot, di):
        dist = exact_distance(q[qi], d[di])
        order = np.lexsort((did[di], dist, qi))
        qi, di, dist = qi[order], di[order], dist[order]
        start = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
        rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
        keep = rank < k
        found.append((qi[keep], np.full(keep.sum(), slot), di[keep], dist[keep], rank[keep] + 1))

    def all_pairs(part):
        d2, slack = gap_squared_distances(q[part], d)
        if exclude_self:
            d2[qid[part][:, None] == did[None, :]] = np.inf
        slots = range(q.shape[1]) if per_gap else (-1,)
        for slot in slots:
            if slot < 0:
                rows, cols = np.arange(part.stop - part.start), np.arange(len(d))
            else:
                rows = np.flatnonzero(np.isnan(q[part][:, slot]))
                cols = np.flatnonzero(~np.isnan(d[:, slot]))
            if not len(rows) or not len(cols):
                continue
            sub = d2 if slot < 0 else d2[np.ix_(rows, cols)]
            if len(cols) > k:
                limit = np.partition(sub, k - 1, axis=1)[:, k - 1]
                limit = limit + slack[rows] + 4e-9 * np.sqrt(limit) + 1e-17
            else:
                limit = np.full(len(rows), np.inf)
            qi, di = np.nonzero((sub <= limit[:, None]) & np.isfinite(sub))
            if not len(qi):
                continue
            qi, di = rows[qi] + part.start, cols[di]
            keep_best(qi, slot, di)

    whole = most is not None and not per_gap and len(q) and len(d) and not np.isnan(q).any() and not np.isnan(d).any()
    screen = screen_of(d) if whole else None
    for part in chunks(len(q), min(len(d), TILE)) if whole else [slice(0, len(q))]:
        close = screen(q[part], most[part]) if whole and np.isfinite(most[part]).all() else None
        if close is None:
            for s in chunks(part.stop - part.start, len(d)):
                all_pairs(slice(part.start + s.start, part.start + s.stop))
            continue
        qi, di = close[0] + part.start, close[1]
        if exclude_self:
            other = qid[qi] != did[di]
            qi, di = qi[other], di[other]
        if len(qi):
            keep_best(qi, -1, di)
    if not found:
        return tuple(np.empty(0, t) for t in (int, int, int, float, int))
    return tuple(np.concatenate(c) for c in zip(*found))


def _result(qid, did, d, hit, names) -> pa.Table:
    qi, slot, di, dist, rank = hit
    value = np.where(slot >= 0, d[di, np.maximum(slot, 0)], np.nan) if len(qi) else np.empty(0)
    cols = [qid[qi], slot.astype(np.int32), did[di], dist, value, rank.astype(np.int32)]
    return pa.table(dict(zip(names, [pa.array(c) for c in cols])))


OUT = ("qid", "slot", "id", "dist", "value", "rank")
OUT_SCHEMA = "qid bigint, slot int, id bigint, dist double, value double, rank int"
#: Kinds of gaps of queries that get cells of their own; the others share one set.
GAP_KINDS = 8
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _numbered(queries: DataFrame, donors: DataFrame) -> DataFrame:
    """``name, n``: a number for every id of either table, in the order of the ids."""
    names = queries.select("id").union(donors.select("id")).where("id IS NOT NULL").distinct()
    return cut(names.orderBy("id").select(F.col("id").alias("name"), F.monotonically_increasing_id().alias("n")))


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    k: int,
    group: str | None = None,
    per_gap: bool = False,
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = 2048,
) -> DataFrame:
    """``qid, slot, id, dist, value, rank``: the k nearest donors of every query.

    Both tables have ``id, features array<double>`` and, when ``group`` is given, an
    integer column of that name; a query then only sees donors of its own group. Ties go to
    the smaller donor id. ``slot`` is -1 unless ``per_gap``. Ids that are no whole numbers are
    numbered in their order for the search and named again in the result.
    """
    if dict(queries.dtypes)["id"] not in WHOLE_NUMBERS or dict(donors.dtypes)["id"] not in WHOLE_NUMBERS:
        names = _numbered(queries, donors)

        def number(df: DataFrame) -> DataFrame:
            return df.join(names, df["id"] == names["name"]).drop("id", "name").withColumnRenamed("n", "id")

        hits = nearest(number(queries), number(donors), k, group, per_gap, exclude_self, broadcast_bytes, block_rows, max_pivots)
        asked, found = names.toDF("q_name", "q_n"), names.toDF("d_name", "d_n")
        hits = hits.join(asked, F.col("qid") == F.col("q_n")).join(found, F.col("id") == F.col("d_n"))
        return hits.select(F.col("q_name").alias("qid"), "slot", F.col("d_name").alias("id"), "dist", "value", "rank")
    side = [F.col("id").cast("bigint").alias("id"), "features"]
    grp = F.col(group).cast("int") if group else F.lit(0)
    # both are read several times: what they are made of is worked out once
    alike = queries is donors
    queries = cut(queries.select(*side, grp.alias("g")))
    donors = queries if alike else cut(donors.select(*side, grp.alias("g")))
    n_donors, width = shape(donors)
    if n_donors == 0:
        return queries.sparkSession.createDataFrame([], OUT_SCHEMA)
    if fits_broadcast(n_donors, width, broadcast_bytes):
        return _by_broadcast(queries, donors, k, width, per_gap, exclude_self)
    how = (n_donors, k, width, per_gap, exclude_self, block_rows, max_pivots)
    holes = F.transform("features", lambda v: v.isNull())
    kinds = queries.groupBy(holes.alias("holes")).count().orderBy(F.desc("count"), "holes").limit(GAP_KINDS + 1).collect() if per_gap else []
    if not kinds:
        return _by_cells(queries, donors, *how)
    # cells cut along a coordinate that a query lacks tell it nothing: common kinds of gaps have their own
    found, rest = [], F.lit(True)
    for kind in kinds[:GAP_KINDS]:
        alike = holes == F.array(*[F.lit(h) for h in kind.holes])
        found.append(_by_cells(queries.where(alike), donors, *how, known=~np.array(kind.holes)))
        rest = rest & ~alike
    if len(kinds) > GAP_KINDS:
        found.append(_by_cells(queries.where(rest), donors, *how))
    return reduce(DataFrame.unionByName, found)


def _by_broadcast(queries, donors, k, width, per_gap, exclude_self) -> DataFrame:
    table = donors.toArrow()
    packed = {}
    g_all, id_all = table["g"].to_numpy(), table["id"].to_numpy()
    x_all = matrix(table["features"], width)
    for g in np.unique(g_all):
        packed[int(g)] = (id_all[g_all == g], x_all[g_all == g])
    shared = queries.sparkSession.sparkContext.broadcast(packed)

    def search(batches):
        for batch in batches:
            q, qid = matrix(batch.column("features"), width), batch.column("id").to_numpy()
            g = batch.column("g").to_numpy()
            for one in np.unique(g):
                if int(one) in shared.value:
                    did, d = shared.value[int(one)]
                    rows = g == one
                    hit = top_k(q[rows], qid[rows], d, did, k, per_gap, exclude_self)
                    yield from _result(qid[rows], did, d, hit, OUT).to_batches()

    return spread(queries).mapInArrow(search, OUT_SCHEMA)


def box_bounds(q, lo, hi, never, always):
    """Lower bounds of the squared distance from each query to each cell's bounding box.

    A donor may lack any coordinate that is not observed throughout its cell, so the bound
    is the smallest mean gap over the coordinates that must count plus any of the others.
    """
    width = q.shape[1]
    out = np.empty((len(q), len(lo)))
    known = ~np.isnan(q)
    for c in range(len(lo)):
        gap = np.maximum(np.maximum(lo[c] - q, q - hi[c]), 0.0) ** 2
        must = known & always[c]
        if (always[c] | never[c]).all():
            n = must.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[:, c] = np.where(n > 0, np.where(must, gap, 0.0).sum(1) * width / n, np.inf)
            continue
        free = np.sort(np.where(known & ~always[c] & ~never[c], gap, np.inf), axis=1)
        base, n = np.where(must, gap, 0.0).sum(1), must.sum(1)
        total = np.concatenate([base[:, None], base[:, None] + np.cumsum(free, axis=1)], axis=1)
        count = n[:, None] + np.arange(width + 1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[:, c] = np.where(count > 0, total / count, np.inf).min(1) * width
    return out


def _by_cells(queries, donors, n_donors, k, width, per_gap, exclude_self, block_rows, max_pivots, known=None) -> DataFrame:
    """``known``: the coordinates along which cells are cut (all by default)."""
    spark = queries.sparkSession
    n_cells = int(min(max_pivots, -(-n_donors // block_rows)))
    pivot_rows = hash_first(donors, n_cells, 11, n_donors).toArrow()
    pivots = matrix(pivot_rows["features"], width)
    means = donors.select(F.posexplode("features").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m")).collect()
    fill = np.zeros(width)
    for row in means:
        fill[row.p] = 0.0 if row.m is None else row.m
    known = np.ones(width, bool) if known is None else known
    pivots = np.where(np.isnan(pivots), fill, pivots) * known
    # cells in the order of their widest direction, so that bundles are neighbours
    off = pivots - pivots.mean(0)
    pivots = pivots[np.argsort(off @ np.linalg.eigh(off.T @ off)[1][:, -1], kind="stable")]
    bundles = min(MOST_BLOCKS, len(pivots))

    @F.arrow_udf("int")
    def cell_of(v: pa.Array) -> pa.Array:
        x = matrix(v, width)
        x = np.where(np.isnan(x), fill, x) * known
        near = [((x[s] ** 2).sum(1)[:, None] - 2 * x[s] @ pivots.T + (pivots**2).sum(1)).argmin(1) for s in chunks(len(x), len(pivots))]
        return pa.array(np.concatenate(near).astype(np.int32) if near else np.empty(0, np.int32))

    bundle = F.floor(F.col("cell") * bundles / F.lit(len(pivots))).cast("int").alias("bundle")
    donors = cut(donors.withColumn("cell", cell_of("features")).select("*", bundle))
    # at most (groups x pivots x width) rows: the shape of the cells, not the data
    boxes = (
        donors.select("g", "cell", F.posexplode("features").alias("p", "v"))
        .groupBy("g", "cell", "p")
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("seen"), F.count("*").alias("n"))
        .toPandas()
    )
    cells = {}
    for g, part in boxes.groupby("g"):
        ids = np.sort(part["cell"].unique())

        def grid(col, part=part, ids=ids):
            return part.pivot(index="cell", columns="p", values=col).reindex(index=ids).to_numpy(float)

        seen, n = grid("seen"), grid("n")
        cells[int(g)] = (ids, np.where(seen > 0, grid("lo"), 0.0), np.where(seen > 0, grid("hi"), 0.0), seen == 0, seen == n, n[:, 0])
    shared = spark.sparkContext.broadcast(cells)
    need = k + int(exclude_self)

    def visits(first: bool):
        def run(batches):
            most = max(len(c[0]) for c in shared.value.values())
            for batch in (b.slice(s.start, s.stop - s.start) for b in batches for s in chunks(b.num_rows, most)):
                x, g = matrix(batch.column("features"), width), batch.column("g").to_numpy()
                ub = None if first else batch.column("ub").to_numpy(zero_copy_only=False)
                for one in np.unique(g):
                    if int(one) not in shared.value:
                        continue
                    ids, lo, hi, never, always, n = shared.value[int(one)]
                    rows = np.flatnonzero(g == one)
                    bound = box_bounds(x[rows], lo, hi, never, always)
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    start = np.zeros(bound.shape, bool)
                    np.put_along_axis(start, order, before < need, axis=1)
                    if first:
                        take = start
                    else:
                        # a bound that reaches the k-th distance up to rounding is still visited
                        take = ~start & np.isfinite(bound) & (bound * (1 - 1e-9) <= (ub[rows][:, None] + 2e-9) ** 2)
                    r, c = np.nonzero(take)
                    if not len(r):
                        continue
                    b = ids[c] * bundles // len(pivots)
                    # a row's cells ascend, so its bundles do: one list for each
                    heads = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(b) != 0)])
                    src = batch.take(pa.array(rows[r[heads]]))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(r)].astype(np.int32)), pa.array(ids[c].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [src.column("id"), src.column("features"), src.column("g"), pa.array(b[heads].astype(np.int32)), lists,
                         pa.array(np.full(len(heads), np.inf) if first else ub[rows[r[heads]]])],
                        names=["id", "features", "g", "bundle", "cells", "ub"],
                    )

        return run

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        q, d = matrix(left["features"], width), matrix(right["features"], width)
        qid, did, most = left["id"].to_numpy(), right["id"].to_numpy(), left["ub"].to_numpy()
        asked, held = left["cells"].combine_chunks(), right["cell"].to_numpy()
        wanted, row = asked.flatten().to_numpy(), np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy())
        here = np.unique(held)
        there = np.isin(wanted, here)
        wanted, row = wanted[there], row[there]
        if len(wanted) == len(q) * len(here):  # everyone asks for every cell
            return _result(qid, did, d, top_k(q, qid, d, did, k, per_gap, exclude_self, most), OUT)
        by_cell, by_held = np.argsort(wanted, kind="stable"), np.argsort(held, kind="stable")
        wanted, row, held = wanted[by_cell], row[by_cell], held[by_held]
        found, held_back, settled = [], 0, 0

        def best_of(hits):
            qi, slot, di, dist, _ = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((did[di], dist, slot, qi))
            qi, slot, di, dist = qi[order], slot[order], di[order], dist[order]
            start = np.flatnonzero(np.r_[True, (np.diff(qi) != 0) | (np.diff(slot) != 0)]) if len(qi) else np.empty(0, int)
            rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
            keep = rank < k
            return qi[keep], slot[keep], di[keep], dist[keep], rank[keep] + 1

        for cell in here:
            rows = row[np.searchsorted(wanted, cell) : np.searchsorted(wanted, cell, "right")]
            cols = by_held[np.searchsorted(held, cell) : np.searchsorted(held, cell, "right")]
            if len(rows):
                qi, slot, di, dist, rank = top_k(q[rows], qid[rows], d[cols], did[cols], k, per_gap, exclude_self, most[rows])
                found.append((rows[qi], slot, cols[di], dist, rank))
                held_back += len(qi)
            if held_back > CHUNK_CELLS + 2 * settled:  # hits of many cells: only the best go on
                found = [best_of(found)]
                held_back = settled = len(found[0][0])
        if not found:
            return _result(qid, did, d, top_k(q[:0], qid[:0], d, did, k, per_gap, exclude_self), OUT)
        return _result(qid, did, d, best_of(found), OUT)

    visit_schema = "id bigint, features array<double>, g int, bundle int, cells array<int>, ub double"
    best = Window.partitionBy("qid", "slot").orderBy("dist", "id")

    def merged(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def search(visited: DataFrame) -> DataFrame:
        # a bundle's donors stay together while they fit a block: a query is copied once per bundle
        return block_pairs(cut(visited), donors, ["g", "bundle"], kernel, OUT_SCHEMA, block_rows, width, fitting_rows(block_rows, width))

    early = cut(merged(search(spread(queries).mapInArrow(visits(True), visit_schema))))
    per_slot = early.groupBy("qid", "slot").agg(F.max("dist").alias("far"), F.count("*").alias("c"))
    reach = per_slot.groupBy("qid").agg(
        F.max(F.when(F.col("c") < k, F.lit(float("inf"))).otherwise(F.col("far"))).alias("ub"), F.count("*").alias("slots")
    )
    # a slot that has found no donor yet keeps its query open to every cell
    gaps = F.size(F.filter("features", lambda v: v.isNull())) if per_gap else F.lit(1)
    with_reach = queries.join(reach, queries["id"] == reach["qid"], "left").select(
        "id", "features", "g",
        F.when(F.coalesce("slots", F.lit(0)) < gaps, F.lit(float("inf"))).otherwise(F.col("ub")).alias("ub"),
    )
    late = search(spread(with_reach).mapInArrow(visits(False), visit_schema))
    return merged(early.unionByName(late))
