"""Nearest-neighbour imputation and the choice of its k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.blocks import BLOCK_ROWS, BROADCAST_BYTES
from cohortlens.neighbors import nearest
from cohortlens.runtime import cut

N_SAMPLE_CELLS = 100
K_RANGE = range(2, 16)


def _vectors(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.array(*cols).alias("features"))


def knn_impute(
    df: DataFrame,
    donors: DataFrame,
    id_col: str,
    cols: Sequence[str],
    k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill gaps in ``cols`` with the plain mean of the k nearest donors that have the cell.

    A row without gaps is never searched, shuffled or sent to Python. A cell without a
    comparable donor takes the donors' column mean.
    """
    cols = list(cols)
    alike = df is donors
    df = cut(df)  # read several times, as are the donors
    donors = df if alike else cut(donors)
    any_gap = F.exists(F.array(*cols), lambda v: v.isNull())
    whole, holed = df.where(~any_gap), df.where(any_gap)
    if holed.limit(1).count() == 0:
        return df
    means = donors.agg(*[F.avg(c).alias(c) for c in cols]).first()
    # a row is not its own donor: it lacks the very cell that is asked for
    hits = nearest(
        _vectors(holed, id_col, cols), _vectors(donors, id_col if id_col in donors.columns else "id", cols), k,
        per_gap=True, broadcast_bytes=broadcast_bytes, block_rows=block_rows,
    )
    by_row = (
        hits.where(F.col("rank") <= k).groupBy("qid", "slot").agg(F.avg("value").alias("m"))
        .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("fills"))
    )
    joined = holed.join(by_row, holed[id_col] == by_row["qid"], "left")
    filled = [
        F.coalesce(F.col(c), F.col("fills")[F.lit(cols.index(c))], F.lit(means[c])).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ]
    return whole.unionByName(joined.select(*filled))


def knn_k_search(
    df: DataFrame,
    id_col: str,
    cols: Sequence[str],
    ks: Sequence[int] = K_RANGE,
    n_cells: int = N_SAMPLE_CELLS,
    cell_order=None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``k, mse``: hide observed cells, impute each from the rest, for every k at once.

    The hidden cells are the first by a hash of (id, column), so they are spread over the
    whole table. Donors are ranked once to the largest k; a running mean over the ranks
    gives all smaller k.
    """
    cols = list(cols)
    long = df.select(F.col(id_col).alias("id"), F.posexplode(F.array(*cols)).alias("slot", "truth")).where("truth IS NOT NULL")
    order = F.xxhash64("id", "slot", F.lit(42)) if cell_order is None else cell_order
    # numbered once and kept: a number for each of the few hidden cells
    picked = cut(long.orderBy(order, "id", "slot").limit(n_cells)).withColumn("cell", F.monotonically_increasing_id())
    picked = cut(picked)
    rows = picked.join(_vectors(df, id_col, cols), "id")
    kmax = max(ks)
    # the hidden cell is asked for; the row itself must not answer for it
    hidden = rows.select(
        "id", "slot", "truth", "cell",
        F.transform("features", lambda v, i: F.when(i == F.col("slot"), F.lit(None)).otherwise(v)).alias("features"),
    )
    asked = hidden.select(F.col("cell").alias("id"), "features")
    hits = nearest(asked, _vectors(df, id_col, cols), kmax + 1, per_gap=True, broadcast_bytes=broadcast_bytes)
    pairs = hits.join(F.broadcast(hidden.select("cell", F.col("id").alias("own"), F.col("slot").alias("wanted"), "truth")), hits["qid"] == F.col("cell"))
    pairs = pairs.where((F.col("slot") == F.col("wanted")) & (F.col("id") != F.col("own")))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "id"))).where(F.col("r") <= kmax)
    run = Window.partitionBy("cell").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("guess", F.avg("value").over(run)).withColumn("have", F.max("r").over(Window.partitionBy("cell")))
    # with fewer donors than k the mean of all of them stands for every larger k
    per_k = ranked.select("truth", "guess", "r", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"), "have").where(
        F.least(F.col("k"), F.col("have")) == F.col("r")
    )
    return per_k.groupBy("k").agg(F.avg((F.col("truth") - F.col("guess")) ** 2).alias("mse"))


def best_k(scores: DataFrame) -> DataFrame:
    return scores.orderBy("mse", "k").limit(1)
