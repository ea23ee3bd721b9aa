"""Distance work between two tables, cut into bounded blocks.

Every all-against-some computation in the package (nearest neighbours, distance sums) goes
through :func:`block_pairs`: both sides are split by a hash of the row id into blocks of
at least ``block_rows`` rows *within* their group, so that a group holding a third of all rows
becomes many equal tasks, and one NumPy kernel runs per pair of blocks. Only the kernel's
reduced result leaves a task, never the pairs. A row is copied once per opposite block, so a
side has :data:`MOST_BLOCKS` blocks (more only where a block would pass :data:`BLOCK_BYTES`):
what is shuffled then grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.runtime import small

BLOCK_ROWS = 4096
BROADCAST_BYTES = 32 << 20
CHUNK_CELLS = 2_000_000
#: Blocks of a side, unless they would be larger than this.
MOST_BLOCKS = 16
BLOCK_BYTES = 32 << 20


def matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """List column as a dense matrix; NULL elements become NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # zero chunks
        return np.empty((0, width))
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances. Both sides are moved to the middle of ``y`` first: the expanded
    square would lose its digits where values are large against their differences."""
    if len(y):
        middle = y.mean(0)
        x, y = x - middle, y - middle
    d2 = x @ y.T
    d2 *= 2.0
    np.subtract((x * x).sum(1)[:, None], d2, out=d2)
    d2 += (y * y).sum(1)[None, :]
    return np.maximum(d2, 0.0, out=d2)


def packed(df: DataFrame) -> DataFrame:
    """``block``: the vectors of ``features`` as bytes, many to a row, for loops that read all of
    them in every round and would else turn each vector into a row again."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_pydict({"block": pa.array([flat.tobytes()], pa.binary())})

    return df.select("features").mapInArrow(pack, "block binary")


def matrices(batches, width: int):
    """The vectors of batches of ``features``, or of the blocks of :func:`packed`, as matrices."""
    for batch in batches:
        if batch.schema.names == ["block"]:
            for block in batch.column("block"):
                yield np.frombuffer(block.as_buffer(), float).reshape(-1, width)
        else:
            yield matrix(batch.column("features"), width)


def chunks(n_rows: int, n_cols: int):
    step = max(1, CHUNK_CELLS // max(1, n_cols))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def fits_broadcast(n_rows: int, width: int, limit: int) -> bool:
    return n_rows * (width + 2) * 8 <= limit


def fitting_rows(block_rows: int, width: int) -> int:
    """The most rows of a block."""
    return max(block_rows, BLOCK_BYTES // (8 * (width + 2)))


def n_blocks(rows: int, block_rows: int, width: int) -> int:
    """Blocks that so many rows are cut into."""
    return max(1, min(-(-rows // block_rows), max(MOST_BLOCKS, -(-rows // fitting_rows(block_rows, width)))))


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    group: Sequence[str],
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    width: int = 64,
    right_rows: int | None = None,
) -> DataFrame:
    """Run ``kernel(left block, right block)`` for every pair of blocks of the same group.

    Both sides carry ``id`` and the group columns; a row holds about ``width`` numbers. A row is
    copied once per opposite block of its own group only. ``right_rows``: rows of a right block,
    where they are not ``block_rows``.
    """
    group = list(group)

    def sizes(df: DataFrame, name: str, least: int) -> DataFrame:
        rows, fit = F.count("*"), fitting_rows(block_rows, width)
        return df.groupBy(*group).agg(F.least(F.ceil(rows / least), F.greatest(F.lit(MOST_BLOCKS), F.ceil(rows / fit))).alias(name))

    # fresh column identities: both sides may come from the same table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    blocks = small(sizes(left, "nl", block_rows).join(sizes(right, "nr", right_rows or block_rows), group), len(group))

    def split(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        hashed = F.pmod(F.xxhash64("id", F.lit(7)), F.col(own_n)).cast("int")
        return (
            df.join(blocks, group)
            .withColumn(own, hashed)
            .withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(other_n) - 1).cast("int"))))
            .drop("nl", "nr")
        )

    key = [*group, "lb", "rb"]
    a = split(left, "lb", "nl", "rb", "nr").groupBy(*key)
    b = split(right, "rb", "nr", "lb", "nl").groupBy(*key)
    return a.cogroup(b).applyInArrow(kernel, schema)
