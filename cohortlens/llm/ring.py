"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells. Every shard owns ``vnodes`` cells, its virtual nodes, at
hashed places; a key belongs to the first virtual node at or after its own cell, clockwise. A
shard takes at most its quota of rows, those nearest before its virtual nodes first; the others
continue clockwise to the next virtual node of a shard that still has room.

Whether a key overflows depends on counts alone. So the driver sees one count per cell (at most
``CELLS`` numbers whatever the input), lets the surplus flow round the ring, and hands back a
plan of at most ``CELLS`` plus ``shards * (shards + 1)`` rank ranges, which is broadcast. Rows are
ranked inside their cell, 1/65536 of the input each, and look their range up. Rows alike in all
that matters here are counted once and spread out again at the end, so that a row repeated many
times does not fill one task.
"""

from __future__ import annotations

import bisect
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import text_or_empty

#: Cells of the ring: bounds what the driver sees and what is broadcast.
CELLS = 1 << 16


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def virtual_nodes(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted ``(cell, shard)`` of all virtual nodes. A shard's do not depend on how many shards
    there are, so a new shard adds nodes and moves none."""
    at = spark.range(shards * vnodes).select(
        (F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("v"))
    at = at.select(_cell(F.concat_ws("/", F.lit("node"), "shard", "v")).alias("cell"), "shard")
    return sorted((r.cell, r.shard) for r in at.collect())


def quotas(rows: int, shards: int, load_factor: float | None) -> list[int]:
    """Rows each shard may take. Without a load factor the quotas add up to all rows, so that
    every shard ends exactly full and no two differ by more than one row."""
    if load_factor is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    return [ceil(load_factor * rows / shards)] * shards


def flow(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each cell go: ``(cell, first_rank, end_rank, shard, first_slot)``.

    Rounds: every cell with rows left asks the next virtual node whose shard has room, and each
    shard says yes to the nearest ones until it is full. A round places every row or fills a
    shard, so there are at most as many rounds as shards, and one more.
    """
    room, taken = list(room), [0] * len(room)
    waiting = {cell: (0, n) for cell, n in counts.items() if n}
    out = []
    while waiting:
        open_nodes = [(cell, shard) for cell, shard in nodes if room[shard] > 0]
        if not open_nodes:
            raise ValueError("the shards have less room than there are rows")
        places = [cell for cell, _ in open_nodes]
        asked: dict[int, list[tuple[int, int]]] = {}
        for cell in waiting:
            place, shard = open_nodes[bisect.bisect_left(places, cell) % len(open_nodes)]
            asked.setdefault(shard, []).append(((place - cell) % CELLS, cell))
        for shard, cells in asked.items():
            for _, cell in sorted(cells):
                if room[shard] == 0:
                    break
                first, end = waiting.pop(cell)
                n = min(room[shard], end - first)
                out.append((cell, first, first + n, shard, taken[shard]))
                taken[shard] += n
                room[shard] -= n
                if first + n < end:
                    waiting[cell] = (first + n, end)
    return out


def place(df: DataFrame, *same: str, key: Column, shards: int, vnodes: int = 128, load_factor: float | None = None) -> DataFrame:
    """Give every row of ``df`` a ``shard`` and a ``slot`` (gapless from 0 inside the shard).

    ``key`` decides a row's place on the ring. The columns ``same`` are returned, with ``shard``
    and ``slot`` after them; rows equal in all of them are interchangeable. Ties in the ring are
    broken by the values of ``same``, nulls first. An empty table gives an empty table.
    """
    keyed = df.select(*same, F.xxhash64(key).alias("__at"), _cell(key).alias("__cell"))
    counts = {r["__cell"]: r["n"] for r in keyed.groupBy("__cell").agg(F.count("*").alias("n")).collect()}
    room = quotas(sum(counts.values()), shards, load_factor)
    plan = flow(counts, virtual_nodes(df.sparkSession, shards, vnodes), room)
    plan = df.sparkSession.createDataFrame(plan, "__cell int, __first bigint, __end bigint, shard int, __slot bigint")

    alike = keyed.groupBy("__cell", "__at", *same).agg(F.count("*").alias("__n"))
    order = Window.partitionBy("__cell").orderBy("__at", *same).rowsBetween(Window.unboundedPreceding, 0)
    ranked = alike.withColumn("__before", F.sum("__n").over(order) - F.col("__n"))
    # a run of equal rows may lie in several ranges of its cell: cut it where they meet
    meets = (F.col("__before") < F.col("__end")) & (F.col("__first") < F.col("__before") + F.col("__n"))
    cut = ranked.join(F.broadcast(plan), "__cell").where(meets)
    low, high = F.greatest("__before", "__first"), F.least(F.col("__before") + F.col("__n"), "__end")
    rank = F.explode(F.sequence(low, high - 1))
    return cut.select(*same, "shard", "__first", "__slot", rank.alias("__rank")).select(
        *same, "shard", (F.col("__slot") + F.col("__rank") - F.col("__first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 128) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``rows``: quotas add up to the number of rows, so that counts are at most one
    apart. A null text counts as none (size 8, crc 0), a null id is placed by its text's crc;
    repeated rows are placed each; other columns are ignored.
    """
    body = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select("doc_id", (F.length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc "), F.col("text_crc32").cast("string")))
    placed = place(rows, "doc_id", "size", "text_crc32", key=key, shards=shards, vnodes=vnodes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
