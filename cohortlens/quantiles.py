"""Exact interpolated quantiles per group.

``percentile`` keeps every distinct value of a group in one buffer, which is right for
small groups only. Past ``exact_limit`` rows the same order statistics are found by
repeated histogram narrowing: each pass is one map-side-combined aggregate over at most
``bins`` buckets per wanted rank, until the bucket holding the rank is a single value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.runtime import cut, small


def group_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    value: str = "value",
    exact_limit: int = 1_000_000,
    bins: int = 1024,
) -> DataFrame:
    """``keys, q array<double>``: linear-interpolated quantiles of ``value`` per group."""
    keys = list(keys)
    data = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))  # neither infinite nor NaN
    sizes = data.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"),
        F.count_if(F.col("v") == float("-inf")).alias("below"), F.count(finite).alias("within"),
        F.count_if(F.col("v") == float("inf")).alias("above"),
    )
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= exact_limit:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return data.groupBy(*keys).agg(F.percentile("v", wanted).alias("q"))
    return _by_narrowing(data, sizes, keys, probs, bins)


def _by_narrowing(data, sizes, keys, probs, bins) -> DataFrame:
    # one row per (group, order statistic): rank counts rows below it inside [lo, hi]; ranks
    # that fall on infinities (and on NaN, which sorts last) are known at once
    pos = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    spots = sizes.select("*", pos.alias("t")).select(
        *keys, "lo", "hi", "below", "within", "above", "t.i", (F.col("t.p") * (F.col("n") - 1)).alias("h")
    )
    spots = spots.select("*", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("rank0")).distinct()
    rank = F.col("rank0") - F.col("below")
    fixed = (
        F.when(rank < 0, float("-inf")).when(rank < F.col("within"), None)
        .when(rank < F.col("within") + F.col("above"), float("inf")).otherwise(float("nan"))
    )
    spots = spots.select(
        *keys, F.coalesce(fixed, "lo").alias("lo"), F.coalesce(fixed, "hi").alias("hi"), "i", "h", "rank0", rank.alias("rank")
    )
    spots = cut(spots)
    # halves: the range of doubles itself may be no double
    width = (F.col("hi") / 2 - F.col("lo") / 2) / bins
    share = F.when(width > 0, (F.col("v") / 2 - F.col("lo") / 2) / width).otherwise(F.when(F.col("v") > F.col("lo"), bins - 1).otherwise(0))
    bucket = F.least(F.floor(share), F.lit(bins - 1))
    while spots.where("hi > lo").limit(1).count() > 0:
        open_, done = spots.where("hi > lo"), spots.where("hi = lo")
        hist = (
            data.join(small(open_, len(keys) + 6), [*keys])
            .where(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy(*keys, "i", "h", "rank0", "rank", bucket.alias("b"))
            .agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        run = Window.partitionBy(*keys, "i", "rank0").orderBy("b")
        hist = hist.withColumn("below", F.sum("c").over(run) - F.col("c"))
        step = hist.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("c")))
        step = step.withColumn("rank", F.col("rank") - F.col("below"))
        spots = cut(done.unionByName(step.select(*done.columns)))
    both = spots.groupBy(*keys, "i").agg(
        F.min("lo").alias("a"), F.max("lo").alias("b"), F.first("h").alias("h")
    )
    part = F.col("h") - F.floor("h")
    val = F.when((part == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    rows = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", val.alias("x")))).alias("s"))
    return rows.select(*keys, F.transform("s", lambda s: s["x"]).alias("q"))
