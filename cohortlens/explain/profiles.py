"""Cluster profiles and what sets a cluster apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.features import to_long
from cohortlens.quantiles import group_quantiles


def profile_stats(df: DataFrame, cols, cluster: str = "cluster", exact_limit: int = 1_000_000) -> DataFrame:
    """``cluster, feature, mean, median, std``."""
    long = to_long(df, [cluster], cols)
    base = long.groupBy(cluster, "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    mid = group_quantiles(long, [cluster, "feature"], [0.5], exact_limit=exact_limit)
    return base.join(mid, [cluster, "feature"], "left").select(cluster, "feature", "mean", F.col("q")[0].alias("median"), "std")


def contrastive(df: DataFrame, cols, cluster: str = "cluster") -> DataFrame:
    """``cluster, feature, difference, effect_size``: cluster mean minus global mean, and
    that over the global sample std.

    The global moments are merged from the clusters' moments, so the rows are read once.
    """
    long = to_long(df, [cluster], cols).where("value IS NOT NULL")
    per = long.groupBy(cluster, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    w = Window.partitionBy("feature")
    total = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / total
    per = per.withColumn("total", total).withColumn("grand", grand)
    ss = F.sum(F.col("n") * (F.col("var") + (F.col("mean") - F.col("grand")) ** 2)).over(w)
    std = F.sqrt(ss / F.nullif(F.col("total") - 1, F.lit(0)))
    diff = F.col("mean") - F.col("grand")
    return per.select(cluster, "feature", diff.alias("difference"), (diff / F.nullif(std, F.lit(0.0))).alias("effect_size"))


def radar(profile: DataFrame, axis: str = "cluster", value: str = "mean") -> DataFrame:
    """Profile values scaled to 0..1 within each cluster or within each feature."""
    if axis not in ("cluster", "feature"):
        raise ValueError(f"unknown axis {axis}")
    w = Window.partitionBy(axis)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    unit = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)
    return profile.select("cluster", "feature", unit.alias("value"))
