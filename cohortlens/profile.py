"""Descriptive profile of a table: one pass per report, all columns together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.features import as_double, numeric_columns, to_long
from cohortlens.quantiles import group_quantiles


def _null_flag(field: T.StructField):
    c = F.col(field.name)
    gone = c.isNull()
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        gone = gone | F.isnan(c)
    return gone.cast("int")


def overview(df: DataFrame, not_features: int = 0) -> DataFrame:
    """Rows, features and share of missing cells, in one aggregate."""
    cells = len(df.columns)
    gaps = reduce(lambda a, b: a + b, [_null_flag(f) for f in df.schema])
    agg = df.agg(F.count("*").alias("n_rows"), F.sum(gaps).alias("gaps"))
    return agg.select(
        "n_rows",
        F.lit(cells - not_features).cast("bigint").alias("n_features"),
        (F.coalesce("gaps", F.lit(0)) / F.nullif(F.col("n_rows") * cells, F.lit(0)) * 100).alias("missing_pct"),
    )


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact_limit: int = 1_000_000) -> DataFrame:
    """Count, mean, std, min, quartiles and max of every numeric column."""
    cols = list(cols or numeric_columns(df))
    typed = df.select(*[as_double(c, df.schema[c].dataType).alias(c) for c in cols])
    long = to_long(typed, [], cols)
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quart = group_quantiles(long, ["feature"], [0.25, 0.5, 0.75], exact_limit=exact_limit)
    return base.join(F.broadcast(quart), "feature", "left").select(
        "feature", "count", "mean", "std", "min",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max",
    )


def missing_table(df: DataFrame) -> DataFrame:
    """Columns that have gaps, with their number and percentage (2 dp)."""
    sums = df.agg(F.count("*").alias("__n"), *[F.sum(_null_flag(f)).alias(f.name) for f in df.schema])
    long = sums.unpivot(["__n"], df.columns, "feature", "missing").where("missing > 0")
    return long.select("feature", "missing", F.round(F.col("missing") / F.col("__n") * 100, 2).alias("percentage"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, value, n``; values as text so that all columns share one shuffle."""
    typed = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = typed.unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column; ties by value."""
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return value_counts(df, cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, share of zeros and negatives, sample skewness and excess kurtosis."""
    cols = list(cols or numeric_columns(df))
    typed = df.select(*[as_double(c, df.schema[c].dataType).alias(c) for c in cols])
    counted = to_long(typed, [], cols).where("value IS NOT NULL")
    # distinct values first: the moments of a column then follow from (value, n) pairs
    pairs = counted.groupBy("feature", "value").agg(F.count("*").alias("n"))
    distinct = pairs.groupBy("feature").agg(
        F.count("*").alias("n_distinct"),
        (F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("zero_pct"),
        (F.sum(F.when(F.col("value") < 0, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("negative_pct"),
    )
    shape = counted.groupBy("feature").agg(
        F.count("*").cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    )
    n = F.col("n")
    return distinct.join(F.broadcast(shape), "feature").select(
        "feature", "n_distinct", "zero_pct", "negative_pct",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over their complete rows."""
    cols = list(cols or numeric_columns(df))
    typed = df.select(*[as_double(c, df.schema[c].dataType).alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    row = typed.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def preview(df: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    return df.orderBy(id_col).limit(n)
