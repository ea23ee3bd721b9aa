"""Shapes of a feature table: wide (one column per feature), vector, and long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def as_double(name: str, dtype: T.DataType) -> Column:
    """Numeric column as double with NaN mapped to NULL (``isNull`` does not see NaN)."""
    c = F.col(name).cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def clean_nan(df: DataFrame) -> DataFrame:
    """Map NaN to NULL in every floating column."""
    cols = [
        as_double(f.name, f.dataType).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema
    ]
    return df.select(*cols)


def to_vector(df: DataFrame, id_col: str, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``id, features array<double>`` plus the columns in ``keep``."""
    return df.select(
        F.col(id_col).alias("id"),
        *keep,
        F.array(*[F.col(c).cast("double") for c in cols]).alias("features"),
    )


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``keys, feature, value`` with one row per cell."""
    kept = [F.col(k) for k in keys]
    typed = df.select(*kept, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(keys), list(cols), "feature", "value")


def vector_to_long(df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """``keys, pos, value`` (and ``feature`` when names are given)."""
    out = df.select(*keys, F.posexplode("features").alias("pos", "value"))
    if names is not None:
        table = F.array(*[F.lit(n) for n in names])
        out = out.withColumn("feature", table[F.col("pos")])
    return out
