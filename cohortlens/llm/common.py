"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.runtime import shared_dir

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder that all executors share, and read it back.

    Later jobs start from the files, so neither a lost executor nor a second use of the result
    runs the work before it again.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_rows(docs: DataFrame, keys: dict[str, Column], stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are in ``stay``, one for each, with all their columns.

    ``stay`` has one row per wanted key, in columns named as ``keys``; nulls equal nulls. Of rows
    with the same key the one whose columns have the smallest hash is taken.
    """
    own = {name: free_name(docs, f"__{name}") for name in keys}
    stay = stay.select(*[F.col(name).alias(f"__stay_{name}") for name in keys])
    rows = docs.withColumns({own[name]: col for name, col in keys.items()})
    same = [rows[own[name]].eqNullSafe(stay[f"__stay_{name}"]) for name in keys]
    rows = rows.join(stay, same, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rows.groupBy(*own.values()).agg(F.min_by(whole, F.xxhash64(whole)).alias("__row"))
    return one.select("__row.*")
