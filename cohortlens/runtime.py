"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "cohortlens", cores: int | str = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("COHORTLENS_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COHORTLENS_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # rounds that are over free their files
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for state that must outlive an executor.

    It is the one the cluster names in ``spark.checkpoint.dir``; a private one is made only
    where none is named and everything runs in one process, as in tests. Elsewhere a folder of
    this machine would lose state, so there that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cohortlens-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor cannot lose the state."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, for what every round of a loop joins with itself: written as Parquet.

    A checkpoint keeps the size that was estimated for it, and a join multiplies sizes. Over some
    rounds the estimate of such a state grows to millions of digits, and planning a round to
    minutes. The size of a file is known.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows dealt over all cores by a hash of ``key``: a small table of much work a row would
    otherwise be one task, as its file or its shuffle fits one."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def r4(col: Column | str) -> Column:
    """Round for presentation and for comparing engines."""
    return F.round(F.col(col) if isinstance(col, str) else col, 4)


def shape(df: DataFrame, col: str = "features") -> tuple[int, int]:
    """Rows and vector length in one aggregate."""
    row = df.agg(F.count("*").alias("n"), F.max(F.size(col)).alias("d")).first()
    return int(row.n), int(row.d or 0)


def dim(df: DataFrame, col: str = "features") -> int:
    """Length of the feature vectors, read from one row."""
    row = df.select(F.size(col).alias("d")).first()
    return 0 if row is None else int(row.d)


def distributed_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Row number per group without putting a whole group into one task.

    Rows are range-partitioned by (group, order); a group's rank is its rank inside the
    partition plus the group's rows in the partitions before.
    """
    from pyspark.sql import Window

    placed = cut(df.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy("__p", *group).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*group).orderBy("__p")) - F.col("__c")
    offsets = sizes.select("__p", *group, before.alias("__before"))
    local = F.row_number().over(Window.partitionBy("__p", *group).orderBy(*order))
    ranked = placed.withColumn("__r", local).join(offsets, ["__p", *group])
    return ranked.withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def small(df: DataFrame, width: int, limit: int = 32 << 20) -> DataFrame:
    """Materialise a summary and broadcast it in the next join if its size allows.

    Joining rows to per-group summaries by shuffling on the group would put a hot group's
    rows on one reducer; past ``limit`` bytes the plain join (with skew handling) remains.
    """
    table = cut(df)
    return F.broadcast(table) if table.count() * (width + 2) * 8 <= limit else table


def hash_first(df: DataFrame, m: int, seed: int, n: int) -> DataFrame:
    """The first ``m`` of ``n`` rows by a hash of ``id``: a sample that does not depend on
    the partitioning.

    A bound on the hash leaves little more than ``m`` rows before the sort, so that tasks do
    not each send ``m`` candidates to one place; should too few pass it, it is dropped.
    """
    h = F.xxhash64("id", F.lit(seed))
    share = (1.3 * m + 64) / max(n, 1)
    if share < 1.0:
        near = df.where(h < F.lit(int(-(2**63) + share * 2**64)))
        if near.limit(m).count() >= min(m, n):
            df = near
    return df.orderBy(h, "id").limit(m)
