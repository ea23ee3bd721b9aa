"""What a fitted clustering is to the rest of the package: a few centers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.blocks import matrix


def group_means(df: DataFrame, keys: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """``keys, center array<double>, n`` of the rows' ``features``.

    One map-side-combined aggregate over (group, coordinate): a hot group costs no more
    than any other.
    """
    keys = list(keys)
    long = df.select(*keys, F.posexplode("features").alias("pos", "v"))
    per = long.groupBy(*keys, "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"), F.max("n").alias("n"))
    return packed.select(*keys, F.transform("s", lambda s: s["m"]).alias("center"), "n")


@dataclass(frozen=True)
class CentersModel:
    """Rows belong to the nearest center; equal distances go to the smaller label."""

    labels: tuple[int, ...]
    centers: np.ndarray

    @classmethod
    def from_frame(cls, centers: DataFrame) -> "CentersModel":
        """From ``cluster, center``: k rows, the fitted parameters."""
        rows = sorted(centers.select("cluster", "center").collect(), key=lambda r: r.cluster)
        return cls(tuple(int(r.cluster) for r in rows), np.array([r.center for r in rows], float))

    @property
    def k(self) -> int:
        return len(self.labels)

    def centers_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, [float(v) for v in x]) for c, x in zip(self.labels, self.centers)]
        return spark.createDataFrame(rows, "cluster int, center array<double>")

    def distances(self, features: Column | str = "features") -> Column:
        """``array<double>``: Euclidean distance to every center, in label order."""
        centers = self.centers

        @F.arrow_udf("array<double>")
        def far(v: pa.Array) -> pa.Array:
            x = matrix(v, centers.shape[1])
            d = np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centers], axis=1)
            ends = np.arange(0, d.size + 1, len(centers), dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(d.ravel()))

        return far(features)

    def nearest(self, features: Column | str = "features") -> Column:
        """Label of the nearest center."""
        centers, names = self.centers, np.array(self.labels, np.int32)

        @F.arrow_udf("int")
        def label(v: pa.Array) -> pa.Array:
            x = matrix(v, centers.shape[1])
            d = np.stack([((x - c) ** 2).sum(1) for c in centers], axis=1)
            return pa.array(names[d.argmin(1)])

        return label(features)

    def assign(self, df: DataFrame) -> DataFrame:
        """``cluster`` and ``distance`` of every row; needs no shuffle."""
        d = df.withColumn("__d", self.distances())
        low = F.array_min("__d")
        names = F.array(*[F.lit(c) for c in self.labels])
        return d.withColumn("cluster", F.element_at(names, F.array_position("__d", low).cast("int"))).withColumn("distance", low).drop("__d")

    def posterior(self, df: DataFrame) -> DataFrame:
        """Hard methods are certain: one-hot probabilities in label order."""
        flags = [F.when(F.col("cluster") == c, 1.0).otherwise(0.0) for c in self.labels]
        return df.withColumn("probability", F.array(*flags))
