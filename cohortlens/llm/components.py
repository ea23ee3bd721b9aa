"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node it is connected to.

    Each round offers the smaller root across every edge to the node and to the node's own root,
    then replaces roots by their roots. Paths shrink to half, so long chains take few rounds. The
    labels of a round are a written table; nothing is collected but whether edges still disagree.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    both = staged(both, "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
    labels = staged(labels, "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        right = labels.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        seen = staged(both.join(left, "a").join(right, "b").select("a", "root_a", "root_b"), "seen")
        if seen.where("root_a <> root_b").isEmpty():
            return labels
        offers = F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.least("root_a", "root_b").alias("root")),
            F.struct(F.col("root_a").alias("node"), F.least("root_a", "root_b").alias("root"))))
        lower = staged(seen.select(offers).groupBy("node").agg(F.min("root").alias("root")), "lower")
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = staged(lower.join(above, "root").select("node", F.col("next").alias("root")), "labels")
