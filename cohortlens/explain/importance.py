"""Which features drive a labeling: tree, permutation and Shapley importance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.blocks import matrix
from cohortlens.explain.tree import SurrogateTree, shap_column, shap_rows, train_surrogate

METHODS = ("surrogate", "permutation", "shap")
BUCKET_ROWS = 20_000


def permutation_importance(
    df: DataFrame, tree: SurrogateTree, n_repeats: int = 10, seed: int = 42, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``feature, importance, std``: accuracy lost when one feature is shuffled.

    Values are shuffled among the rows of hash buckets of bounded size, so the rows move
    once for all features and repeats and a task never holds more than a bucket.
    """
    n_buckets = max(1, -(-df.count() // bucket_rows))
    width, names = len(tree.names), tree.names
    classes, predicted = np.array(tree.classes), tree.predicted

    def score(key, rows):
        rows = rows.sort_by("id")
        x, y = matrix(rows["features"], width), rows["cluster"].to_numpy()
        base = int((predicted[tree.leaf_rows(x)] == y).sum())
        out = {"f": [], "rep": [], "lost": [], "n": []}
        used = set(tree.feature[tree.feature >= 0].tolist())
        for f in range(width):
            for rep in range(n_repeats):
                lost = 0
                if f in used:
                    rng = np.random.default_rng([seed, key[0].as_py(), f, rep])
                    moved = x.copy()
                    moved[:, f] = rng.permutation(x[:, f])
                    lost = base - int((predicted[tree.leaf_rows(moved)] == y).sum())
                out["f"].append(f)
                out["rep"].append(rep)
                out["lost"].append(lost)
                out["n"].append(len(y))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_buckets)).alias("bucket")
    parts = df.select("id", "features", "cluster", bucket).groupBy("bucket").applyInArrow(score, "f bigint, rep bigint, lost bigint, n bigint")
    per_rep = parts.groupBy("f", "rep").agg((F.sum("lost") / F.sum("n")).alias("drop"))
    named = F.array(*[F.lit(n) for n in names])[F.col("f")]
    out = per_rep.groupBy("f").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))
    return out.select(named.alias("feature"), "importance", "std")


def shap_importance(df: DataFrame, tree: SurrogateTree) -> DataFrame:
    """``feature, importance``: mean absolute Shapley value, averaged over the classes."""
    tables, width = tree.shap_tables(), len(tree.names)

    def partial(batches):
        total, n = np.zeros((width, len(tree.classes))), 0
        for batch in batches:
            x = matrix(batch.column("features"), width)
            for start in range(0, len(x), 4096):
                total += np.abs(shap_rows(tree, tables, x[start : start + 4096], None)).sum(0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"f": np.arange(width, dtype=np.int32), "s": total.mean(1), "n": np.full(width, n)})

    parts = df.select("features").mapInArrow(partial, "f int, s double, n bigint")
    named = F.array(*[F.lit(n) for n in tree.names])[F.col("f")]
    return parts.groupBy("f").agg((F.sum("s") / F.sum("n")).alias("importance")).select(named.alias("feature"), "importance")


def feature_importance(df: DataFrame, names, method: str = "all", n_repeats: int = 10, tree: SurrogateTree | None = None) -> DataFrame:
    """``method, feature, importance, std`` of one method or all, from one shared tree."""
    wanted = METHODS if method == "all" else (method,)
    if not set(wanted) <= set(METHODS):
        raise ValueError(f"unknown method {method}")
    tree = tree or train_surrogate(df, names)
    none = F.lit(None).cast("double").alias("std")
    parts = []
    for m in wanted:
        if m == "surrogate":
            one = tree.importance_df(df.sparkSession).withColumn("std", none)
        elif m == "permutation":
            one = permutation_importance(df, tree, n_repeats)
        else:
            one = shap_importance(df, tree).withColumn("std", none)
        parts.append(one.select(F.lit(m).alias("method"), "feature", "importance", "std"))
    return reduce(DataFrame.unionByName, parts)


def importance_compare(table: DataFrame, methods, top_n: int = 10) -> DataFrame:
    """One row per feature that is in any method's top n, one column per method (0 where
    the method lacks it), the ``top_n`` best by mean."""
    w = Window.partitionBy("method").orderBy(F.desc("importance"), "feature")
    keep = table.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_n).select("feature").distinct()
    wide = table.join(keep, "feature").groupBy("feature").pivot("method", list(methods)).agg(F.first("importance")).fillna(0.0)
    mean = sum((F.col(m) for m in methods), F.lit(0.0)) / len(methods)
    return wide.withColumn("mean", mean).orderBy(F.desc("mean"), "feature").limit(top_n)


def shap_summary(df: DataFrame, tree: SurrogateTree, max_display: int = 10) -> DataFrame:
    """``id, feature, shap, value_unit`` for the features with the largest mean absolute
    Shapley value of the rows' own clusters; values scaled to 0..1 per feature."""
    long = df.select("id", F.posexplode(F.arrays_zip("features", shap_column(tree).alias("shap"))).alias("pos", "z"))
    long = long.select("id", "pos", F.col("z.features").alias("value"), F.col("z.shap").alias("shap")).persist()
    per = long.groupBy("pos").agg(F.avg(F.abs("shap")).alias("a"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    top = per.orderBy(F.desc("a"), "pos").limit(max_display)
    named = F.array(*[F.lit(n) for n in tree.names])[F.col("pos")]
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return long.join(F.broadcast(top), "pos").select("id", named.alias("feature"), "shap", unit.alias("value_unit"))
