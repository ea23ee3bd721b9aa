"""What would have to change for a row to fall into another cluster.

Every generator takes a DataFrame of source rows and returns one row per (id, rank) with
array columns, so a single id and a whole table are the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.clustering.model import CentersModel, group_means
from cohortlens.neighbors import nearest

# fixed values: steps towards an example, numbers of examples, and the objective's terms
EXAMPLE_STEPS = (0.5, 0.7, 0.9)
FALLBACK_STEPS = (0.6, 0.7, 0.8, 0.9)
MAX_EXAMPLES, EXAMPLES_PER_RESULT = 20, 3
GRID = tuple(i / 20 for i in range(21))
CHANGED, STAY = 1e-6, 0.5
SPARSE_START, SPARSE_STEP, DISTANCE_START, DISTANCE_STEP = 0.1, 0.05, 1.0, 0.1


class Constraints:
    """Ranges, immutable features and allowed values, by feature name or index; unknown
    names are ignored. Compiled to expressions at plan time."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.ranges: dict[int, tuple[float, float]] = {}
        self.immutable: set[int] = set()
        self.allowed: dict[int, list[float]] = {}

    def _index(self, feature: str | int) -> int | None:
        if isinstance(feature, int):
            return feature if 0 <= feature < len(self.names) else None
        return self.names.index(feature) if feature in self.names else None

    def set_range(self, feature: str | int, low: float, high: float) -> "Constraints":
        if (i := self._index(feature)) is not None:
            self.ranges[i] = (float(low), float(high))
        return self

    def set_immutable(self, feature: str | int) -> "Constraints":
        if (i := self._index(feature)) is not None:
            self.immutable.add(i)
        return self

    def set_categorical(self, feature: str | int, allowed: Sequence[float]) -> "Constraints":
        if (i := self._index(feature)) is not None:
            self.allowed[i] = [float(v) for v in allowed]
        return self

    def element(self, i: int, value: Column, original: Column) -> Column:
        """One coordinate: kept if immutable, else clipped, then snapped to the nearest
        allowed value (the first of equally near ones)."""
        if i in self.immutable:
            return original
        if i in self.ranges:
            low, high = self.ranges[i]
            value = F.least(F.greatest(value, F.lit(low)), F.lit(high))
        if i in self.allowed:
            options = [F.struct(F.abs(F.lit(v) - value).alias("d"), F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in enumerate(self.allowed[i])]
            value = F.array_min(F.array(*options))["v"]
        return value

    def apply(self, x: str, original: str) -> Column:
        return F.array(*[self.element(i, F.col(x)[i], F.col(original)[i]) for i in range(len(self.names))])

    def valid(self, x: str) -> Column:
        """Ranges and allowed values hold."""
        ok = F.lit(True)
        for i, (low, high) in self.ranges.items():
            ok = ok & (F.col(x)[i] >= low) & (F.col(x)[i] <= high)
        for i, allowed in self.allowed.items():
            ok = ok & F.col(x)[i].isin(*allowed)
        return ok

    def immutable_ok(self, x: str, original: str) -> Column:
        ok = F.lit(True)
        for i in self.immutable:
            ok = ok & (F.abs(F.col(x)[i] - F.col(original)[i]) <= CHANGED)
        return ok


def _distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _n_changed(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (F.abs(x - y) > CHANGED).cast("int")), F.lit(0), lambda s, v: s + v)


def _towards(start: str, goal: str, step: Column, constraints: Constraints | None, width: int) -> Column:
    """``start + step * (goal - start)``, constrained coordinate by coordinate."""
    a, b = F.col(start), F.col(goal)

    def at(i: int) -> Column:
        moved = a[i] + step * (b[i] - a[i])
        return constraints.element(i, moved, a[i]) if constraints else moved

    return F.array(*[at(i) for i in range(width)])


def with_target(sources: DataFrame, clusters: Sequence[int], target: int | None = None) -> DataFrame:
    """Adds ``target``: the given cluster, or the smallest other non-negative one. Rows
    without a possible target are left out."""
    usable = sorted(c for c in clusters if c >= 0)
    if target is not None:
        goal = F.lit(int(target)) if target in usable else F.lit(None).cast("int")
    elif not usable:
        goal = F.lit(None).cast("int")
    else:
        second = F.lit(usable[1]) if len(usable) > 1 else F.lit(None).cast("int")
        goal = F.when(F.col("cluster") == usable[0], second).otherwise(F.lit(usable[0]))
    return sources.withColumn("target", goal.cast("int")).where(F.col("target").isNotNull())


class Model(Protocol):
    """What counterfactuals ask of a clustering: labels, a center for each, and the label of a
    vector. Centers, medoids, mixtures and hierarchical models have them; :func:`by_means` makes
    one of any labeled rows, such as those of density or spectral clustering."""

    labels: tuple[int, ...]
    centers: np.ndarray

    def nearest(self, features: Column | str = "features") -> Column: ...


def by_means(points: DataFrame) -> CentersModel:
    """Clusters as the means of their members; noise has none."""
    return CentersModel.from_frame(group_means(points.where("cluster >= 0")))


def _clusters(points: DataFrame) -> list[int]:
    return [r.cluster for r in points.where("cluster >= 0").select("cluster").distinct().collect()]


def _finish(rows: DataFrame) -> DataFrame:
    """The result columns from ``id, cf_rank, original, counterfactual, cluster, target, predicted``."""
    return rows.select(
        "id", "cf_rank", "original", "counterfactual",
        F.zip_with("counterfactual", "original", lambda c, o: c - o).alias("changes"),
        F.col("cluster").alias("original_cluster"), F.col("target").alias("target_cluster"), F.col("predicted").alias("predicted_cluster"),
        (F.col("predicted") == F.col("target")).alias("success"),
        _distance("original", "counterfactual").alias("distance"), _n_changed("original", "counterfactual").cast("int").alias("n_changes"),
    )


def _diverse(candidates: Column, original: Column, n: int, diversity: float) -> Column:
    """First ``n`` candidates in order, dropping one too similar to any kept before it.

    ``candidates`` is an ordered array of structs with the vector ``cf``; it is at most a
    few dozen long by construction.
    """

    def fold(kept: Column, c: Column) -> Column:
        far = _distance(c["cf"], original) + 1e-10
        close = F.exists(kept, lambda k: 1 - _distance(c["cf"], k["cf"]) / far > 1 - diversity) if diversity > 0 else F.lit(False)
        return F.when((F.size(kept) < n) & ~close, F.concat(kept, F.array(c))).otherwise(kept)

    return F.aggregate(candidates, F.slice(candidates, 1, 0), fold)


def _examples(sources: DataFrame, points: DataFrame, k: int, **how) -> DataFrame:
    """``sources`` joined to the vectors of its k nearest members of the target cluster:
    ``id, features, cluster, target, rank, example``."""
    members = points.where("cluster >= 0").select("id", "features", F.col("cluster").alias("g"))
    hits = nearest(sources.select("id", "features", F.col("target").alias("g")), members, k, group="g", **how)
    found = hits.select("qid", "rank", F.col("id").alias("mid")).join(members.select(F.col("id").alias("mid"), F.col("features").alias("example")), "mid")
    return sources.join(found, sources["id"] == found["qid"]).select(sources["*"], "rank", "example")


def nearest_candidates(
    points: DataFrame, model: Model, sources: DataFrame | None = None, target: int | None = None,
    constraints: Constraints | None = None, n: int = 3, **how,
) -> DataFrame:
    """Steps towards the nearest target examples that the model puts into the target:
    ``id, original, cluster, target, rank, step, cf, predicted``."""
    goal = with_target(points if sources is None else sources, _clusters(points), target)
    found = _examples(goal, points, min(MAX_EXAMPLES, EXAMPLES_PER_RESULT * n), **how)
    width = model.centers.shape[1]
    stepped = found.withColumn("step", F.explode(F.array(*[F.lit(s) for s in EXAMPLE_STEPS])))
    tried = stepped.withColumn("cf", _towards("features", "example", F.col("step"), constraints, width))
    tried = tried.withColumn("predicted", model.nearest("cf")).where(F.col("predicted") == F.col("target"))
    return tried.select("id", F.col("features").alias("original"), "cluster", "target", "rank", "step", "cf", "predicted")


def nearest_counterfactuals(
    points: DataFrame, model: Model, sources: DataFrame | None = None, target: int | None = None,
    constraints: Constraints | None = None, n: int = 3, diversity: float = 0.5, **how,
) -> DataFrame:
    """Up to ``n`` diverse counterfactuals per id out of :func:`nearest_candidates`."""
    tried = nearest_candidates(points, model, sources, target, constraints, n, **how)
    packed = tried.groupBy("id", "cluster", "target").agg(
        F.first("original").alias("original"), F.array_sort(F.collect_list(F.struct("rank", "step", "cf"))).alias("c")
    )
    kept = packed.select("id", "cluster", "target", "original", F.posexplode(_diverse(F.col("c"), F.col("original"), n, diversity)).alias("p", "k"))
    return _finish(kept.select(
        "id", (F.col("p") + 1).alias("cf_rank"), "original", F.col("k.cf").alias("counterfactual"), "cluster", "target", F.col("target").alias("predicted")
    ))


def _optimum(start: str, goal: str, sparse: Column, distance: Column, constraints: Constraints | None, width: int) -> Column:
    """Best constrained point on the segment from the row to the target center.

    Both norms of the objective only trade off along that segment, so a fixed grid on it
    stands in for a solver.
    """
    steps = F.array(*[F.lit(float(g)) for g in GRID])
    tried = F.transform(steps, lambda s: _towards(start, goal, s, constraints, width))

    def score(cf: Column, i: Column) -> Column:
        cost = distance * _distance(cf, F.col(goal)) + sparse * _n_changed(cf, F.col(start)) + STAY * _distance(cf, F.col(start))
        return F.struct(F.round(cost, 9).alias("cost"), i.alias("i"), cf.alias("cf"))

    return F.array_min(F.transform(tried, score))


def _solve(goal: DataFrame, points: DataFrame, model: Model, constraints: Constraints | None, **how) -> DataFrame:
    """``goal`` (id, features, cluster, target, sparse, distance, variant) with ``cf`` and
    ``predicted``; a miss falls back to steps towards the nearest target example."""
    width = model.centers.shape[1]
    table = F.map_from_arrays(F.array(*[F.lit(c) for c in model.labels]), F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.centers]))
    aimed = goal.withColumn("center", table[F.col("target")]).where(F.col("center").isNotNull())
    best = aimed.withColumn("o", _optimum("features", "center", F.col("sparse"), F.col("weight"), constraints, width))
    best = best.withColumn("cf", F.col("o.cf")).drop("o", "center").withColumn("predicted", model.nearest("cf")).persist()
    missed = best.where(F.col("predicted") != F.col("target"))
    # one search per row, whatever the number of variants
    wanted = missed.select("id", "features", "cluster", "target").distinct()
    found = _examples(wanted, points, 1, **how).withColumn("step", F.explode(F.array(*[F.lit(s) for s in FALLBACK_STEPS])))
    tried = found.withColumn("cf", _towards("features", "example", F.col("step"), constraints, width))
    tried = tried.withColumn("predicted", model.nearest("cf")).where(F.col("predicted") == F.col("target"))
    first = tried.groupBy("id").agg(F.min(F.struct("step", "cf")).alias("f")).select("id", F.col("f.cf").alias("fallback"))
    return best.join(first, "id", "left").select(
        "id", "features", "cluster", "target", "variant",
        F.when(F.col("predicted") == F.col("target"), F.col("cf")).otherwise(F.coalesce("fallback", "cf")).alias("cf"),
        F.when((F.col("predicted") != F.col("target")) & F.col("fallback").isNotNull(), F.col("target")).otherwise(F.col("predicted")).alias("predicted"),
    )


def optimized_counterfactuals(
    points: DataFrame, model: Model, sources: DataFrame | None = None, target: int | None = None,
    constraints: Constraints | None = None, lambda_sparse: float = 0.1, lambda_distance: float = 1.0, **how,
) -> DataFrame:
    """One counterfactual per id minimising ``lambda_distance * |x - center| +
    lambda_sparse * changed + 0.5 * |x - original|`` within the constraints."""
    goal = with_target(points if sources is None else sources, _clusters(points), target)
    goal = goal.select("id", "features", "cluster", "target", F.lit(0).alias("variant"), F.lit(float(lambda_sparse)).alias("sparse"), F.lit(float(lambda_distance)).alias("weight"))
    out = _solve(goal, points, model, constraints, **how)
    return _finish(out.select("id", F.lit(1).alias("cf_rank"), F.col("features").alias("original"), F.col("cf").alias("counterfactual"), "cluster", "target", "predicted"))


def diverse_counterfactuals(
    points: DataFrame, model: Model, sources: DataFrame | None = None, target: int | None = None,
    constraints: Constraints | None = None, n: int = 3, diversity: float = 0.5, **how,
) -> DataFrame:
    """Up to ``n`` diverse successful optima over ``2 n`` settings of the two weights."""
    goal = with_target(points if sources is None else sources, _clusters(points), target)
    settings = [
        F.struct(F.lit(i).alias("variant"), F.lit(SPARSE_START + SPARSE_STEP * i).alias("sparse"), F.lit(DISTANCE_START - DISTANCE_STEP * i).alias("weight"))
        for i in range(2 * n)
    ]
    goal = goal.select("id", "features", "cluster", "target", F.inline(F.array(*settings)))
    solved = _solve(goal, points, model, constraints, **how).where(F.col("predicted") == F.col("target"))
    packed = solved.groupBy("id", "cluster", "target").agg(
        F.first("features").alias("original"), F.array_sort(F.collect_list(F.struct("variant", "cf"))).alias("c")
    )
    kept = packed.select("id", "cluster", "target", "original", F.posexplode(_diverse(F.col("c"), F.col("original"), n, diversity)).alias("p", "k"))
    return _finish(kept.select(
        "id", (F.col("p") + 1).alias("cf_rank"), "original", F.col("k.cf").alias("counterfactual"), "cluster", "target", F.col("target").alias("predicted")
    ))


# ------------------------------------------------------------------ report tables


def _changed(names: Sequence[str]) -> Column:
    """Ordered ``array<struct<feature, original, value, change>>`` of the changed features."""
    table = F.array(*[F.lit(n) for n in names])
    rows = F.transform("changes", lambda c, i: F.struct(table[i].alias("feature"), F.col("original")[i].alias("original"), F.col("counterfactual")[i].alias("value"), c.alias("change")))
    return F.filter(rows, lambda r: F.abs(r["change"]) > CHANGED)


def explanation_text(cfs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``id, cf_rank, text``."""

    def phrase(r: Column) -> Column:
        verb = F.when(r["change"] > 0, "Increase").otherwise("Decrease")
        return F.format_string("%s %s by %.2f (from %.2f to %.2f)", verb, r["feature"], F.abs(r["change"]), r["original"], r["value"])

    parts = F.transform(_changed(names), phrase)
    text = F.format_string("%s → move from Cluster %d to Cluster %d", F.concat_ws(" and ", parts), F.col("original_cluster"), F.col("target_cluster"))
    full = F.when(~F.col("success"), "No valid counterfactual found").when(F.size(parts) == 0, "No significant changes required").otherwise(text)
    return cfs.select("id", "cf_rank", full.alias("text"))


def quality(cfs: DataFrame, constraints: Constraints | None = None, ids: DataFrame | None = None) -> DataFrame:
    """``id, cf_rank, valid, proximity, sparsity, sparsity_ratio, constraints_satisfied,
    immutable_ok``; an id of ``ids`` without a counterfactual is invalid with zeros."""
    ok = constraints.valid("counterfactual") if constraints else F.lit(True)
    kept = constraints.immutable_ok("counterfactual", "original") if constraints else F.lit(True)
    out = cfs.select(
        "id", "cf_rank", F.col("success").alias("valid"), F.col("distance").alias("proximity"), F.col("n_changes").alias("sparsity"),
        (F.col("n_changes") / F.greatest(F.size("original"), F.lit(1))).alias("sparsity_ratio"), ok.alias("constraints_satisfied"), kept.alias("immutable_ok"),
    )
    if ids is None:
        return out
    full = ids.select("id").join(out, "id", "left").fillna(0).fillna(False)
    return full


def change_table(cfs: DataFrame, names: Sequence[str], scales: dict | None = None) -> DataFrame:
    """``id, cf_rank, feature, original, counterfactual, delta, delta_pct, direction`` of the
    changed features, in original units when the preparation's scales are given."""
    scales = scales or {}
    scale = F.array(*[F.lit(float(scales[n].scale) if n in scales else 1.0) for n in names])
    shift = F.array(*[F.lit(float(scales[n].shift) if n in scales else 0.0) for n in names])
    table = F.array(*[F.lit(n) for n in names])
    long = cfs.select("id", "cf_rank", F.posexplode(F.arrays_zip("original", "counterfactual", "changes")).alias("i", "z")).where(F.abs("z.changes") > CHANGED)
    i = F.col("i")
    long = long.select("id", "cf_rank", table[i].alias("feature"), (F.col("z.original") * scale[i] + shift[i]).alias("original"), (F.col("z.counterfactual") * scale[i] + shift[i]).alias("counterfactual"))
    delta = F.col("counterfactual") - F.col("original")
    return long.select("*", delta.alias("delta"), (delta / (F.abs("original") + 1e-10) * 100).alias("delta_pct"), F.when(delta > 0, "Increase").otherwise("Decrease").alias("direction"))


def top_changed_features(cfs: DataFrame, names: Sequence[str], n: int = 10) -> DataFrame:
    """``id, feature, max_change, rank``: largest absolute change over the id's
    counterfactuals; ties in feature order."""
    table = F.array(*[F.lit(x) for x in names])
    long = cfs.select("id", F.posexplode("changes").alias("i", "c")).groupBy("id", "i").agg(F.max(F.abs("c")).alias("max_change"))
    w = Window.partitionBy("id").orderBy(F.desc("max_change"), "i")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("id", table[F.col("i")].alias("feature"), "max_change", "rank")
