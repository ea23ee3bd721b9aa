"""Counterfactuals of the users against the three-center model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortlens import counterfactual as cfx
from cohortlens.catalog.base import USER_NUM, USER_VEC_SQL, query, rounded, user_features, user_model, with_
from cohortlens.clustering.mixture import MixtureModel
from cohortlens.prepare import fit_scales
from cohortlens.runtime import cut

# constraints in the scaled space
LOW, HIGH, FIXED, STEPS = 0.1, 0.9, "n_events", [0.0, 0.25, 0.5, 0.75, 1.0]


def limits():
    return (
        cfx.Constraints(USER_NUM).set_range("value_mean", LOW, HIGH).set_range("value_max", LOW, HIGH)
        .set_immutable(FIXED).set_categorical("view_share", STEPS)
    )


D = len(USER_NUM)
POS = {n: i + 1 for i, n in enumerate(USER_NUM)}  # SQL lists start at 1


def limited_sql(value: str, original: str) -> str:
    """Constrained list from per-coordinate SQL; ``{i}`` is the coordinate."""
    parts = []
    for n, i in POS.items():
        v = value.format(i=i)
        if n == FIXED:
            v = original.format(i=i)
        elif n in ("value_mean", "value_max"):
            v = f"least(greatest({v}, {LOW}::DOUBLE), {HIGH}::DOUBLE)"
        elif n == "view_share":
            options = ", ".join(f"struct_pack(d := abs({s}::DOUBLE - ({v})), n := {k}, v := {s}::DOUBLE)" for k, s in enumerate(STEPS))
            v = f"list_min([{options}]).v"
        parts.append(v)
    return "[" + ", ".join(parts) + "]"


def labeled_users(spark, sf):
    unit, model = user_model(spark, sf)
    return cut(unit.withColumn("cluster", model.nearest())), model


def long_of(df, names=USER_NUM):
    """One row per coordinate, so that engines compare plain numbers."""
    table = F.array(*[F.lit(n) for n in names])
    return df.select("id", F.posexplode("x").alias("i", "value")).select("id", table[F.col("i")].alias("feature"), F.round("value", 4).alias("value"))


NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in USER_NUM) + "]"


@query("constraints_apply", with_(USER_VEC_SQL) + f"""SELECT id, unnest({NAMES_SQL}) AS feature, unnest(list_transform({limited_sql('x[{i}] * 1.5', 'x[{i}]')}, lambda v: ROUND(v, 4))) AS value FROM user_vec""")
def constraints_apply(spark, sf):
    df = labeled_users(spark, sf)[0].withColumn("moved", F.transform("features", lambda v: v * 1.5))
    return long_of(df.select("id", limits().apply("moved", "features").alias("x")))


@query("constraints_check", with_(USER_VEC_SQL) + f"""SELECT id, x[{POS['value_mean']}] BETWEEN {LOW} AND {HIGH} AND x[{POS['value_max']}] BETWEEN {LOW} AND {HIGH}
  AND x[{POS['view_share']}] IN ({', '.join(map(str, STEPS))}) AS valid FROM user_vec""")
def constraints_check(spark, sf):
    return labeled_users(spark, sf)[0].select("id", limits().valid("features").alias("valid"))


TARGET_SQL = """goal AS (SELECT p.id, p.x, p.cluster, CASE WHEN p.cluster = (SELECT min(cluster) FROM user_points) THEN (SELECT min(cluster) FROM user_points
    WHERE cluster > (SELECT min(cluster) FROM user_points)) ELSE (SELECT min(cluster) FROM user_points) END AS target FROM user_points p),
ex AS (SELECT g.id, g.x, g.cluster, g.target, m.x AS e, row_number() OVER (PARTITION BY g.id ORDER BY round(list_distance(g.x, m.x), 9), m.id) AS rank
  FROM goal g JOIN user_points m ON m.cluster = g.target)"""
CAND_SQL = USER_VEC_SQL + ",\n" + TARGET_SQL + f""",
tried AS (SELECT id, x, cluster, target, rank, step, {limited_sql('(x[{i}] + step * (e[{i}] - x[{i}]))', 'x[{i}]')} AS cf
  FROM (SELECT *, unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS step FROM ex WHERE rank <= 9)),
pred AS (SELECT t.id, t.rank, t.step, arg_min(c.cluster, struct_pack(d := list_distance(t.cf, c.c), l := c.cluster)) AS predicted FROM tried t, user_centers c GROUP BY ALL),
cand AS (SELECT t.* FROM tried t JOIN pred p ON p.id = t.id AND p.rank = t.rank AND p.step = t.step WHERE p.predicted = t.target)"""


def fold_sql(n: int) -> str:
    """Greedy choice over the ordered list ``c`` of vectors; ``x`` is the original."""
    return f"""list_reduce(list_transform(c, lambda v: [v]), lambda kept, v: CASE WHEN len(kept) < {n} AND len(list_filter(kept,
      lambda k: 1 - list_distance(v[1], k) / (list_distance(v[1], x) + 1e-10) > 0.5)) = 0 THEN list_concat(kept, v) ELSE kept END, c[1:0])"""


NEAREST_SQL = CAND_SQL + f""",
packed AS (SELECT id, cluster, target, any_value(x) AS x, list(cf ORDER BY rank, step) AS c FROM cand GROUP BY id, cluster, target),
folded AS (SELECT id, cluster, target, x, {fold_sql(3)} AS kept FROM packed),
cfs AS (SELECT id, cluster, target, x, unnest(kept) AS cf, generate_subscripts(kept, 1) AS cf_rank FROM folded),
chg AS (SELECT id, CAST(cf_rank AS INTEGER) AS cf_rank, cluster, target, x, cf, {'[' + ', '.join(f'cf[{i}] - x[{i}]' for i in range(1, D + 1)) + ']'} AS changes FROM cfs)"""
N_CHANGED_SQL = "CAST(len(list_filter(changes, lambda v: abs(v) > 1e-6)) AS INTEGER)"


@query("cf_candidates", with_(CAND_SQL) + "SELECT id, target, CAST(rank AS INTEGER) AS rank, step, ROUND(list_distance(x, cf), 4) AS distance FROM cand")
def cf_candidates(spark, sf):
    points, model = labeled_users(spark, sf)
    out = cfx.nearest_candidates(points, model, constraints=limits())
    return out.select("id", "target", "rank", "step", F.round(cfx._distance("original", "cf"), 4).alias("distance"))


def nearest_cfs(spark, sf):
    points, model = labeled_users(spark, sf)
    return cfx.nearest_counterfactuals(points, model, constraints=limits())


SUMMARY = ["id", "cf_rank", "original_cluster", "target_cluster", "predicted_cluster", "success", "distance", "n_changes"]


@query("cf_nearest", with_(NEAREST_SQL) + f"""SELECT id, cf_rank, cluster AS original_cluster, target AS target_cluster, target AS predicted_cluster, true AS success,
  ROUND(list_distance(x, cf), 4) AS distance, {N_CHANGED_SQL} AS n_changes FROM chg""")
def cf_nearest(spark, sf):
    return rounded(nearest_cfs(spark, sf).select(*SUMMARY), "distance")


def mixture_users(spark, sf):
    """The users under a mixture whose components differ in their means only, so that the most
    probable component is the one with the nearest mean."""
    points, model = labeled_users(spark, sf)
    k, d = model.centers.shape
    return points, MixtureModel(np.full(k, 1.0 / k), model.centers, np.full(k, 0.05), "spherical")


@query("cf_nearest_mixture", with_(NEAREST_SQL) + f"""SELECT id, cf_rank, cluster AS original_cluster, target AS target_cluster, target AS predicted_cluster, true AS success,
  ROUND(list_distance(x, cf), 4) AS distance, {N_CHANGED_SQL} AS n_changes FROM chg""")
def cf_nearest_mixture(spark, sf):
    points, model = mixture_users(spark, sf)
    return rounded(cfx.nearest_counterfactuals(points, model, constraints=limits(), n=3).select(*SUMMARY), "distance")


def optimum_sql(settings: str) -> str:
    """CTEs ending in ``solved(id, variant, x, cluster, target, cf, predicted)``."""
    grid = "[" + ", ".join(f"{g!r}::DOUBLE" for g in cfx.GRID) + "]"
    return USER_VEC_SQL + ",\n" + TARGET_SQL + f""",
settings AS ({settings}),
seg AS (SELECT g.id, g.x, g.cluster, g.target, c.c, s.variant, s.sparse, s.weight, unnest({grid}) AS step, generate_subscripts({grid}, 1) AS gi
  FROM goal g JOIN user_centers c ON c.cluster = g.target, settings s),
segcf AS (SELECT *, {limited_sql('(x[{i}] + step * (c[{i}] - x[{i}]))', 'x[{i}]')} AS cf FROM seg),
cost AS (SELECT *, round(weight * list_distance(cf, c) + sparse * ({' + '.join(f'CASE WHEN abs(cf[{i}] - x[{i}]) > 1e-6 THEN 1 ELSE 0 END' for i in range(1, D + 1))}) + 0.5 * list_distance(cf, x), 9) AS cost FROM segcf),
best AS (SELECT id, variant, any_value(x) AS x, any_value(cluster) AS cluster, any_value(target) AS target, arg_min(cf, struct_pack(c := cost, g := gi)) AS cf FROM cost GROUP BY id, variant),
bp AS (SELECT b.id, b.variant, arg_min(c.cluster, struct_pack(d := list_distance(b.cf, c.c), l := c.cluster)) AS predicted FROM best b, user_centers c GROUP BY ALL),
fall AS (SELECT id, x, target, step, {limited_sql('(x[{i}] + step * (e[{i}] - x[{i}]))', 'x[{i}]')} AS cf
  FROM (SELECT *, unnest([0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS step FROM ex WHERE rank = 1)),
fp AS (SELECT f.id, f.step, arg_min(c.cluster, struct_pack(d := list_distance(f.cf, c.c), l := c.cluster)) AS predicted FROM fall f, user_centers c GROUP BY ALL),
first AS (SELECT f.id, arg_min(f.cf, f.step) AS cf FROM fall f JOIN fp ON fp.id = f.id AND fp.step = f.step WHERE fp.predicted = f.target GROUP BY f.id),
solved AS (SELECT b.id, b.variant, b.x, b.cluster, b.target, CASE WHEN bp.predicted = b.target THEN b.cf ELSE coalesce(first.cf, b.cf) END AS cf,
  CASE WHEN bp.predicted <> b.target AND first.cf IS NOT NULL THEN b.target ELSE bp.predicted END AS predicted
  FROM best b JOIN bp ON bp.id = b.id AND bp.variant = b.variant LEFT JOIN first ON first.id = b.id)"""


@query("cf_optimize", with_(optimum_sql("SELECT 0 AS variant, 0.1::DOUBLE AS sparse, 1.0::DOUBLE AS weight")) + f"""SELECT id, 1 AS cf_rank, cluster AS original_cluster, target AS target_cluster,
  predicted AS predicted_cluster, predicted = target AS success, ROUND(list_distance(x, cf), 4) AS distance,
  CAST({' + '.join(f'CASE WHEN abs(cf[{i}] - x[{i}]) > 1e-6 THEN 1 ELSE 0 END' for i in range(1, D + 1))} AS INTEGER) AS n_changes FROM solved""")
def cf_optimize(spark, sf):
    points, model = labeled_users(spark, sf)
    return rounded(cfx.optimized_counterfactuals(points, model, constraints=limits()).select(*SUMMARY), "distance")


@query("cf_optimize_mixture", with_(optimum_sql("SELECT 0 AS variant, 0.1::DOUBLE AS sparse, 1.0::DOUBLE AS weight")) + f"""SELECT id, 1 AS cf_rank, cluster AS original_cluster, target AS target_cluster,
  predicted AS predicted_cluster, predicted = target AS success, ROUND(list_distance(x, cf), 4) AS distance,
  CAST({' + '.join(f'CASE WHEN abs(cf[{i}] - x[{i}]) > 1e-6 THEN 1 ELSE 0 END' for i in range(1, D + 1))} AS INTEGER) AS n_changes FROM solved""")
def cf_optimize_mixture(spark, sf):
    points, model = mixture_users(spark, sf)
    return rounded(cfx.optimized_counterfactuals(points, model, constraints=limits()).select(*SUMMARY), "distance")


@query("cf_diverse", with_(optimum_sql(" UNION ALL ".join(
    f"SELECT {i} AS variant, {cfx.SPARSE_START + cfx.SPARSE_STEP * i!r}::DOUBLE AS sparse, {cfx.DISTANCE_START - cfx.DISTANCE_STEP * i!r}::DOUBLE AS weight" for i in range(6))),
    f"packed AS (SELECT id, cluster, target, any_value(x) AS x, list(cf ORDER BY variant) AS c FROM solved WHERE predicted = target GROUP BY id, cluster, target)",
    f"folded AS (SELECT id, cluster, target, x, {fold_sql(3)} AS kept FROM packed)")
    + """SELECT id, CAST(cf_rank AS INTEGER) AS cf_rank, cluster AS original_cluster, target AS target_cluster, ROUND(list_distance(x, cf), 4) AS distance
  FROM (SELECT id, cluster, target, x, unnest(kept) AS cf, generate_subscripts(kept, 1) AS cf_rank FROM folded)""")
def cf_diverse(spark, sf):
    points, model = labeled_users(spark, sf)
    out = cfx.diverse_counterfactuals(points, model, constraints=limits())
    return rounded(out.select("id", "cf_rank", "original_cluster", "target_cluster", "distance"), "distance")


@query("cf_text", with_(NEAREST_SQL, f"""words AS (SELECT id, cf_rank, cluster, target, unnest({NAMES_SQL}) AS f, unnest(x) AS o, unnest(cf) AS v, unnest(changes) AS c, generate_subscripts(x, 1) AS i FROM chg)""")
       + """SELECT id, cf_rank, string_agg(printf('%s %s by %.2f (from %.2f to %.2f)', CASE WHEN c > 0 THEN 'Increase' ELSE 'Decrease' END, f, abs(c), o, v), ' and ' ORDER BY i)
  || ' → move from Cluster ' || any_value(cluster) || ' to Cluster ' || any_value(target) AS text FROM words WHERE abs(c) > 1e-6 GROUP BY id, cf_rank""")
def cf_text(spark, sf):
    return cfx.explanation_text(nearest_cfs(spark, sf), USER_NUM)


@query("cf_quality", with_(NEAREST_SQL) + f"""SELECT g.id, coalesce(cf_rank, 0) AS cf_rank, cf IS NOT NULL AS valid, ROUND(coalesce(list_distance(g.x, cf), 0), 4) AS proximity,
  coalesce({N_CHANGED_SQL}, 0) AS sparsity, ROUND(coalesce({N_CHANGED_SQL} / {D}.0, 0), 4) AS sparsity_ratio, cf IS NOT NULL AS constraints_satisfied, cf IS NOT NULL AS immutable_ok
  FROM user_points g LEFT JOIN chg ON chg.id = g.id""")
def cf_quality(spark, sf):
    points, model = labeled_users(spark, sf)
    cfs = cfx.nearest_counterfactuals(points, model, constraints=limits())
    return rounded(cfx.quality(cfs, limits(), points), "proximity", "sparsity_ratio")


@query("cf_changes", with_(NEAREST_SQL, f"""cells AS (SELECT id, cf_rank, unnest({NAMES_SQL}) AS feature, unnest(x) AS o, unnest(cf) AS v, unnest(changes) AS c FROM chg),
units AS (SELECT id, cf_rank, feature, o * CASE WHEN span = 0 THEN 1.0 ELSE span END + lo AS o, v * CASE WHEN span = 0 THEN 1.0 ELSE span END + lo AS v FROM cells JOIN user_range USING (feature) WHERE abs(c) > 1e-6)""")
       + """SELECT id, cf_rank, feature, ROUND(o, 4) AS original, ROUND(v, 4) AS counterfactual, ROUND(v - o, 4) AS delta, CASE WHEN abs(o) < 1e-6 THEN NULL ELSE ROUND((v - o) / (abs(o) + 1e-10) * 100, 4) END AS delta_pct,
  CASE WHEN v - o > 0 THEN 'Increase' ELSE 'Decrease' END AS direction FROM units""")
def cf_changes(spark, sf):
    scales = fit_scales(user_features(spark, sf), {c: "minmax" for c in USER_NUM})
    out = cfx.change_table(nearest_cfs(spark, sf), USER_NUM, scales)
    # a percentage of an original that is zero up to rounding says nothing
    out = out.withColumn("delta_pct", F.when(F.abs("original") >= 1e-6, F.col("delta_pct")))
    return rounded(out, "original", "counterfactual", "delta", "delta_pct")


@query("cf_top_features", with_(NEAREST_SQL, f"cells AS (SELECT id, unnest({NAMES_SQL}) AS feature, unnest(changes) AS c, generate_subscripts(x, 1) AS i FROM chg)",
       "tops AS (SELECT id, feature, i, max(abs(c)) AS m FROM cells GROUP BY id, feature, i)")
       + "SELECT id, feature, ROUND(m, 6) AS max_change, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m DESC, i) AS r FROM tops) WHERE r <= 3")
def cf_top_features(spark, sf):
    return rounded(cfx.top_changed_features(nearest_cfs(spark, sf), USER_NUM, 3), "max_change", digits=6)
