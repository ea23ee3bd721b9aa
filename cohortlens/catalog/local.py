"""Explanations per row."""

from __future__ import annotations

from cohortlens.catalog.base import EMB_SQL, USER_NUM, USER_VEC_SQL, emb, query, rounded, union_sql, user_model, with_
from cohortlens.catalog.clustering import CENTERS_SQL
from cohortlens.catalog.explaining import explained_users
from cohortlens.clustering.model import CentersModel, group_means
from cohortlens.explain import local
from cohortlens.runtime import cut

EMB_NAMES = [f"f{i}" for i in range(64)]


@query("local_shap")
def local_shap(spark, sf):
    return rounded(local.local_shap(explained_users(spark, sf), USER_NUM), "value", "shap", "base_value", "fidelity")


@query("local_lime")
def local_lime(spark, sf):
    return rounded(local.local_lime(explained_users(spark, sf), USER_NUM), "value", "lime", "probability", "fidelity")


USER_GAP_SQL = USER_VEC_SQL + """,
gap_long AS (SELECT p.id, p.cluster, r.feature, u.value, c.value AS center_value, abs(u.value - c.value) AS distance, u.pos
  FROM user_points p JOIN user_unit u USING (id) JOIN user_center_long c ON c.cluster = p.cluster AND c.pos = u.pos JOIN user_range r ON r.pos = u.pos),
gap_all AS (SELECT *, distance / (sum(distance) OVER (PARTITION BY id) + 1e-10) AS contribution, sqrt(sum(distance * distance) OVER (PARTITION BY id)) AS total_distance FROM gap_long)"""


def user_gaps(spark, sf):
    unit, model = user_model(spark, sf)
    return local.local_distance(cut(unit.withColumn("cluster", model.nearest())), USER_NUM, model)


@query("local_distance", with_(USER_GAP_SQL) + """SELECT id, cluster, feature, ROUND(value, 4) AS value, ROUND(center_value, 4) AS center_value, ROUND(distance, 4) AS distance,
  ROUND(contribution, 4) AS contribution, ROUND(total_distance, 4) AS total_distance, CAST(row_number() OVER (PARTITION BY id ORDER BY distance DESC, pos) AS INTEGER) AS rank FROM gap_all""")
def local_distance(spark, sf):
    return rounded(user_gaps(spark, sf), "value", "center_value", "distance", "contribution", "total_distance")


@query("local_membership", with_(EMB_SQL, CENTERS_SQL) + """SELECT e.id, e.cluster, c.cluster AS center_cluster, CASE WHEN e.cluster = c.cluster THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS probability,
  ROUND(list_distance(e.x, c.c), 4) AS distance, 1.0::DOUBLE AS certainty FROM emb e, cen c""")
def local_membership(spark, sf):
    data = emb(spark, sf)
    return rounded(local.local_membership(data, CentersModel.from_frame(group_means(data))), "distance")


@query("local_all")
def local_all(spark, sf):
    data = explained_users(spark, sf)
    return rounded(local.explain_all(data, USER_NUM, model=user_model(spark, sf)[1]), "value", "score")


@query("local_topn", with_(USER_GAP_SQL) + """SELECT id, feature, ROUND(value, 4) AS value, ROUND(difference, 4) AS difference, ROUND(share_pct, 4) AS share_pct, direction, CAST(rank AS INTEGER) AS rank FROM (
  SELECT id, feature, value, value - center_value AS difference, 100 * distance / sum(distance) OVER (PARTITION BY id) AS share_pct,
    CASE WHEN value > center_value THEN 'Positive' ELSE 'Negative' END AS direction, row_number() OVER (PARTITION BY id ORDER BY distance DESC, feature) AS rank FROM gap_all) WHERE rank <= 3""")
def local_topn(spark, sf):
    gaps = user_gaps(spark, sf).drop("rank")
    signed = gaps.withColumn("difference", gaps["value"] - gaps["center_value"])
    out = local.top_contributions(signed, "difference", 3)
    return rounded(out.select("id", "feature", "value", "difference", "share_pct", "direction", "rank"), "value", "difference", "share_pct")


@query("local_extremes", with_(USER_GAP_SQL) + """SELECT id, arg_max(feature, value - center_value) FILTER (WHERE value > center_value) AS strongest_positive,
  arg_min(feature, value - center_value) FILTER (WHERE value < center_value) AS strongest_negative, ROUND(sum(distance), 4) AS total_impact FROM gap_all GROUP BY id""")
def local_extremes(spark, sf):
    gaps = user_gaps(spark, sf)
    return rounded(local.extremes(gaps.withColumn("difference", gaps["value"] - gaps["center_value"]), "difference"), "total_impact")
