"""Global explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.base import CUST_LONG_SQL, CUST_NUM, CLUSTERS_SQL, USER_NUM, cust_clusters, query, rounded, user_model, with_
from cohortlens.explain import importance, profiles, tree
from cohortlens.features import to_long, to_vector
from cohortlens.runtime import cut


def explained_users(spark, sf):
    """Users with the clusters of the three-center model, assigned once."""
    unit, model = user_model(spark, sf)
    return cut(unit.withColumn("cluster", model.nearest()))


def cust_vectors(spark, sf):
    return to_vector(cust_clusters(spark, sf), "id", CUST_NUM, keep=["cluster"])


@query("surrogate_importance")
def surrogate_importance(spark, sf):
    fitted = tree.train_surrogate(explained_users(spark, sf), USER_NUM)
    return rounded(fitted.importance_df(spark).withColumn("fidelity", F.lit(fitted.fidelity)), "importance", "fidelity")


PRED_SQL = "CAST(CASE WHEN acctbal < 2000 THEN 1 WHEN spend_mean > 250000 THEN 3 ELSE 0 END AS INTEGER)"


@query("fidelity_band", with_(CLUSTERS_SQL) + f"""SELECT ROUND(f, 4) AS fidelity, CASE WHEN f >= 0.8 THEN 'reliable' WHEN f >= 0.65 THEN 'caution' ELSE 'low' END AS band
  FROM (SELECT avg(CASE WHEN {PRED_SQL} = cluster THEN 1.0 ELSE 0.0 END) AS f FROM cust_clusters)""")
def fidelity_band(spark, sf):
    guess = F.when(F.col("acctbal") < 2000, 1).when(F.col("spend_mean") > 250000, 3).otherwise(0)
    return rounded(tree.fidelity_band(cust_clusters(spark, sf).withColumn("predicted", guess)), "fidelity")


@query("permutation_importance")
def permutation_importance(spark, sf):
    data = explained_users(spark, sf)
    return rounded(importance.permutation_importance(data, tree.train_surrogate(data, USER_NUM)), "importance", "std")


@query("shap_importance")
def shap_importance(spark, sf):
    data = explained_users(spark, sf)
    return rounded(importance.shap_importance(data, tree.train_surrogate(data, USER_NUM)), "importance")


@query("importance_all")
def importance_all(spark, sf):
    return rounded(importance.feature_importance(explained_users(spark, sf), USER_NUM), "importance", "std")


# three simple importance measures of the segments' profiles: largest effect, spread of the means, mean difference
MEASURES = ["effect", "spread", "shift"]
EFFECT_SQL = """grand AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM cust_long GROUP BY feature),
per AS (SELECT cluster, feature, avg(value) AS cm FROM cust_long GROUP BY cluster, feature),
con AS (SELECT cluster, feature, cm - m AS difference, (cm - m) / s AS effect_size FROM per JOIN grand USING (feature))"""


@query("importance_compare", with_(CUST_LONG_SQL, EFFECT_SQL, """meas AS (SELECT feature, max(abs(effect_size)) AS effect, stddev_pop(effect_size) AS spread, avg(abs(effect_size)) AS shift FROM con GROUP BY feature),
ranks AS (SELECT *, row_number() OVER (ORDER BY effect DESC, feature) AS r1, row_number() OVER (ORDER BY spread DESC, feature) AS r2, row_number() OVER (ORDER BY shift DESC, feature) AS r3 FROM meas)""")
       + """SELECT feature, ROUND(effect, 4) AS effect, ROUND(spread, 4) AS spread, ROUND(shift, 4) AS shift, ROUND((effect + spread + shift) / 3, 4) AS mean
  FROM ranks WHERE least(r1, r2, r3) <= 3 ORDER BY (effect + spread + shift) DESC, feature LIMIT 3""")
def importance_compare(spark, sf):
    con = profiles.contrastive(cust_clusters(spark, sf), CUST_NUM)
    e = F.col("effect_size")
    meas = con.groupBy("feature").agg(F.max(F.abs(e)).alias("effect"), F.stddev_pop(e).alias("spread"), F.avg(F.abs(e)).alias("shift"))
    table = meas.unpivot(["feature"], MEASURES, "method", "importance")
    return rounded(importance.importance_compare(table, MEASURES, 3), *MEASURES, "mean")


@query("profile_stats", with_(CUST_LONG_SQL) + """SELECT cluster, feature, ROUND(avg(value), 4) AS mean, ROUND(median(value), 4) AS median, ROUND(stddev_samp(value), 4) AS std
  FROM cust_long GROUP BY cluster, feature""")
def profile_stats(spark, sf):
    return rounded(profiles.profile_stats(cust_clusters(spark, sf), CUST_NUM), "mean", "median", "std")


@query("contrastive", with_(CUST_LONG_SQL, EFFECT_SQL) + "SELECT cluster, feature, ROUND(difference, 4) AS difference, ROUND(effect_size, 4) AS effect_size FROM con")
def contrastive(spark, sf):
    return rounded(profiles.contrastive(cust_clusters(spark, sf), CUST_NUM), "difference", "effect_size")


@query("decision_rules")
def decision_rules(spark, sf):
    return tree.train_surrogate(explained_users(spark, sf), USER_NUM, max_depth=4).rules_df(spark).where("rank <= 10")


RULES = {"low balance": ("acctbal < 0", 1), "big spender": ("spend_mean > 260000 AND n_orders >= 8", 3), "urgent": ("urgent_share >= 0.5", 4)}


@query("rule_coverage", with_(CLUSTERS_SQL) + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) AS n, ROUND(avg(CASE WHEN cluster = {c} THEN 1.0 ELSE 0.0 END), 4) AS purity FROM cust_clusters WHERE {t} HAVING count(*) > 0" for n, (t, c) in RULES.items()))
def rule_coverage(spark, sf):
    rules = {n: (F.expr(t), c) for n, (t, c) in RULES.items()}
    return rounded(tree.rule_coverage(cust_clusters(spark, sf), rules), "purity")


def _radar_sql(axis: str) -> str:
    return with_(CUST_LONG_SQL, "per AS (SELECT cluster, feature, avg(value) AS m FROM cust_long GROUP BY cluster, feature)") + f"""SELECT cluster, feature,
  ROUND(CASE WHEN max(m) OVER w > min(m) OVER w THEN (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) ELSE 0.0 END, 4) AS value FROM per WINDOW w AS (PARTITION BY {axis})"""


def _profile(spark, sf):
    return to_long(cust_clusters(spark, sf), ["cluster"], CUST_NUM).groupBy("cluster", "feature").agg(F.avg("value").alias("mean"))


@query("radar_by_cluster", _radar_sql("cluster"))
def radar_by_cluster(spark, sf):
    return rounded(profiles.radar(_profile(spark, sf), "cluster"), "value")


@query("radar_by_feature", _radar_sql("feature"))
def radar_by_feature(spark, sf):
    return rounded(profiles.radar(_profile(spark, sf), "feature"), "value")


@query("shap_summary")
def shap_summary(spark, sf):
    data = explained_users(spark, sf)
    return rounded(importance.shap_summary(data, tree.train_surrogate(data, USER_NUM), 5), "shap", "value_unit")
