"""Projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlens import project
from cohortlens.catalog.base import CUST_LONG_SQL, CUST_NUM, emb, query, rounded, with_
from cohortlens.catalog.explaining import cust_vectors
from cohortlens.catalog.local import EMB_NAMES


@query("pca_project")
def pca_project(spark, sf):
    data = emb(spark, sf).select("id", "features")
    return rounded(project.pca_fit(data, 2).transform(data), "pc1", "pc2")


@query("pca_variance")
def pca_variance(spark, sf):
    out = project.pca_fit(emb(spark, sf), 2).loadings_df(spark, EMB_NAMES)
    return rounded(out, "explained_variance_ratio", "loading")


@query("pca_variances", with_(CUST_LONG_SQL) + f"""SELECT ROUND(sum(s), 2) AS total, {len(CUST_NUM)}::BIGINT AS uncorrelated, 1.0::DOUBLE AS ratio
  FROM (SELECT var_samp(value) AS s FROM cust_long GROUP BY feature)""")
def pca_variances(spark, sf):
    """All components keep the whole variance and are uncorrelated, and their shares are one."""
    data = cust_vectors(spark, sf).select("id", "features")
    model = project.pca_fit(data, len(CUST_NUM))
    p = [f"pc{i + 1}" for i in range(len(CUST_NUM))]
    out = model.transform(data)
    apart = [F.max(F.lit(True))] + [
        F.abs(F.covar_samp(a, b)) < 1e-6 * F.sqrt(F.var_samp(a) * F.var_samp(b)) + 1e-6 for i, a in enumerate(p) for b in p[:i]]
    fine = F.when(reduce(lambda x, y: x & y, apart), F.lit(len(p))).otherwise(F.lit(0)).cast("bigint")
    total = reduce(lambda x, y: x + y, [F.var_samp(c) for c in p])
    return out.agg(F.round(total, 2).alias("total"), fine.alias("uncorrelated")).withColumn("ratio", F.lit(round(float(model.explained_variance_ratio.sum()), 6)))


@query("cov_matrix", with_(CUST_LONG_SQL) + """SELECT a.feature AS feature_a, b.feature AS feature_b, ROUND(covar_samp(a.value, b.value), 4) AS cov
  FROM cust_long a JOIN cust_long b ON a.id = b.id AND a.pos <= b.pos GROUP BY a.feature, b.feature""")
def cov_matrix(spark, sf):
    return rounded(project.covariance_matrix(cust_vectors(spark, sf), CUST_NUM), "cov")


@query("scatter_points")
def scatter_points(spark, sf):
    data = emb(spark, sf)
    return rounded(project.scatter_points(data, project.pca_fit(data, 2)), "pc1", "pc2")
