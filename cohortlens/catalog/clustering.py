"""Clustering: fits, and their deterministic steps checked by value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortlens import validate
from cohortlens.catalog.base import (
    CLUSTERS_SQL, CUST_NUM, EMB_NOISE_SQL, EMB_SQL, USERS_SQL, USER_NUM, USER_VEC_SQL, cust_clusters, cust_features, emb, emb_noise, query, rounded, union_sql,
    user_model, user_unit, with_,
)
from cohortlens.catalog.validation import metrics_sql
from cohortlens.clustering import compare, density, graph, mixture, partition, select
from cohortlens.clustering.model import CentersModel, group_means
from cohortlens.features import to_vector
from cohortlens.prepare import apply_scales, fit_scales
from cohortlens.runtime import cut


def cust_scaled(spark, sf):
    """Customers as standardised vectors."""
    df = cust_features(spark, sf)
    return to_vector(apply_scales(df, fit_scales(df, {c: "standard" for c in CUST_NUM})), "id", CUST_NUM)


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    data = cust_scaled(spark, sf)
    return rounded(partition.kmeans_fit(data, 4).assign(data).select("id", "cluster", "distance"), "distance")


CENTERS_SQL = """cen_long AS (SELECT cluster, pos, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM emb) GROUP BY ALL),
cen AS (SELECT cluster, list(v ORDER BY pos) AS c FROM cen_long GROUP BY cluster)"""


@query("assign_nearest", with_(EMB_SQL, CENTERS_SQL, "far AS (SELECT id, e.x, k.cluster, list_distance(e.x, k.c) AS d FROM emb e, cen k)")
       + "SELECT id, arg_min(cluster, d) AS cluster, ROUND(min(d), 4) AS distance FROM far GROUP BY id")
def assign_nearest(spark, sf):
    data = emb(spark, sf)
    model = CentersModel.from_frame(group_means(data))
    return rounded(model.assign(data.select("id", "features")).select("id", "cluster", "distance"), "distance")


@query("kmedoids_step", with_(EMB_SQL, """tot AS (SELECT a.cluster, a.id, ROUND(sum(list_distance(a.x, b.x)), 6) AS total
  FROM emb a JOIN emb b ON a.cluster = b.cluster GROUP BY a.cluster, a.id)""")
       + "SELECT cluster, arg_min(id, struct_pack(t := total, i := id)) AS id, ROUND(min(total), 4) AS total FROM tot GROUP BY cluster")
def kmedoids_step(spark, sf):
    return rounded(partition.medoids(emb(spark, sf)), "total")


@query("kmedoids_fit")
def kmedoids_fit(spark, sf):
    data = user_unit(spark, sf)
    return rounded(partition.kmedoids_fit(data, 3).assign(data).select("id", "cluster", "distance"), "distance")


@query("hier_micro_pairs", with_(EMB_SQL, CENTERS_SQL, "nn AS (SELECT cluster, count(*)::DOUBLE AS n FROM emb GROUP BY cluster)")
       + """SELECT a.cluster AS a, b.cluster AS b, ROUND(sqrt(2 * na.n * nb.n / (na.n + nb.n)) * list_distance(a.c, b.c), 4) AS distance
       FROM cen a JOIN cen b ON a.cluster < b.cluster JOIN nn na ON na.cluster = a.cluster JOIN nn nb ON nb.cluster = b.cluster""")
def hier_micro_pairs(spark, sf):
    return rounded(partition.micro_pairs(group_means(emb(spark, sf)), "ward"), "distance")


@query("hier_fit")
def hier_fit(spark, sf):
    data = emb(spark, sf).select("id", "features")
    return partition.hierarchical_fit(data, 5, "ward").assign(data).select("id", "cluster")


@query("hier_merges")
def hier_merges(spark, sf):
    data = user_unit(spark, sf)
    merges = partition.hierarchical_fit(data, 3, "average", max_micro=512).merges_df(spark)
    return rounded(partition.dendrogram(merges), "distance")


@query("gmm_fit")
def gmm_fit(spark, sf):
    data = cust_scaled(spark, sf)
    out = mixture.mixture_fit(data, 3).assign(data)
    return rounded(out.select("id", "cluster", F.array_max("probability").alias("certainty")), "certainty")


STD_SQL = CLUSTERS_SQL + ",\nstd AS (SELECT id, cluster, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in CUST_NUM) + " FROM cust_clusters)"
DIAG_SQL = STD_SQL + ",\npar AS (SELECT cluster, count(*)::DOUBLE / (SELECT count(*) FROM std) AS w, " + ", ".join(
    f"avg({c}) AS m_{c}, var_pop({c}) + 1e-6 AS v_{c}" for c in CUST_NUM) + " FROM std GROUP BY cluster)," + """
dens AS (SELECT id, p.cluster, ln(w) - 0.5 * (""" + " + ".join(
    f"ln(2 * pi()) + ln(v_{c}) + pow({c} - m_{c}, 2) / v_{c}" for c in CUST_NUM) + """) AS l FROM std s, par p),
top AS (SELECT id, max(l) AS top FROM dens GROUP BY id)"""


@query("gmm_diag_posterior", with_(DIAG_SQL) + """SELECT id, cluster, ROUND(exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id), 4) AS probability
  FROM dens JOIN top USING (id)""")
def gmm_diag_posterior(spark, sf):
    data = cust_scaled(spark, sf).join(cust_clusters(spark, sf).select("id", "cluster"), "id")
    rows = data.select("cluster", F.posexplode("features").alias("p", "v")).groupBy("cluster", "p").agg(
        F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("*").alias("n")).orderBy("cluster", "p").collect()
    d = len(CUST_NUM)
    import numpy as np

    means, covs = (np.array([getattr(r, f) for r in rows], float).reshape(-1, d) for f in ("m", "s"))
    n = np.array([r.n for r in rows[::d]], float)
    model = mixture.MixtureModel(n / n.sum(), means, covs + mixture.REG, "diag")
    out = data.select("id", F.posexplode(model.probability()).alias("cluster", "probability"))
    return rounded(out, "probability")


LLOYD_SQL = USER_VEC_SQL + "".join(f""",
lm{i} AS (SELECT cluster, list(v ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(v) AS v FROM
  (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM {before}) GROUP BY cluster, pos) GROUP BY cluster),
lp{i} AS (SELECT id, any_value(x) AS x, arg_min(cluster, struct_pack(d := list_distance(x, c), l := cluster)) AS cluster FROM user_vec, lm{i} GROUP BY id)"""
    for i, before in ((1, "user_points"), (2, "lp1"), (3, "lp2")))


@query("kmeans_lloyd", with_(LLOYD_SQL) + "SELECT id, cluster FROM lp3")
def kmeans_lloyd(spark, sf):
    """Three rounds from given centers."""
    unit, start = user_model(spark, sf)
    return partition.lloyd(unit, start.centers, 3).assign(unit).select("id", "cluster")


GIVEN_VAR = 0.05
GIVEN_MIX_SQL = USER_VEC_SQL + f""",
gd AS (SELECT v.id, c.cluster, v.x, -0.5 * list_distance(x, c) ** 2 / {GIVEN_VAR} AS l FROM user_vec v, user_centers c),
gt AS (SELECT id, max(l) AS top FROM gd GROUP BY id),
gr AS (SELECT gd.id, cluster, x, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY gd.id) AS r, l, top FROM gd JOIN gt ON gt.id = gd.id),
gl AS (SELECT id, cluster, r, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM gr),
gm AS (SELECT cluster, pos, sum(r * v) / sum(r) AS m, sum(r) AS n FROM gl GROUP BY cluster, pos),
gx AS (SELECT gl.*, v - m AS off, n FROM gl JOIN gm USING (cluster, pos)),
gc AS (SELECT a.cluster, a.pos AS i, b.pos AS j, sum(a.r * a.off * b.off) / any_value(a.n) AS cov, any_value(a.n) AS n
  FROM gx a JOIN gx b ON a.id = b.id AND a.cluster = b.cluster GROUP BY a.cluster, a.pos, b.pos)"""


def given_mixture(spark, sf, form):
    """The users, and a mixture at the three given centers with one variance for all."""
    unit, start = user_model(spark, sf)
    k, d = start.centers.shape
    covs = {"full": np.tile(GIVEN_VAR * np.eye(d), (k, 1, 1)), "tied": GIVEN_VAR * np.eye(d), "diag": np.full((k, d), GIVEN_VAR), "spherical": np.full(k, GIVEN_VAR)}
    return unit, mixture.MixtureModel(np.full(k, 1.0 / k), start.centers, covs[form], form)


def covariances(spark, sf, form):
    unit, model = given_mixture(spark, sf, form)
    parts = mixture.em_round(unit, model).components_df(spark).select("cluster", "weight", F.posexplode("covariance").alias("p", "cov"))
    return rounded(parts, "weight", "cov")


EM_WEIGHT = "ROUND(n / sum(n) OVER (), 4) AS weight"


@query("gmm_em_means", with_(GIVEN_MIX_SQL) + "SELECT cluster, CAST(pos - 1 AS INTEGER) AS p, ROUND(m, 4) AS mean FROM gm")
def gmm_em_means(spark, sf):
    unit, model = given_mixture(spark, sf, "diag")
    out = mixture.em_round(unit, model).components_df(spark).select("cluster", F.posexplode("mean").alias("p", "mean"))
    return rounded(out, "mean")


@query("gmm_em_full", with_(GIVEN_MIX_SQL, "sh AS (SELECT cluster, n / sum(n) OVER () AS w FROM (SELECT DISTINCT cluster, n FROM gm WHERE pos = 1))")
       + f"""SELECT cluster, ROUND(w, 4) AS weight, CAST((i - 1) * {len(USER_NUM)} + j - 1 AS INTEGER) AS p, ROUND(cov + CASE WHEN i = j THEN {mixture.REG} ELSE 0 END, 4) AS cov FROM gc JOIN sh USING (cluster)""")
def gmm_em_full(spark, sf):
    return covariances(spark, sf, "full")


@query("gmm_em_diag", with_(GIVEN_MIX_SQL, "sh AS (SELECT cluster, n / sum(n) OVER () AS w FROM (SELECT DISTINCT cluster, n FROM gm WHERE pos = 1))")
       + f"SELECT cluster, ROUND(w, 4) AS weight, CAST(i - 1 AS INTEGER) AS p, ROUND(cov + {mixture.REG}, 4) AS cov FROM gc JOIN sh USING (cluster) WHERE i = j")
def gmm_em_diag(spark, sf):
    return covariances(spark, sf, "diag")


@query("gmm_em_spherical", with_(GIVEN_MIX_SQL, "sh AS (SELECT cluster, n / sum(n) OVER () AS w FROM (SELECT DISTINCT cluster, n FROM gm WHERE pos = 1))")
       + f"SELECT cluster, ROUND(any_value(w), 4) AS weight, 0 AS p, ROUND(avg(cov) + {mixture.REG}, 4) AS cov FROM gc JOIN sh USING (cluster) WHERE i = j GROUP BY cluster")
def gmm_em_spherical(spark, sf):
    return covariances(spark, sf, "spherical")


@query("gmm_em_tied", with_(GIVEN_MIX_SQL, "sh AS (SELECT cluster, n / sum(n) OVER () AS w FROM (SELECT DISTINCT cluster, n FROM gm WHERE pos = 1))",
       f"pooled AS (SELECT i, j, sum(n * cov) / sum(n) + CASE WHEN i = j THEN {mixture.REG} ELSE 0 END AS cov FROM gc GROUP BY i, j)")
       + f"SELECT cluster, ROUND(w, 4) AS weight, CAST((i - 1) * {len(USER_NUM)} + j - 1 AS INTEGER) AS p, ROUND(cov, 4) AS cov FROM pooled, sh")
def gmm_em_tied(spark, sf):
    return covariances(spark, sf, "tied")


@query("gmm_given_bic", with_(GIVEN_MIX_SQL) + f"""SELECT ROUND(-2 * sum(ll) + {3 - 1 + 3 * len(USER_NUM) + 3} * ln(count(*)), 2) AS bic FROM (
  SELECT id, any_value(top) + ln(sum(exp(l - top)) / 3) - {len(USER_NUM)} * 0.5 * ln(2 * pi() * {GIVEN_VAR}) AS ll FROM gr GROUP BY id)""")
def gmm_given_bic(spark, sf):
    unit, model = given_mixture(spark, sf, "spherical")
    return spark.createDataFrame([(round(model.bic(unit), 2),)], "bic double")


@query("gmm_tied_fit")
def gmm_tied_fit(spark, sf):
    data = cust_scaled(spark, sf)
    return mixture.mixture_fit(data, 3, "tied").assign(data).select("id", "cluster")


@query("gmm_auto_bic")
def gmm_auto_bic(spark, sf):
    model, bics = mixture.mixture_auto(cust_scaled(spark, sf))
    return rounded(spark.createDataFrame([(k, b, k == model.k) for k, b in bics.items()], "k int, bic double, chosen boolean"), "bic")


KNN_SQL = """near AS (SELECT * FROM (SELECT a.id AS qid, b.id AS id, round(list_distance(a.x, b.x), 9) AS dist,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 9), b.id) AS r FROM emb a JOIN emb b ON a.id <> b.id) WHERE r <= 10)"""


@query("affinity_edges", with_(EMB_SQL, KNN_SQL) + """SELECT least(qid, id) AS src, greatest(qid, id) AS dst, ROUND(exp(-any_value(dist) * any_value(dist)), 4) AS weight
  FROM near GROUP BY ALL""")
def affinity_edges(spark, sf):
    return rounded(graph.affinity_edges(emb(spark, sf), 10), "weight")


@query("spectral_fit")
def spectral_fit(spark, sf):
    return graph.spectral_fit(emb(spark, sf), 5)


CORE_SQL = KNN_SQL + ", core AS (SELECT qid AS id, dist AS core FROM near WHERE r = 5)"
MR_SQL = CORE_SQL + """, mr AS (SELECT least(qid, n.id) AS src, greatest(qid, n.id) AS dst, max(greatest(dist, a.core, b.core)) AS weight
  FROM near n JOIN core a ON a.id = n.qid JOIN core b ON b.id = n.id WHERE n.r <= 5 GROUP BY ALL)"""


@query("core_distance", with_(EMB_SQL, CORE_SQL) + "SELECT id, ROUND(core, 4) AS core FROM core")
def core_distance(spark, sf):
    return rounded(density.core_distances(emb(spark, sf), 5), "core")


@query("mutual_reach", with_(EMB_SQL, MR_SQL) + "SELECT src, dst, ROUND(weight, 4) AS weight FROM mr")
def mutual_reach(spark, sf):
    return rounded(density.mutual_reachability(emb(spark, sf), 5), "weight")


@query("density_components", "WITH RECURSIVE " + ",\n".join([EMB_SQL, MR_SQL, """lev AS (SELECT 0 AS level, quantile_cont(weight, 0.1) AS t FROM mr
  UNION ALL SELECT 1, quantile_cont(weight, 0.4) FROM mr),
link AS (SELECT level, src AS a, dst AS b FROM mr, lev WHERE weight <= t UNION ALL SELECT level, dst, src FROM mr, lev WHERE weight <= t),
reach AS (SELECT level, id AS a, id AS b FROM emb, lev UNION SELECT r.level, r.a, l.b FROM reach r JOIN link l ON l.level = r.level AND l.a = r.b)"""])
       + " SELECT level, a AS id, min(b) AS comp FROM reach GROUP BY level, a")
def density_components(spark, sf):
    data = emb(spark, sf)
    edges = density.mutual_reachability(data, 5)
    levels = edges.agg(F.percentile("weight", F.array(F.lit(0.1), F.lit(0.4))).alias("q")).first().q
    return density.level_components(edges, data, levels)


@query("hdbscan_fit")
def hdbscan_fit(spark, sf):
    return density.hdbscan_fit(emb(spark, sf), 5).labels


@query("density_assign", with_(EMB_NOISE_SQL, """train AS (SELECT * FROM emb_noise WHERE cluster >= 0), fresh AS (SELECT * FROM emb_noise WHERE cluster < 0),
tn AS (SELECT a.id, round(list_distance(a.x, b.x), 9) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 9), b.id) AS r
  FROM train a JOIN train b ON a.id <> b.id),
core AS (SELECT id, d AS core FROM tn WHERE r = 5), births AS (SELECT cluster, avg(core) AS birth FROM core JOIN train USING (id) GROUP BY cluster),
near AS (SELECT a.id AS qid, b.id, b.cluster, round(list_distance(a.x, b.x), 9) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 9), b.id) AS r
  FROM fresh a, train b),
own AS (SELECT qid, d AS own FROM near WHERE r = 5),
best AS (SELECT n.qid, min(struct_pack(reach := greatest(d, core, own), id := n.id, cluster := n.cluster)) AS b
  FROM near n JOIN own USING (qid) JOIN core c ON c.id = n.id WHERE r <= 10 GROUP BY n.qid)""")
       + "SELECT qid AS id, CASE WHEN b.reach <= birth THEN b.cluster ELSE -1 END AS cluster FROM best JOIN births ON births.cluster = b.cluster")
def density_assign(spark, sf):
    data = emb_noise(spark, sf)
    known = data.where("cluster >= 0")
    train = cut(known.join(density.core_distances(known, 5), "id"))  # read by the births and by the search
    births = train.groupBy("cluster").agg(F.avg("core").alias("birth"))
    return density.density_assign(data.where("cluster < 0"), train, births, 5)


# ------------------------------------------------------------------ choosing k

KS = [2, 3, 4, 5, 6]
KS_SQL = EMB_SQL + ", by_k AS (" + union_sql(KS, "SELECT id, '{c}' AS method, CAST(cluster % {c} AS INTEGER) AS cluster FROM emb") + ")"
K_SCORES_SQL = with_(KS_SQL, metrics_sql("by_k"), """per_k AS (SELECT CAST(s.method AS INTEGER) AS k, silhouette, davies_bouldin, calinski_harabasz
  FROM (SELECT method, avg(silhouette) AS silhouette FROM sil GROUP BY method) s JOIN db USING (method) JOIN ch USING (method)),
scored AS (SELECT *, 0.5 * (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ())
  + 0.25 * (max(davies_bouldin) OVER () - davies_bouldin) / (max(davies_bouldin) OVER () - min(davies_bouldin) OVER ())
  + 0.25 * (calinski_harabasz - min(calinski_harabasz) OVER ()) / (max(calinski_harabasz) OVER () - min(calinski_harabasz) OVER ()) AS score,
  CASE WHEN max(silhouette) OVER () >= 0.7 THEN 'excellent' WHEN max(silhouette) OVER () >= 0.5 THEN 'good'
       WHEN max(silhouette) OVER () >= 0.25 THEN 'moderate' ELSE 'weak' END AS quality FROM per_k)""")


def labels_by_k(spark, sf):
    marks = F.array(*[F.struct(F.lit(str(k)).alias("method"), (F.col("cluster") % k).cast("int").alias("cluster")) for k in KS])
    return emb(spark, sf).select("id", F.inline(marks))


def k_scores(spark, sf):
    out = validate.compare_methods(emb(spark, sf), labels_by_k(spark, sf))
    return select.optimal_k_scores(out.select(F.col("method").cast("int").alias("k"), "silhouette", "davies_bouldin", "calinski_harabasz"))


@query("optimal_k_scores", K_SCORES_SQL + """SELECT k, ROUND(silhouette, 4) AS silhouette, ROUND(davies_bouldin, 4) AS davies_bouldin,
  ROUND(calinski_harabasz, 4) AS calinski_harabasz, ROUND(score, 4) AS score, quality FROM scored""")
def optimal_k_scores(spark, sf):
    out = k_scores(spark, sf).withColumn("davies_bouldin", F.abs("davies_bouldin"))
    return rounded(out, "silhouette", "davies_bouldin", "calinski_harabasz", "score")


@query("optimal_k_votes", K_SCORES_SQL + """, votes AS (SELECT 'silhouette' AS metric, arg_max(k, silhouette) AS k FROM scored UNION ALL
  SELECT 'davies_bouldin', arg_min(k, davies_bouldin) FROM scored UNION ALL SELECT 'calinski_harabasz', arg_max(k, calinski_harabasz) FROM scored
  UNION ALL SELECT 'combined', arg_max(k, score) FROM scored),
counted AS (SELECT metric, k, count(*) OVER (PARTITION BY k) AS votes FROM votes), most AS (SELECT max(votes) AS m FROM counted)
SELECT metric, k, votes, CASE WHEN m >= 3 THEN 'strong' WHEN m = 2 THEN 'unclear' ELSE 'none' END AS consensus,
  CASE WHEN m >= 2 THEN (SELECT k FROM counted ORDER BY votes DESC, k LIMIT 1) ELSE (SELECT k FROM counted WHERE metric = 'combined') END AS suggested_k
FROM counted, most""")
def optimal_k_votes(spark, sf):
    return select.optimal_k_votes(k_scores(spark, sf).withColumn("davies_bouldin", F.abs("davies_bouldin")))


@query("elbow_table", with_(KS_SQL, metrics_sql("by_k")) + "SELECT CAST(method AS INTEGER) AS k, ROUND(sum(inertia), 4) AS inertia FROM spread GROUP BY method")
def elbow_table(spark, sf):
    out = select.elbow_table(emb(spark, sf), labels_by_k(spark, sf))
    return rounded(out.select(F.col("method").cast("int").alias("k"), "inertia"), "inertia")


@query("optimal_k_run")
def optimal_k_run(spark, sf):
    out = compare.determine_optimal_k(cust_scaled(spark, sf), range(2, 11), "kmeans", "multi")
    return rounded(out, "silhouette", "davies_bouldin", "calinski_harabasz", "score")


@query("compare_run")
def compare_run(spark, sf):
    scores, _, _ = compare.compare_run(user_unit(spark, sf), 3)
    best = compare.best_method(scores).select("method").scalar()
    return rounded(scores.withColumn("best", F.col("method") == best), "silhouette", "davies_bouldin", "calinski_harabasz")


@query("cluster_sizes", with_(EMB_NOISE_SQL) + "SELECT cluster, count(*) AS n, ROUND(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM emb_noise GROUP BY cluster")
def cluster_sizes(spark, sf):
    return select.cluster_sizes(emb_noise(spark, sf))
