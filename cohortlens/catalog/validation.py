"""Scores of given labelings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import validate
from cohortlens.catalog.base import CUST_NUM, CLUSTERS_SQL, EMB_NOISE_SQL, EMB_SQL, EMB_TWO_SQL, cust_clusters, emb, emb_labels, emb_noise, query, rounded, with_
from cohortlens.runtime import distributed_rank


def metrics_sql(lab: str) -> str:
    """CTEs scoring ``lab(id, method, cluster)`` on ``emb``."""
    return f"""lab AS (SELECT id, method, cluster FROM {lab} WHERE cluster >= 0),
pts AS (SELECT l.id, l.method, l.cluster, e.x FROM lab l JOIN emb e USING (id)),
sizes AS (SELECT method, cluster, count(*) AS n FROM lab GROUP BY method, cluster),
pair AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM emb a, emb b),
tot AS (SELECT a.id, a.method, a.cluster, b.cluster AS other, sum(p.d) AS s FROM lab a JOIN lab b ON a.method = b.method
  JOIN pair p ON p.i = a.id AND p.j = b.id GROUP BY ALL),
ab AS (SELECT t.id, t.method, t.cluster, sum(CASE WHEN other = t.cluster THEN s / nullif(n - 1, 0) END) AS a,
  min(CASE WHEN other <> t.cluster THEN s / n END) AS b FROM tot t JOIN sizes z ON z.method = t.method AND z.cluster = t.other GROUP BY ALL),
sil AS (SELECT id, method, cluster, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab),
cen_long AS (SELECT method, cluster, pos, avg(v) AS v FROM (SELECT method, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM pts) GROUP BY ALL),
cen AS (SELECT method, cluster, list(v ORDER BY pos) AS c FROM cen_long GROUP BY method, cluster),
spread AS (SELECT p.method, p.cluster, count(*) AS n, avg(list_distance(x, c)) AS s, sum(list_distance(x, c) ** 2) AS inertia, any_value(c) AS c
  FROM pts p JOIN cen USING (method, cluster) GROUP BY p.method, p.cluster),
db AS (SELECT method, avg(r) AS davies_bouldin FROM (SELECT a.method, a.cluster, max((a.s + b.s) / list_distance(a.c, b.c)) AS r
  FROM spread a JOIN spread b ON a.method = b.method AND a.cluster <> b.cluster GROUP BY a.method, a.cluster) GROUP BY method),
grand AS (SELECT method, list(v ORDER BY pos) AS g FROM (SELECT method, pos, avg(v) AS v FROM
  (SELECT method, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM pts) GROUP BY ALL) GROUP BY method),
ch AS (SELECT s.method, (sum(n * list_distance(c, g) ** 2) / (count(*) - 1)) / (sum(inertia) / (sum(n) - count(*))) AS calinski_harabasz
  FROM spread s JOIN grand USING (method) GROUP BY s.method)"""


LABEL_SQL = with_(EMB_NOISE_SQL, "one AS (SELECT id, 'labels' AS method, cluster FROM emb_noise)", metrics_sql("one"))


def noise_labels(spark, sf):
    return validate.one_method(emb_noise(spark, sf))


@query("silhouette_exact", LABEL_SQL + "SELECT method, ROUND(avg(silhouette), 4) AS silhouette FROM sil GROUP BY method")
def silhouette_exact(spark, sf):
    return rounded(validate.silhouette(emb(spark, sf), noise_labels(spark, sf)), "silhouette")


@query("silhouette_blocks", LABEL_SQL + "SELECT method, ROUND(avg(silhouette), 4) AS silhouette FROM sil GROUP BY method")
def silhouette_blocks(spark, sf):
    """The path of tables too large to broadcast."""
    return rounded(validate.silhouette(emb(spark, sf), noise_labels(spark, sf), broadcast_bytes=0, block_rows=64), "silhouette")


def far_emb(spark, sf):
    """The embeddings moved far from zero, which changes no distance."""
    return emb(spark, sf).withColumn("features", F.transform("features", lambda v: v + 1e8))


@query("silhouette_far", LABEL_SQL + "SELECT method, ROUND(avg(silhouette), 4) AS silhouette FROM sil GROUP BY method")
def silhouette_far(spark, sf):
    return rounded(validate.silhouette(far_emb(spark, sf), noise_labels(spark, sf)), "silhouette")


@query("calinski_harabasz_far", LABEL_SQL + "SELECT method, ROUND(calinski_harabasz, 4) AS calinski_harabasz FROM ch")
def calinski_harabasz_far(spark, sf):
    return rounded(validate.calinski_harabasz(validate.dispersion(far_emb(spark, sf), noise_labels(spark, sf))), "calinski_harabasz")


@query("silhouette_sq", LABEL_SQL.replace("list_distance(a.x, b.x) AS d FROM emb a", "list_distance(a.x, b.x) ** 2 AS d FROM emb a")
       + "SELECT method, ROUND(avg(silhouette), 4) AS silhouette FROM sil GROUP BY method")
def silhouette_sq(spark, sf):
    return rounded(validate.silhouette(emb(spark, sf), noise_labels(spark, sf), form="squared"), "silhouette")


@query("davies_bouldin", LABEL_SQL + "SELECT method, ROUND(davies_bouldin, 4) AS davies_bouldin FROM db")
def davies_bouldin(spark, sf):
    return rounded(validate.davies_bouldin(validate.dispersion(emb(spark, sf), noise_labels(spark, sf))), "davies_bouldin")


@query("calinski_harabasz", LABEL_SQL + "SELECT method, ROUND(calinski_harabasz, 4) AS calinski_harabasz FROM ch")
def calinski_harabasz(spark, sf):
    return rounded(validate.calinski_harabasz(validate.dispersion(emb(spark, sf), noise_labels(spark, sf))), "calinski_harabasz")


@query("silhouette_per_cluster", LABEL_SQL + "SELECT method, cluster, ROUND(avg(silhouette), 4) AS silhouette, count(*) AS n FROM sil GROUP BY method, cluster")
def silhouette_per_cluster(spark, sf):
    return rounded(validate.silhouette_per_cluster(emb(spark, sf), noise_labels(spark, sf)), "silhouette")


@query("silhouette_points", LABEL_SQL + """SELECT id, cluster, ROUND(silhouette, 4) AS silhouette,
  row_number() OVER (PARTITION BY cluster ORDER BY ROUND(silhouette, 4), id) AS rank FROM sil""")
def silhouette_points(spark, sf):
    points = rounded(validate.silhouette_points(emb(spark, sf), noise_labels(spark, sf)).drop("method"), "silhouette")
    return distributed_rank(points, ["cluster"], ["silhouette", "id"])


TRUTH_SQL = "truth AS (SELECT id, CAST(id % 10 AS INTEGER) AS truth FROM emb)"
CONT_SQL = """cells AS (SELECT method, truth AS t, cluster AS p, count(*) AS n FROM emb_two JOIN truth USING (id) GROUP BY ALL),
ra AS (SELECT method, t, sum(n) AS n FROM cells GROUP BY ALL), rb AS (SELECT method, p, sum(n) AS n FROM cells GROUP BY ALL),
tt AS (SELECT method, sum(n)::DOUBLE AS n FROM cells GROUP BY method),
sij AS (SELECT method, sum(n * (n - 1) / 2) AS v FROM cells GROUP BY method),
sa AS (SELECT method, sum(n * (n - 1) / 2) AS v FROM ra GROUP BY method), sb AS (SELECT method, sum(n * (n - 1) / 2) AS v FROM rb GROUP BY method),
ht AS (SELECT r.method, -sum(r.n / tt.n * ln(r.n / tt.n)) AS v FROM ra r JOIN tt USING (method) GROUP BY r.method),
hp AS (SELECT r.method, -sum(r.n / tt.n * ln(r.n / tt.n)) AS v FROM rb r JOIN tt USING (method) GROUP BY r.method),
mi AS (SELECT c.method, sum(c.n / tt.n * ln(c.n * tt.n / (ra.n * rb.n))) AS v FROM cells c JOIN tt USING (method)
  JOIN ra ON ra.method = c.method AND ra.t = c.t JOIN rb ON rb.method = c.method AND rb.p = c.p GROUP BY c.method),
ext AS (SELECT tt.method, (sij.v - sa.v * sb.v / (tt.n * (tt.n - 1) / 2)) / ((sa.v + sb.v) / 2 - sa.v * sb.v / (tt.n * (tt.n - 1) / 2)) AS ari,
  mi.v / ((ht.v + hp.v) / 2) AS nmi FROM tt JOIN sij USING (method) JOIN sa USING (method) JOIN sb USING (method)
  JOIN ht USING (method) JOIN hp USING (method) JOIN mi USING (method))"""


def truth_of(spark, sf):
    return emb(spark, sf).select("id", (F.col("id") % 10).cast("int").alias("truth"))


@query("ari_nmi", with_(EMB_TWO_SQL, TRUTH_SQL.replace("id % 10", "cluster"), CONT_SQL) + "SELECT method, ROUND(ari, 4) AS ari, ROUND(nmi, 4) AS nmi FROM ext")
def ari_nmi(spark, sf):
    truth = emb(spark, sf).select("id", F.col("cluster").alias("truth"))
    return rounded(validate.external_scores(emb_labels(spark, sf), truth), "ari", "nmi")


@query("confusion_matrix", with_(EMB_TWO_SQL, TRUTH_SQL.replace("id % 10", "cluster")) + "SELECT truth, " + ", ".join(
    f"CAST(sum(CASE WHEN cluster % 5 = {i} THEN 1 ELSE 0 END) AS BIGINT) AS pred_{i}" for i in range(10)) + " FROM emb JOIN truth USING (id) GROUP BY truth")
def confusion_matrix(spark, sf):
    truth = emb(spark, sf).select("id", F.col("cluster").alias("truth"))
    return validate.confusion_matrix(emb_labels(spark, sf).where("method = 'label_mod5'"), truth)


COMPARE_SQL = with_(EMB_TWO_SQL, TRUTH_SQL, CONT_SQL, metrics_sql("emb_two"))


@query("compare_methods", COMPARE_SQL + """SELECT e.method, ROUND(s.silhouette, 4) AS silhouette, ROUND(davies_bouldin, 4) AS davies_bouldin,
  ROUND(calinski_harabasz, 4) AS calinski_harabasz, ROUND(ari, 4) AS ari, ROUND(nmi, 4) AS nmi, c.n_clusters, c.noise_points
  FROM ext e JOIN (SELECT method, avg(silhouette) AS silhouette FROM sil GROUP BY method) s USING (method) JOIN db USING (method) JOIN ch USING (method)
  JOIN (SELECT method, count(DISTINCT cluster) AS n_clusters, CAST(sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) AS BIGINT) AS noise_points
        FROM emb_two GROUP BY method) c USING (method)""")
def compare_methods(spark, sf):
    out = validate.compare_methods(emb(spark, sf), emb_labels(spark, sf), truth_of(spark, sf))
    return rounded(out, "silhouette", "davies_bouldin", "calinski_harabasz", "ari", "nmi")


@query("best_methods", COMPARE_SQL + """SELECT 'silhouette' AS metric, (SELECT method FROM sil GROUP BY method ORDER BY avg(silhouette) DESC, method LIMIT 1) AS method
  UNION ALL SELECT 'davies_bouldin', (SELECT method FROM db ORDER BY davies_bouldin, method LIMIT 1)
  UNION ALL SELECT 'calinski_harabasz', (SELECT method FROM ch ORDER BY calinski_harabasz DESC, method LIMIT 1)""")
def best_methods(spark, sf):
    return validate.best_methods(validate.compare_methods(emb(spark, sf), emb_labels(spark, sf)))


@query("profile_mean", with_(CLUSTERS_SQL) + "SELECT cluster, " + ", ".join(f"ROUND(avg({c}), 4) AS {c}" for c in CUST_NUM) + " FROM cust_clusters GROUP BY cluster")
def profile_mean(spark, sf):
    return rounded(validate.profile_mean(cust_clusters(spark, sf), CUST_NUM), *CUST_NUM)
