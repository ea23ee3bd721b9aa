"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from cohortlens import catalog
from cohortlens.runtime import get_session

HEADLINE = [
    "overview", "describe_numeric", "profile_columns", "column_roles", "dedup_rows", "outliers_iqr", "knn_impute", "prep_full",
    "assign_nearest", "kmeans_fit", "kmedoids_step", "gmm_fit", "gmm_auto_bic", "core_distance", "silhouette_exact", "silhouette_sq",
    "compare_methods", "ari_nmi", "profile_stats", "contrastive", "pca_project", "surrogate_importance", "shap_importance",
    "permutation_importance", "local_distance", "local_membership", "cf_nearest", "cf_optimize",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    queries["scan_counts"](spark, sf_dir).collect()  # start the executors
    queries["assign_nearest"](spark, sf_dir).collect()  # and the Python workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
