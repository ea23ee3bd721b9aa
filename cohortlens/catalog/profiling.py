"""Sources and profiles."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from cohortlens import profile, sources
from cohortlens.catalog.base import CUST_NUM, CUST_SQL, GAPS_SQL, cust_features, cust_gaps, query, rounded, table, union_sql, with_
from cohortlens.runtime import shared_dir

SCANNED = ["customer", "orders", "events", "embeddings", "documents"]


@query("scan_counts", union_sql(SCANNED, "SELECT '{c}' AS source, count(*) AS n FROM {c}"))
def scan_counts(spark, sf):
    parts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("source"), "n") for t in SCANNED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf):
    """The customers written as CSV to the shared folder and read back by schema."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sources.write_csv(customers, path)
    return sources.read_csv(spark, path, customers.schema)


GAP_COLS = ["id", "acctbal", "segment", "in_debt", "n_orders", "spend_mean", "urgent_share", "open_share"]
GAP_COUNT = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in GAP_COLS)


@query("overview", with_(GAPS_SQL) + f"""SELECT count(*) AS n_rows, CAST({len(GAP_COLS) - 1} AS BIGINT) AS n_features,
  ROUND(sum({GAP_COUNT}) * 100.0 / (count(*) * {len(GAP_COLS)}), 4) AS missing_pct FROM cust_gaps""")
def overview(spark, sf):
    return rounded(profile.overview(cust_gaps(spark, sf), not_features=1), "missing_pct")


@query("describe_numeric", with_(GAPS_SQL) + "SELECT feature, CAST(count(value) AS BIGINT) AS count, ROUND(avg(value), 4) AS mean, "
       "ROUND(stddev_samp(value), 4) AS std, ROUND(min(value), 4) AS min, ROUND(quantile_cont(value, 0.25), 4) AS q25, "
       "ROUND(quantile_cont(value, 0.5), 4) AS q50, ROUND(quantile_cont(value, 0.75), 4) AS q75, ROUND(max(value), 4) AS max FROM ("
       + union_sql(CUST_NUM, "SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM cust_gaps") + ") GROUP BY feature")
def describe_numeric(spark, sf):
    out = profile.describe_numeric(cust_gaps(spark, sf), CUST_NUM)
    return rounded(out, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("missing_table", with_(GAPS_SQL) + "SELECT * FROM ("
       + union_sql(GAP_COLS, "SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
                   "ROUND(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS percentage FROM cust_gaps")
       + ") WHERE missing > 0")
def missing_table(spark, sf):
    return profile.missing_table(cust_gaps(spark, sf))


@query("profile_columns", with_(GAPS_SQL) + "SELECT feature, CAST(count(DISTINCT value) AS BIGINT) AS n_distinct, "
       "ROUND(100.0 * sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) / count(value), 4) AS zero_pct, "
       "ROUND(100.0 * sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) / count(value), 4) AS negative_pct, "
       "ROUND(skewness(value), 4) AS skewness, ROUND(kurtosis(value), 4) AS kurtosis FROM ("
       + union_sql(CUST_NUM, "SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM cust_gaps") + ") GROUP BY feature")
def profile_columns(spark, sf):
    out = profile.profile_columns(cust_gaps(spark, sf), CUST_NUM)
    return rounded(out, "zero_pct", "negative_pct", "skewness", "kurtosis")


TOP_COLS = ["segment", "in_debt", "n_orders"]


@query("profile_topvalues", with_(GAPS_SQL) + "SELECT feature, value, n, CAST(rank AS INTEGER) AS rank FROM ("
       "SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM (SELECT feature, value, count(*) AS n FROM ("
       + union_sql(TOP_COLS, "SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM cust_gaps WHERE {c} IS NOT NULL")
       + ") GROUP BY feature, value)) WHERE rank <= 10")
def profile_topvalues(spark, sf):
    return profile.top_values(cust_gaps(spark, sf), TOP_COLS, 10)


@query("profile_corr", with_(GAPS_SQL) + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(corr({a}, {b}), 4) AS corr FROM cust_gaps" for a, b in combinations(CUST_NUM, 2)))
def profile_corr(spark, sf):
    return rounded(profile.correlation(cust_gaps(spark, sf), CUST_NUM), "corr")


@query("preview", with_(CUST_SQL) + "SELECT id, acctbal, segment, in_debt, n_orders, ROUND(spend_mean, 6) AS spend_mean, "
       "ROUND(urgent_share, 6) AS urgent_share, ROUND(open_share, 6) AS open_share FROM cust_features ORDER BY id LIMIT 10")
def preview(spark, sf):
    return rounded(profile.preview(cust_features(spark, sf), "id", 10), "spend_mean", "urgent_share", "open_share", digits=6)
