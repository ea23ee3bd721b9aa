"""Preparation steps, one by one and as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens import impute, prepare
from cohortlens.catalog.base import (
    CUST_NUM, CUST_SQL, DUPS_SQL, GAPS_SQL, SEGMENTS, USER_LONG_SQL, USER_NUM, cust_dups, cust_features, cust_gaps, query,
    rounded, table, union_sql, user_features, with_,
)
from cohortlens.features import to_long
from cohortlens.runtime import shared_dir

ALL = "id, acctbal, segment, in_debt, n_orders, ROUND(spend_mean, 6) AS spend_mean, ROUND(urgent_share, 6) AS urgent_share, ROUND(open_share, 6) AS open_share"


@query("dedup_rows", with_(DUPS_SQL) + f"SELECT {ALL} FROM (SELECT DISTINCT * FROM cust_dups)")
def dedup_rows(spark, sf):
    return rounded(prepare.drop_duplicate_rows(cust_dups(spark, sf)), "spend_mean", "urgent_share", "open_share", digits=6)


@query("dedup_report", with_(DUPS_SQL) + """SELECT CAST((SELECT count(*) FROM cust_dups) AS BIGINT) AS n_before,
  count(*) AS n_after, CAST((SELECT count(*) FROM cust_dups) - count(*) AS BIGINT) AS n_removed FROM (SELECT DISTINCT * FROM cust_dups)""")
def dedup_report(spark, sf):
    return prepare.duplicate_report(cust_dups(spark, sf))


@query("column_roles", with_(GAPS_SQL) + union_sql(
    ["acctbal", "n_orders", "spend_mean", "urgent_share", "open_share"],
    "SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'continuous' END AS role FROM cust_gaps")
    + """ UNION ALL SELECT 'in_debt', 'binary'
    UNION ALL SELECT 'segment', CASE WHEN count(DISTINCT segment) <= 2 THEN 'binary' ELSE 'nominal' END FROM cust_gaps""")
def column_roles(spark, sf):
    return prepare.column_roles(cust_gaps(spark, sf), "id")


# ------------------------------------------------------------------ outliers


def event_values(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")


Z_SQL = "abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) > 3.0"
IQR_SQL = """(value < (SELECT quantile_cont(value, 0.25) - 3.0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)
  OR value > (SELECT quantile_cont(value, 0.75) + 3.0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events))"""


@query("outliers_zscore", f"SELECT event_id AS id, value FROM events WHERE {Z_SQL}")
def outliers_zscore(spark, sf):
    df = event_values(spark, sf)
    return df.where(prepare.fit_outliers(df, ["value"], "zscore")["value"])


@query("outliers_iqr", f"SELECT event_id AS id, value FROM events WHERE {IQR_SQL}")
def outliers_iqr(spark, sf):
    df = event_values(spark, sf)
    return df.where(prepare.fit_outliers(df, ["value"], "iqr")["value"])


@query("outlier_summary", " UNION ALL ".join(
    f"SELECT '{m}' AS method, '{f}' AS feature, CAST(count(*) AS BIGINT) AS n_outliers FROM events WHERE {s}"
    for m, s in (("zscore", Z_SQL), ("iqr", IQR_SQL)) for f in ("value", "(any)")))
def outlier_summary(spark, sf):
    df = event_values(spark, sf)
    parts = [
        prepare.outlier_summary(df, prepare.fit_outliers(df, ["value"], m)).select(F.lit(m).alias("method"), "feature", "n_outliers")
        for m in ("zscore", "iqr")
    ]
    return parts[0].unionByName(parts[1])


@query("outlier_removed", f"SELECT event_id AS id, value FROM events WHERE NOT ({Z_SQL})")
def outlier_removed(spark, sf):
    df = event_values(spark, sf)
    return df.where(~prepare.any_flag(prepare.fit_outliers(df, ["value"], "zscore")))


# ------------------------------------------------------------------ encoding

LEVELS = [*SEGMENTS, prepare.MISSING_LEVEL]  # in sorted order; the first is dropped


@query("encode_binary", with_(GAPS_SQL) + "SELECT id, CASE WHEN in_debt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS in_debt FROM cust_gaps")
def encode_binary(spark, sf):
    df = cust_gaps(spark, sf)
    ends = {r["feature"]: r for r in prepare.fit_roles(df.select("id", "in_debt"), "id")}["in_debt"]
    return df.select("id", prepare.encode_binary("in_debt", ends["low"], ends["high"]).alias("in_debt"))


@query("encode_onehot", with_(GAPS_SQL) + "SELECT id, " + ", ".join(
    f"CAST(coalesce(segment, '__missing__') = '{v}' AS DOUBLE) AS \"segment_{v}\"" for v in LEVELS[1:]) + " FROM cust_gaps")
def encode_onehot(spark, sf):
    df = cust_gaps(spark, sf)
    levels = prepare.fit_categories(df, ["segment"])["segment"]
    return df.select("id", *prepare.encode_onehot("segment", levels))


# ------------------------------------------------------------------ imputation


def impute_sql(long: str, donors: str, width: int, k: int) -> str:
    """CTEs that fill the gaps of ``long`` from ``donors`` (both id, pos, value)."""
    return f"""gap_cells AS (SELECT id, pos FROM {long} WHERE value IS NULL),
gap_known AS (SELECT * FROM {long} WHERE value IS NOT NULL AND id IN (SELECT id FROM gap_cells)),
gap_pairs AS (SELECT q.id AS qid, d.id AS did, sqrt({width}.0 / count(*) * sum((q.value - d.value) * (q.value - d.value))) AS dist
  FROM gap_known q JOIN {donors} d ON d.pos = q.pos AND d.value IS NOT NULL GROUP BY 1, 2),
gap_ranked AS (SELECT g.id, g.pos, d.value, row_number() OVER (PARTITION BY g.id, g.pos ORDER BY round(p.dist, 9), p.did) AS r
  FROM gap_cells g JOIN gap_pairs p ON p.qid = g.id JOIN {donors} d ON d.id = p.did AND d.pos = g.pos AND d.value IS NOT NULL),
gap_fills AS (SELECT id, pos, avg(value) AS fill FROM gap_ranked WHERE r <= {k} GROUP BY id, pos),
imputed AS (SELECT l.id, l.pos, coalesce(l.value, f.fill) AS value FROM {long} l LEFT JOIN gap_fills f ON f.id = l.id AND f.pos = l.pos)"""


NUM_LONG_SQL = "num_long AS (" + union_sql(CUST_NUM, "SELECT id, {i} AS pos, CAST({c} AS DOUBLE) AS value FROM cust_gaps") + ")"


@query("knn_impute", with_(GAPS_SQL, NUM_LONG_SQL, impute_sql("num_long", "num_long", len(CUST_NUM), 5)) + "SELECT id, " + ", ".join(
    f"ROUND(max(value) FILTER (WHERE pos = {i}), 6) AS {c}" for i, c in enumerate(CUST_NUM)) + " FROM imputed GROUP BY id")
def knn_impute(spark, sf):
    df = cust_gaps(spark, sf).select("id", *[F.col(c).cast("double").alias(c) for c in CUST_NUM])
    return rounded(impute.knn_impute(df, df, "id", CUST_NUM, 5), *CUST_NUM, digits=6)


@query("knn_k_search", with_(GAPS_SQL, NUM_LONG_SQL, f"""hidden AS (
  SELECT id, pos, value AS truth FROM num_long WHERE value IS NOT NULL ORDER BY (id * 7919 + pos * 104729) % 10007, id, pos LIMIT 100),
known AS (SELECT h.id, h.pos AS hpos, h.truth, l.pos, l.value FROM hidden h JOIN num_long l ON l.id = h.id AND l.pos <> h.pos AND l.value IS NOT NULL),
pairs AS (SELECT q.id, q.hpos, any_value(q.truth) AS truth, d.id AS did, sqrt({len(CUST_NUM)}.0 / count(*) * sum((q.value - d.value) * (q.value - d.value))) AS dist
  FROM known q JOIN num_long d ON d.pos = q.pos AND d.value IS NOT NULL AND d.id <> q.id GROUP BY q.id, q.hpos, d.id),
ranked AS (SELECT p.id, p.hpos, p.truth, d.value, row_number() OVER (PARTITION BY p.id, p.hpos ORDER BY round(p.dist, 9), p.did) AS r
  FROM pairs p JOIN num_long d ON d.id = p.did AND d.pos = p.hpos AND d.value IS NOT NULL),
guesses AS (SELECT r.id, r.hpos, any_value(truth) AS truth, ks.k, avg(value) AS guess FROM ranked r, (SELECT unnest(range(2, 16)) AS k) ks
  WHERE r.r <= ks.k GROUP BY r.id, r.hpos, ks.k)""") + "SELECT CAST(k AS INTEGER) AS k, ROUND(avg((truth - guess) * (truth - guess)), 4) AS mse FROM guesses GROUP BY k")
def knn_k_search(spark, sf):
    df = cust_gaps(spark, sf).select("id", *[F.col(c).cast("double").alias(c) for c in CUST_NUM])
    order = (F.col("id") * 7919 + F.col("slot") * 104729) % 10007
    return rounded(impute.knn_k_search(df, "id", CUST_NUM, cell_order=order), "mse")


# ------------------------------------------------------------------ normality

# fixed values: Wichura's (1988) AS 241 rational approximation of the normal quantile
AS241 = {
    "mid": ((2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
             1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
            (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
             5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)),
    "near": ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
              3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
             (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
              6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)),
}


def _horner(coef, x: str) -> str:
    out = f"{coef[0]!r}::DOUBLE"
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_quantile_sql(p: str) -> str:
    """Valid for 1e-11 < p < 1 - 1e-11, far beyond what 5000 ranks need."""
    r, tail = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    mid, near = AS241["mid"], AS241["near"]
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_horner(mid[0], r)} / {_horner(mid[1], r)} "
            f"ELSE sign({p} - 0.5) * {_horner(near[0], tail)} / {_horner(near[1], tail)} END")


def normality_sql(long: str) -> str:
    """CTEs ending in ``verdict(feature, n, w, is_normal)`` for ``long(feature, id, value)``."""
    last = " + ".join(f"({c!r}) * pow(u, {i + 1})" for i, c in enumerate(prepare.W_LAST))
    prev = " + ".join(f"({c!r}) * pow(u, {i + 1})" for i, c in enumerate(prepare.W_NEXT))
    mu = " + ".join(f"({c!r}) * pow(ln(n), {i})" for i, c in enumerate(prepare.W_MU))
    sigma = " + ".join(f"({c!r}) * pow(ln(n), {i})" for i, c in enumerate(prepare.W_LOG_SIGMA))
    return f"""w_ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value, id) AS i, count(*) OVER (PARTITION BY feature) AS n FROM {long}),
w_p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM w_ranked),
w_m AS (SELECT *, {normal_quantile_sql('p')} AS m FROM w_p),
w_ends AS (SELECT feature, any_value(n) AS n, sum(m * m) AS total, max(m) FILTER (WHERE i = n) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, 1 / sqrt(any_value(n)) AS u FROM w_m GROUP BY feature),
w_tail AS (SELECT *, m1 / sqrt(total) + {last} AS a1, m2 / sqrt(total) + {prev} AS a2 FROM w_ends),
w_phi AS (SELECT *, (total - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM w_tail),
w_stat AS (SELECT r.feature, any_value(r.n) AS n, pow(sum(value * CASE WHEN i = r.n THEN a1 WHEN i = r.n - 1 THEN a2 WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 ELSE m / sqrt(phi) END), 2)
  / (var_pop(value) * count(*)) AS w FROM w_m r JOIN w_phi USING (feature) GROUP BY r.feature),
verdict AS (SELECT feature, n, w, n >= 20 AND (ln(1 - w) - ({mu})) / exp({sigma}) < {prepare.Z_05} AS is_normal FROM w_stat)"""


@query("normality", with_(USER_LONG_SQL, normality_sql("user_long"))
       + "SELECT feature, n, CASE WHEN n >= 20 THEN ROUND(w, 4) END AS w, is_normal FROM verdict")
def normality(spark, sf):
    return rounded(prepare.normality(user_features(spark, sf), USER_NUM, "id"), "w")


# ------------------------------------------------------------------ scaling


@query("scale_minmax", with_(USER_LONG_SQL) + """SELECT id, feature, ROUND((value - lo) / CASE WHEN span = 0 THEN 1.0 ELSE span END, 4) AS value
  FROM user_long JOIN user_range USING (feature)""")
def scale_minmax(spark, sf):
    df = user_features(spark, sf)
    out = prepare.apply_scales(df, prepare.fit_scales(df, {c: "minmax" for c in USER_NUM}))
    return rounded(to_long(out, ["id"], USER_NUM), "value")


@query("scale_standard", with_(USER_LONG_SQL) + """SELECT id, feature, ROUND((value - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END, 4) AS value
  FROM user_long JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM user_long GROUP BY feature) USING (feature)""")
def scale_standard(spark, sf):
    df = user_features(spark, sf)
    out = prepare.apply_scales(df, prepare.fit_scales(df, {c: "standard" for c in USER_NUM}))
    return rounded(to_long(out, ["id"], USER_NUM), "value")


# ------------------------------------------------------------------ the whole

PREP_NAMES = ["in_debt", *CUST_NUM, *[f"segment_{v}" for v in LEVELS[1:]]]


def prep_sql(fit_rows: str, out_rows: str, scaled: bool = True) -> str:
    exprs = ["CAST(in_debt AS INTEGER)", *CUST_NUM, *[f"CAST(coalesce(segment, '__missing__') = '{v}' AS INTEGER)" for v in LEVELS[1:]]]
    enc = " UNION ALL ".join(
        f"SELECT id, {i} AS pos, '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM cust_gaps" for i, (n, e) in enumerate(zip(PREP_NAMES, exprs)))
    cont = f"pos BETWEEN 1 AND {len(CUST_NUM)}"
    value = "CASE WHEN s.feature IS NULL THEN i.value ELSE (i.value - s.shift) / s.scale END" if scaled else "i.value"
    return with_(
        GAPS_SQL, f"enc AS ({enc})", f"enc_fit AS (SELECT * FROM enc WHERE {fit_rows})", impute_sql("enc", "enc_fit", len(PREP_NAMES), 5),
        f"cont_fit AS (SELECT i.id, e.feature, i.value FROM imputed i JOIN enc_fit e USING (id, pos) WHERE {cont})",
        normality_sql("cont_fit"),
        """scales AS (SELECT feature, CASE WHEN any_value(is_normal) THEN avg(value) ELSE min(value) END AS shift,
             CASE WHEN any_value(is_normal) THEN stddev_pop(value) ELSE max(value) - min(value) END AS scale
           FROM cont_fit JOIN verdict USING (feature) GROUP BY feature)""",
    ) + f"""SELECT i.id, e.feature, ROUND({value}, 6) AS value FROM imputed i JOIN enc e USING (id, pos)
      LEFT JOIN scales s ON s.feature = e.feature WHERE {out_rows}"""


@query("prep_full", prep_sql("true", "true"))
def prep_full(spark, sf):
    return rounded(to_long(prepare.fit(cust_gaps(spark, sf)).data, ["id"], PREP_NAMES), "value", digits=6)


def _split(spark, sf):
    df = cust_gaps(spark, sf)
    return prepare.fit(df.where("id % 5 <> 0")).model, df.where("id % 5 = 0")


@query("prep_transform", prep_sql("id % 5 <> 0", "i.id % 5 = 0"))
def prep_transform(spark, sf):
    model, new = _split(spark, sf)
    return rounded(to_long(model.transform(new), ["id"], PREP_NAMES), "value", digits=6)


@query("prep_roundtrip", prep_sql("id % 5 <> 0", "i.id % 5 = 0"))
def prep_roundtrip(spark, sf):
    model, new = _split(spark, sf)
    path = f"{shared_dir(spark)}/prep-{uuid.uuid4().hex}"
    model.save(path)
    return rounded(to_long(prepare.PrepModel.load(spark, path).transform(new), ["id"], PREP_NAMES), "value", digits=6)


@query("prep_inverse", prep_sql("true", "true", scaled=False))
def prep_inverse(spark, sf):
    out = prepare.fit(cust_gaps(spark, sf))
    return rounded(to_long(out.model.inverse(out.data), ["id"], PREP_NAMES), "value", digits=6)


@query("numeric_fill", with_(GAPS_SQL) + "SELECT id, coalesce(acctbal, 0) AS acctbal, n_orders, "
       "ROUND(coalesce(spend_mean, 0), 6) AS spend_mean, ROUND(urgent_share, 6) AS urgent_share, ROUND(open_share, 6) AS open_share FROM cust_gaps")
def numeric_fill(spark, sf):
    return rounded(prepare.numeric_fill(cust_gaps(spark, sf), "id"), "spend_mean", "urgent_share", "open_share", digits=6)
