"""Preparation of a mixed table: duplicates, roles, outliers, encoding, imputation, scaling.

Fitting reads small summaries (a few numbers per column); transforming is column
expressions over those numbers, so it needs no shuffle and also runs on a stream, except
for the nearest-neighbour imputation, which joins against the donors kept at fit time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.features import clean_nan, numeric_columns, to_long
from cohortlens.impute import knn_impute
from cohortlens.quantiles import group_quantiles
from cohortlens.runtime import cut, hash_first

MISSING_LEVEL = "__missing__"
BINARY, NOMINAL, CONTINUOUS = "binary", "nominal", "continuous"

# fixed values: Royston's (1995) polynomials for the W test, 12 <= n <= 5000
W_LAST = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
W_NEXT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
W_MU = (-1.5861, -0.31082, -0.083751, 0.0038915)
W_LOG_SIGMA = (-0.4803, -0.082676, 0.0030302)
Z_05 = 1.644854
NORMALITY_MIN, NORMALITY_MAX = 20, 5000


@dataclass(frozen=True)
class PrepSpec:
    id_col: str = "id"
    n_neighbors: int = 5
    remove_duplicates: bool = True
    outlier_method: str | None = None
    outlier_threshold: float = 3.0
    remove_outlier_rows: bool = False
    seed: int = 42
    max_categories: int = 10_000


# ---------------------------------------------------------------- duplicates and roles


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicates over all columns, the id included, unless ``subset`` is given."""
    return df.dropDuplicates(list(subset) if subset else None)


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``n_before, n_after, n_removed`` from one grouped count."""
    keys = list(subset) if subset else df.columns
    return df.groupBy(*keys).agg(F.count("*").alias("c")).agg(
        F.sum("c").alias("n_before"), F.count("*").alias("n_after"), (F.sum("c") - F.count("*")).alias("n_removed")
    )


def fit_roles(df: DataFrame, id_col: str) -> list[dict]:
    """Role of every column but the id, with its smallest and largest value.

    A role only depends on whether a column has at most two distinct values, so instead of
    counting distinct values the first pass takes min and max and the second asks whether
    any value differs from both: constant state per column, no shuffle of the values.
    """
    cols = [f for f in df.schema if f.name != id_col]
    for f in cols:
        if not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)):
            raise ValueError(f"column {f.name} has type {f.dataType.simpleString()}: cast it first")
    ends = df.agg(*[g(f.name).alias(f"{p}_{f.name}") for f in cols for p, g in (("lo", F.min), ("hi", F.max))]).first()
    lo = {f.name: ends[f"lo_{f.name}"] for f in cols}
    hi = {f.name: ends[f"hi_{f.name}"] for f in cols}

    def other(name: str) -> Column:
        if lo[name] is None:
            return F.lit(0)
        c = F.col(name)
        return F.when((c != F.lit(lo[name])) & (c != F.lit(hi[name])), 1).otherwise(0)

    more = df.agg(*[F.max(other(f.name)).alias(f.name) for f in cols]).first()
    roles = []
    for f in cols:
        name = f.name
        n = 0 if lo[name] is None else 1 if lo[name] == hi[name] else 3 if more[name] else 2
        if isinstance(f.dataType, T.BooleanType):
            role = BINARY
        elif isinstance(f.dataType, T.StringType):
            role = BINARY if n <= 2 else NOMINAL
        else:
            role = BINARY if n == 2 else CONTINUOUS
        roles.append({"feature": name, "role": role, "low": lo[name], "high": hi[name]})
    return roles


def column_roles(df: DataFrame, id_col: str) -> DataFrame:
    rows = [(r["feature"], r["role"]) for r in fit_roles(df, id_col)]
    return df.sparkSession.createDataFrame(rows, "feature string, role string")


# ---------------------------------------------------------------- outliers


def fit_outliers(df: DataFrame, cols: Sequence[str], method: str | None, threshold: float = 3.0) -> dict[str, Column]:
    """Flag expression per column. An unknown or absent method flags nothing."""
    cols = list(cols)
    if not cols or method not in ("zscore", "iqr"):
        return {}
    flags = {}
    if method == "zscore":
        row = df.agg(*[g(c).alias(f"{p}_{c}") for c in cols for p, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for c in cols:
            mean, std = row[f"m_{c}"], row[f"s_{c}"]
            bad = F.abs((F.col(c) - F.lit(mean)) / F.lit(std)) > threshold if std else F.lit(False)
            flags[c] = F.coalesce(bad, F.lit(False))
    else:
        quart = group_quantiles(to_long(df, [], cols), ["feature"], [0.25, 0.75]).collect()
        ends = {r.feature: r.q for r in quart}
        for c in cols:
            if c not in ends:
                flags[c] = F.lit(False)
                continue
            q1, q3 = ends[c]
            span = threshold * (q3 - q1)
            flags[c] = F.coalesce((F.col(c) < q1 - span) | (F.col(c) > q3 + span), F.lit(False))
    return flags


def any_flag(flags: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, flags.values(), F.lit(False))


def outlier_summary(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``feature, n_outliers`` plus the row ``(any)``: rows with at least one flag."""
    named = {**flags, "(any)": any_flag(flags)}
    sums = df.agg(*[F.sum(v.cast("int")).alias(k) for k, v in named.items()])
    return sums.unpivot([], list(named), "feature", "n_outliers").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))


# ---------------------------------------------------------------- encoding


def encode_binary(name: str, low, high) -> Column:
    """Sorted values to 0/1; NULL and unknown values to NULL."""
    if low is None:
        return F.lit(None).cast("double")
    return F.when(F.col(name) == F.lit(low), 0.0).when(F.col(name) == F.lit(high), 1.0)


def fit_categories(df: DataFrame, cols: Sequence[str], max_categories: int = 10_000) -> dict[str, list[str]]:
    """Sorted categories per nominal column; gaps are the category ``__missing__``.

    Each category becomes a column, so a column with more than ``max_categories`` is refused: it
    is no nominal feature. Categories are counted on Spark before any is collected.
    """
    if not cols:
        return {}
    filled = df.select(*[F.coalesce(F.col(c), F.lit(MISSING_LEVEL)).alias(c) for c in cols])
    pairs = filled.unpivot([], list(cols), "feature", "value").distinct()
    pairs = pairs.persist()
    wide = pairs.groupBy("feature").count().where(F.col("count") > max_categories).collect()
    if wide:
        raise ValueError(f"more than {max_categories} categories in {sorted(r.feature for r in wide)}")
    rows = pairs.collect()
    pairs.unpersist()
    return {c: sorted(r.value for r in rows if r.feature == c) for c in cols}


def encode_onehot(name: str, categories: Sequence[str]) -> list[Column]:
    """One 0/1 column per category but the first; an unknown value gives zeros."""
    filled = F.coalesce(F.col(name), F.lit(MISSING_LEVEL))
    return [(filled == F.lit(v)).cast("double").alias(f"{name}_{v}") for v in categories[1:]]


# ---------------------------------------------------------------- normality


def w_coefficients(n: int) -> list[float]:
    """Weights of the ordered sample in the W statistic."""
    inv = NormalDist().inv_cdf
    m = [inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    total, u = sum(v * v for v in m), n**-0.5
    powers = [u, u**2, u**3, u**4, u**5]
    last = m[-1] / total**0.5 + sum(c * p for c, p in zip(W_LAST, powers))
    prev = m[-2] / total**0.5 + sum(c * p for c, p in zip(W_NEXT, powers))
    phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
    inner = [v / phi**0.5 for v in m[2:-2]]
    return [-last, -prev, *inner, prev, last]


def normality(df: DataFrame, cols: Sequence[str], id_col: str, seed: int = 42, max_n: int = NORMALITY_MAX) -> DataFrame:
    """``feature, n, w, is_normal``: Shapiro-Wilk at 5 % on at most 5000 values per column.

    The sample is the first rows by a hash of the id, so it does not depend on the
    partitioning; fewer than 20 values count as not normal.
    """
    spark = df.sparkSession
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    drawn = []
    for c in cols:  # each column has its own gaps, so its own sample
        own = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col(id_col).alias("id"))
        drawn.append(hash_first(own, max_n, seed, counts[c]))
    sample = cut(reduce(DataFrame.unionByName, drawn))
    w = Window.partitionBy("feature").orderBy("x", "id")
    ranked = sample.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("feature")))
    sizes = [r.n for r in sample.groupBy("feature").agg(F.count("*").alias("n")).select("n").distinct().collect()]
    weights = [(n, w_coefficients(n)) for n in sizes if n >= NORMALITY_MIN]
    table = spark.createDataFrame(weights, "n bigint, a array<double>")
    stats = ranked.join(F.broadcast(table), "n", "left").groupBy("feature").agg(
        F.first("n").alias("n"),
        (F.sum(F.element_at("a", F.col("i")) * F.col("x")) ** 2).alias("num"),
        (F.var_pop("x") * F.count("*")).alias("den"),
    )
    ln = F.log(F.col("n"))

    def poly(coef):
        return sum((F.lit(c) * F.pow(ln, F.lit(float(p))) for p, c in enumerate(coef)), F.lit(0.0))

    stats = stats.withColumn("w", F.when(F.col("den") > 0, F.col("num") / F.col("den")))
    z = (F.log(1 - F.least("w", F.lit(1.0 - 1e-15))) - poly(W_MU)) / F.exp(poly(W_LOG_SIGMA))
    decided = F.when((F.col("n") < NORMALITY_MIN) | F.col("w").isNull(), False).otherwise(z < Z_05)
    return stats.select("feature", "n", "w", decided.alias("is_normal"))


# ---------------------------------------------------------------- scaling


@dataclass(frozen=True)
class Scale:
    kind: str  # "standard" or "minmax"
    shift: float
    scale: float


def fit_scales(df: DataFrame, kinds: dict[str, str]) -> dict[str, Scale]:
    """Population-std standard scaling or min-max; a constant column has scale 1."""
    if not kinds:
        return {}
    parts = (("avg", F.avg), ("std", F.stddev_pop), ("lo", F.min), ("hi", F.max))
    row = df.agg(*[g(c).alias(f"{p}_{c}") for c in kinds for p, g in parts]).first()
    out = {}
    for c, kind in kinds.items():
        if row[f"avg_{c}"] is None:
            out[c] = Scale(kind, 0.0, 1.0)
        elif kind == "standard":
            out[c] = Scale(kind, float(row[f"avg_{c}"]), float(row[f"std_{c}"]) or 1.0)
        else:
            out[c] = Scale(kind, float(row[f"lo_{c}"]), float(row[f"hi_{c}"] - row[f"lo_{c}"]) or 1.0)
    return out


def apply_scales(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return df.select(*[((F.col(c) - scales[c].shift) / scales[c].scale).alias(c) if c in scales else F.col(c) for c in df.columns])


def invert_scales(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return df.select(*[(F.col(c) * scales[c].scale + scales[c].shift).alias(c) if c in scales else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- the whole preparation


@dataclass(frozen=True)
class PrepModel:
    spec: PrepSpec
    roles: list[dict]
    categories: dict[str, list[str]]
    scales: dict[str, Scale] = field(default_factory=dict)
    donors: DataFrame | None = None

    def _names(self, role: str) -> list[str]:
        return [r["feature"] for r in self.roles if r["role"] == role]

    @property
    def onehot_names(self) -> list[str]:
        return [f"{c}_{v}" for c in self._names(NOMINAL) for v in self.categories[c][1:]]

    @property
    def feature_names(self) -> list[str]:
        """Output order: binary, continuous, one-hot."""
        return self._names(BINARY) + self._names(CONTINUOUS) + self.onehot_names

    def encode(self, df: DataFrame) -> DataFrame:
        df = clean_nan(df)
        ends = {r["feature"]: (r["low"], r["high"]) for r in self.roles}
        out: list[Column] = [F.col(self.spec.id_col)]
        for c in self._names(BINARY):
            if c in df.columns:
                out.append(encode_binary(c, *ends[c]).alias(c))
        out += [F.col(c).cast("double").alias(c) for c in self._names(CONTINUOUS) if c in df.columns]
        for c in self._names(NOMINAL):
            if c in df.columns:
                out += encode_onehot(c, self.categories[c])
        return df.select(*out)

    def impute(self, encoded: DataFrame) -> DataFrame:
        cols = [c for c in self.feature_names if c in encoded.columns]
        return knn_impute(encoded, self.donors, self.spec.id_col, cols, self.spec.n_neighbors)

    def transform(self, df: DataFrame) -> DataFrame:
        """Prepared rows: ``id`` and the features; a column absent from ``df`` is 0."""
        if self.donors is None:
            raise ValueError("preparation must be fitted before transform")
        work = apply_scales(self.impute(self.encode(df)), self.scales)
        have = set(work.columns)
        return work.select(self.spec.id_col, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in self.feature_names])

    def inverse(self, df: DataFrame) -> DataFrame:
        """Continuous columns back in their original units."""
        if self.donors is None:
            raise ValueError("preparation must be fitted before inverse")
        return invert_scales(df, self.scales)

    def roles_table(self) -> DataFrame:
        """Column, type, encoding and scaling of every input column."""
        rows = []
        for role, enc in ((BINARY, "0/1"), (NOMINAL, "one-hot, first dropped"), (CONTINUOUS, "none")):
            for c in self._names(role):
                rows.append((c, role, enc, self.scales[c].kind if c in self.scales else "none"))
        return self.donors.sparkSession.createDataFrame(rows, "feature string, role string, encoding string, scaling string")

    def save(self, path: str) -> None:
        """Parameters as one JSON line, donors as Parquet."""
        params = {
            "spec": asdict(self.spec), "roles": self.roles, "categories": self.categories,
            "scales": {c: asdict(s) for c, s in self.scales.items()},
        }
        spark = self.donors.sparkSession
        spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
        self.donors.write.mode("overwrite").parquet(f"{path}/donors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PrepModel":
        params = json.loads(spark.read.text(f"{path}/params").first().value)
        return cls(
            PrepSpec(**params["spec"]), params["roles"], params["categories"],
            {c: Scale(**s) for c, s in params["scales"].items()}, spark.read.parquet(f"{path}/donors"),
        )


@dataclass(frozen=True)
class PrepResult:
    model: PrepModel
    data: DataFrame
    outliers: DataFrame
    outlier_ids: DataFrame


def fit(df: DataFrame, spec: PrepSpec = PrepSpec()) -> PrepResult:
    """Fit a preparation and return it with the prepared fit rows."""
    work = clean_nan(df)
    if spec.remove_duplicates:
        work = drop_duplicate_rows(work)
    work = cut(work)
    roles = fit_roles(work, spec.id_col)
    continuous = [r["feature"] for r in roles if r["role"] == CONTINUOUS]
    flags = fit_outliers(work, continuous, spec.outlier_method, spec.outlier_threshold)
    flagged = work.where(any_flag(flags)).select(spec.id_col)
    report = outlier_summary(work, flags)
    if spec.remove_outlier_rows and flags:
        work = work.where(~any_flag(flags))
        # ends of the binary columns are those of the rows that are left
        ends = {r["feature"]: r for r in fit_roles(work, spec.id_col)}
        roles = [{**r, "low": ends[r["feature"]]["low"], "high": ends[r["feature"]]["high"]} for r in roles]
    nominal = [r["feature"] for r in roles if r["role"] == NOMINAL]
    draft = PrepModel(spec, roles, fit_categories(work, nominal, spec.max_categories))
    encoded = draft.encode(work)  # cheap expressions over the checkpointed rows
    model = PrepModel(spec, roles, draft.categories, {}, encoded)
    imputed = cut(model.impute(encoded))
    kinds = {}
    if continuous:
        verdict = {r.feature: r.is_normal for r in normality(imputed, continuous, spec.id_col, spec.seed).collect()}
        kinds = {c: "standard" if verdict.get(c) else "minmax" for c in continuous}
    scales = fit_scales(imputed, kinds)
    model = PrepModel(spec, roles, draft.categories, scales, encoded)
    data = apply_scales(imputed, scales).select(spec.id_col, *model.feature_names)
    return PrepResult(model, data, report, flagged)


def numeric_fill(df: DataFrame, id_col: str) -> DataFrame:
    """Bypass: numeric columns only, gaps as 0."""
    cols = numeric_columns(df, exclude=[id_col])
    return clean_nan(df).select(id_col, *cols).fillna(0, subset=cols)
