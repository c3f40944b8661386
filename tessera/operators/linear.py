"""Linear families (M1 OLS, M2 Ridge, M3 Lasso) for every series from one Gram pass.

All series share the design matrix X and differ only in their label, so the
centred cross-products ``Xc'Xc`` and ``Xc'Yc`` for *all* series come from a
single distributed pass over per-t rows ``[x_t | y_1t .. y_St]``
(``Correlation.corr`` + ``Summarizer``: per-partition partial sums,
tree-reduced; the (p+S)^2 result is bounded by the feature and series
counts, never by rows). Each series is then a p x p solve on the driver:

* OLS   beta = pinv(Cxx) Cxy   (the minimum-norm least-squares solution when
  p >= n, like ``lstsq``; T16)
* Ridge beta = (Cxx + alpha I)^-1 Cxy   (sklearn objective, intercept free)
* Lasso covariance-form coordinate descent on (1/2n)||y - Xb||^2 + alpha|b|_1
  (sklearn objective)

Where the rows are few against the features (rows x features up to
``LOCAL_CELLS``, as in the reference's 289 x 1,546), nothing of size p^2 is
made: ``fit_series`` groups the series by ``SERIES_GROUP``, and a task per
group has X once, solves OLS and every Ridge alpha from one thin SVD, and Lasso
by coordinate descent on residuals. Only coefficients leave the tasks. Longer
inputs take the Gram pass, up to ``GRAM_WIDTH`` features.

Predictions are a join of the label rows with the (series, coefficients)
table and a JVM-side dot product; no per-series Spark job is launched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LOCAL_CELLS = 1 << 23
GRAM_WIDTH = 4096
SERIES_GROUP = 64


class GramStats:
    """Centred cross-products of X and every series' label on a row set."""

    def __init__(self, n, mx, my, cxx, cxy, sids):
        self.n, self.mx, self.my, self.cxx, self.cxy, self.sids = n, mx, my, cxx, cxy, sids


def gram_stats(X: DataFrame, labels: DataFrame, sids: list, rows=None,
               features: str = "features") -> GramStats:
    """One pass over the per-t rows [x | y_1..y_S] restricted to ``rows``."""
    lab = labels if rows is None else labels.filter(rows)
    per_t = lab.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("sid", "label"))).alias("_y"))
    ycols = F.transform("_y", lambda e: e["label"].cast("double"))
    joined = X.join(per_t, "t").select(
        array_to_vector(F.concat(vector_to_array(features), ycols)).alias("_z"))
    joined = joined.cache()
    summ = joined.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("_z")).alias("s")).first()["s"]
    n = int(summ["count"])
    mean = summ["mean"].toArray()
    var = summ["variance"].toArray()  # ddof 1
    corr = Correlation.corr(joined, "_z", "pearson").head()[0].toArray()
    joined.unpersist()
    sd = np.sqrt(np.maximum(var, 0.0))
    corr = np.nan_to_num(corr, nan=0.0)
    cov = corr * np.outer(sd, sd) * (n - 1)  # centred cross-products
    p = len(mean) - len(sids)
    return GramStats(n, mean[:p], mean[p:], cov[:p, :p], cov[:p, p:], list(sids))


def _ols(cxx, cxy):
    return np.linalg.pinv(cxx, hermitian=True) @ cxy


def _ridge(cxx, cxy, alpha):
    return np.linalg.solve(cxx + alpha * np.eye(cxx.shape[0]), cxy)


def _lasso(cxx, cxy, alpha, n, max_sweeps=10000, tol=1e-12):
    """Coordinate descent on the covariance form, all series at once."""
    p, s = cxy.shape
    beta = np.zeros((p, s))
    diag = np.diag(cxx).copy()
    lam = alpha * n
    grad = cxy.copy()  # cxy - cxx @ beta, kept up to date
    for _ in range(max_sweeps):
        delta = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            old = beta[j].copy()
            rho = grad[j] + diag[j] * old
            new = np.sign(rho) * np.maximum(np.abs(rho) - lam, 0.0) / diag[j]
            d = new - old
            if np.any(d != 0):
                grad -= np.outer(cxx[:, j], d)
                beta[j] = new
                delta = max(delta, float(np.max(np.abs(d))))
        if delta < tol:
            return beta
    raise RuntimeError(f"lasso: no convergence to {tol} in {max_sweeps} sweeps (last step {delta})")


def solve(stats: GramStats, family: str, alpha: float = 0.0) -> DataFrame | list:
    """Per-series (sid, intercept, coef) rows for one family."""
    if family == "LinearRegression":
        beta = _ols(stats.cxx, stats.cxy)
    elif family == "Ridge":
        beta = _ridge(stats.cxx, stats.cxy, alpha)
    elif family == "Lasso":
        beta = _lasso(stats.cxx, stats.cxy, alpha, stats.n)
    else:
        raise ValueError(f"not a linear family: {family!r}")
    b0 = stats.my - stats.mx @ beta
    return [(sid, float(b0[i]), beta[:, i].astype(float).tolist()) for i, sid in enumerate(stats.sids)]


COEF_SCHEMA = T.StructType([T.StructField("family", T.StringType()), T.StructField("sid", T.StringType()),
                            T.StructField("intercept", T.DoubleType()),
                            T.StructField("coef", T.ArrayType(T.DoubleType()))])


def fit_linear(spark, stats: GramStats, fits: list[tuple[str, str, float]]) -> DataFrame:
    """``fits`` = [(name, family, alpha)] -> coefficient table (family=name)."""
    rows = []
    for name, family, alpha in fits:
        rows += [(name, sid, b0, coef) for sid, b0, coef in solve(stats, family, alpha)]
    return spark.createDataFrame(rows, COEF_SCHEMA)


def solve_rows(X: np.ndarray, Y: np.ndarray, fits: list[tuple[str, str, float]]) -> dict[tuple[str, str, float], tuple]:
    """(intercepts, coefficients p x S) of each fit from rows in memory."""
    n, p = X.shape
    mx, my = X.mean(0), Y.mean(0)
    Xc, Yc = X - mx, Y - my
    out, thin = {}, None
    for fit in fits:
        _, family, alpha = fit
        if family == "Lasso":
            beta = (_lasso(Xc.T @ Xc, Xc.T @ Yc, alpha, n) if p <= 2 * n else _lasso_rows(Xc, Yc, alpha))
        else:
            if thin is None:
                thin = np.linalg.svd(Xc, full_matrices=False)
            u, d, vt = thin
            if family == "LinearRegression":    # minimum norm: directions without variance get no weight
                scale = np.where(d > d.max(initial=0.0) * max(n, p) * np.finfo(float).eps, 1 / np.where(d > 0, d, 1), 0.0)
            elif family == "Ridge":
                scale = d / (d * d + alpha) if alpha > 0 else np.where(d > 0, 1 / np.where(d > 0, d, 1), 0.0)
            else:
                raise ValueError(f"not a linear family: {family!r}")
            beta = vt.T @ (scale[:, None] * (u.T @ Yc))
        out[fit] = (my - mx @ beta, beta)
    return out


def _lasso_rows(x: np.ndarray, y: np.ndarray, alpha: float, max_sweeps=10000, tol=1e-12) -> np.ndarray:
    """Coordinate descent on residuals, all series at once; needs no p x p array."""
    x = np.asfortranarray(x)
    n, p = x.shape
    beta, rest = np.zeros((p, y.shape[1])), y.copy()
    diag, lam = (x * x).sum(0), alpha * n
    for _ in range(max_sweeps):
        delta = 0.0
        for j in np.flatnonzero(diag > 0):
            rho = x[:, j] @ rest + diag[j] * beta[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - lam, 0.0) / diag[j]
            d = new - beta[j]
            if np.any(d != 0):
                rest -= np.outer(x[:, j], d)
                beta[j] = new
                delta = max(delta, float(np.max(np.abs(d))))
        if delta < tol:
            return beta
    raise RuntimeError(f"lasso: no convergence to {tol} in {max_sweeps} sweeps (last step {delta})")


def fit_series(X: DataFrame, labels: DataFrame, fits: list[tuple[str, str, dict[str, float] | float]], rows=None,
               features: str = "features", local_cells: int | None = None) -> DataFrame:
    """Coefficients (COEF_SCHEMA) of ``fits`` = [(name, family, alpha, or alpha
    by series)] for every series."""
    limit = LOCAL_CELLS if local_cells is None else local_cells
    lab = (labels if rows is None else labels.filter(rows)).filter("label IS NOT NULL")
    sids = [r[0] for r in lab.select("sid").distinct().orderBy("sid").collect()]
    values = vector_to_array(features) if isinstance(X.schema[features].dataType, VectorUDT) else F.col(features)
    size = X.select(F.size(values).alias("p")).first()
    n = lab.select(F.countDistinct("t")).first()[0]
    by = [(name, family, a if isinstance(a, dict) else dict.fromkeys(sids, float(a))) for name, family, a in fits]
    if size is None or n * size["p"] > limit:
        if size is not None and size["p"] > GRAM_WIDTH:
            raise ValueError(f"{size['p']} features of {n} rows: beyond {limit} cells at most {GRAM_WIDTH} features are solved")
        st = gram_stats(X, labels, sids, rows, features)
        solved = []
        for name, family, alpha in by:
            for a in sorted(set(alpha.values())):
                solved += [(name, s, b0, c) for s, b0, c in solve(st, family, a) if alpha[s] == a]
        return X.sparkSession.createDataFrame(solved, COEF_SCHEMA)
    place = {s: i for i, s in enumerate(sids)}
    groups = -(-len(sids) // SERIES_GROUP)
    keys = X.sparkSession.createDataFrame([(s, i // SERIES_GROUP) for s, i in place.items()], "sid string, g int")
    packed = lab.join(F.broadcast(keys), "sid").groupBy("g", "t").agg(      # a row per series, as many as coefficients
        F.map_from_entries(F.collect_list(F.struct("sid", F.col("label").cast("double")))).alias("y"))
    data = packed.join(X.select("t", values.alias("x")), "t")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, mine = np.stack(pdf["x"].to_numpy()), sids[key[0] * SERIES_GROUP:(key[0] + 1) * SERIES_GROUP]
        y = np.array([[dict(m).get(s, np.nan) for s in mine] for m in pdf["y"]])
        out = []
        present = ~np.isnan(y)
        for pattern in {c.tobytes() for c in present.T}:        # series with the same rows are solved together
            rows_ = np.frombuffer(pattern, bool)
            cols = [k for k in range(len(mine)) if present[:, k].tobytes() == pattern]
            wanted = sorted({(name, family, alpha[mine[k]]) for name, family, alpha in by for k in cols})
            if not rows_.any():
                continue
            found = solve_rows(x[rows_], y[np.ix_(rows_, cols)], wanted)
            for name, family, alpha in by:
                for i, k in enumerate(cols):
                    b0, beta = found[name, family, alpha[mine[k]]]
                    out.append((name, mine[k], float(b0[i]), beta[:, i].tolist()))
        return pd.DataFrame(out, columns=["family", "sid", "intercept", "coef"])

    return data.repartition(max(1, groups), "g").groupBy("g").applyInPandas(run, COEF_SCHEMA)


def predict_linear(X: DataFrame, labels: DataFrame, coefs: DataFrame, rows=None,
                   features: str = "features") -> DataFrame:
    """(family, sid, t, y, yhat[, split]) for the label rows in ``rows``."""
    lab = labels if rows is None else labels.filter(rows)
    j = lab.join(coefs, "sid").join(X.select("t", vector_to_array(features).alias("_x")), "t")
    dot = F.aggregate(F.zip_with("_x", "coef", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    keep = [c for c in ("split",) if c in lab.columns]
    return j.select("family", "sid", "t", F.col("label").alias("y"), (F.col("intercept") + dot).alias("yhat"),
                    *keep)


def linear_grid_cv(X: DataFrame, labels: DataFrame, sids: list, folds: list[tuple], family: str,
                   alphas, features: str = "features") -> DataFrame:
    """G2 for a linear family over every series at once: per fold one Gram
    pass on the fold's train rows, a solve per grid point on the driver, and
    one aggregation of test-row errors. ``folds`` = [(fold, lo, test_lo, test_hi)].
    Returns (sid, apos, alpha, cv_mse)."""
    spark = X.sparkSession
    t = F.col("t")
    parts = []
    for fold, lo, tlo, thi in folds:
        st = gram_stats(X, labels.filter(F.col("sid").isin(sids)), sids, (t >= lo) & (t < tlo), features)
        rows = []
        for apos, a in enumerate(alphas):
            rows += [(f"{apos}", sid, b0, coef) for sid, b0, coef in solve(st, family, float(a))]
        coefs = spark.createDataFrame(rows, COEF_SCHEMA)
        pred = predict_linear(X, labels.filter(F.col("sid").isin(sids)), coefs, (t >= tlo) & (t < thi), features)
        e = F.col("y") - F.col("yhat")
        parts.append(pred.groupBy("sid", F.col("family").cast("int").alias("apos")).agg(
            F.avg(e * e).alias("mse")).withColumn("fold", F.lit(fold)))
    from .reshape import union_all
    allf = union_all(parts)
    grid = spark.createDataFrame([(i, float(a)) for i, a in enumerate(alphas)], "apos int, alpha double")
    return allf.groupBy("sid", "apos").agg(F.avg("mse").alias("cv_mse")).join(grid, "apos")
