"""Families, their defaults and grids, and the Spark ML estimators of a single series.

All series together are fitted by ``linear`` and ``trees`` and kept in one
``model_table``. This module maps a family to a Spark ML estimator, for one
series of any length, and has grid search over expanding folds with it: fits
are Spark ML jobs submitted from a bounded driver thread pool, the mechanism
``CrossValidator`` uses for its ``parallelism``. An unknown family is an error.

Estimator mapping (T15-T17):
* Ridge: sklearn alpha -> ``regParam = alpha * std(y) / n``, no standardization, l-bfgs.
* Lasso: ``regParam = alpha``, ``elasticNetParam = 1``, no standardization.
* Trees: ``max_depth=None`` -> 30 (Spark's limit); RF uses every feature per split
  (``featureSubsetStrategy='all'``), bootstrap rows; ``min_samples_split`` has no
  Spark counterpart (ignored); ``colsample_bytree`` -> per-node feature fraction.
* XGBoost is re-aimed as a histogram GBT: ``GBTRegressor`` (Spark trees are binned).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.regression import (GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig
from ..functions.stats import r2_from_sums

MAX_DEPTH = 30

# fixed values: default hyper-parameters of the reference families
DEFAULTS = {
    "LinearRegression": {},
    "Ridge": {"alpha": 1.0},
    "Lasso": {"alpha": 0.1},
    "RandomForest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "GradientBoosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0},
    "XGBoost": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 5, "subsample": 0.8,
                "colsample_bytree": 0.8},
}
STACK_ALPHA = 0.1

# fixed values: tuning grids of the two programs
GRIDS_V1 = {
    "RandomForest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20, 30],
                     "min_samples_split": [2, 5, 10]},
    "GradientBoosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2],
                         "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
}
GRIDS_V2 = {
    "RandomForest": {"n_estimators": [100, 200, 300], "max_depth": [None, 15, 25, 35],
                     "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "GradientBoosting": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1],
                         "max_depth": [3, 5, 7], "subsample": [0.7, 0.8, 0.9, 1.0]},
    "XGBoost": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1],
                "max_depth": [3, 5, 7], "subsample": [0.7, 0.8, 0.9], "colsample_bytree": [0.7, 0.8, 0.9]},
    "Lasso": {"alpha": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]},
    "Ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
}


def _depth(d):
    return MAX_DEPTH if d is None else min(int(d), MAX_DEPTH)


def estimator(family: str, params: dict | None = None, n: int | None = None,
              y_sd: float | None = None, seed: int = 42, features: str = "features",
              tree_mb: int = 256):
    """Family name + params -> configured Spark ML estimator."""
    if family not in DEFAULTS:
        raise ValueError(f"unknown model family {family!r}")
    p = dict(DEFAULTS[family])
    p.update(params or {})
    common = dict(featuresCol=features, labelCol="label", predictionCol="prediction")
    if family == "LinearRegression":
        return LinearRegression(regParam=0.0, **common)
    if family == "Ridge":
        reg = p["alpha"] * (y_sd or 1.0) / max(n or 1, 1)
        return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False,
                                solver="l-bfgs", maxIter=1000, tol=1e-10, **common)
    if family == "Lasso":
        return LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, standardization=False,
                                maxIter=10000, tol=1e-10, **common)
    if family == "RandomForest":
        return RandomForestRegressor(numTrees=int(p["n_estimators"]), maxDepth=_depth(p["max_depth"]),
                                     minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                     featureSubsetStrategy="all", seed=seed, maxMemoryInMB=tree_mb,
                                     cacheNodeIds=True, **common)
    if family == "GradientBoosting":
        return GBTRegressor(maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                            maxDepth=_depth(p["max_depth"]), subsamplingRate=float(p["subsample"]),
                            maxMemoryInMB=tree_mb, seed=seed, **common)
    return GBTRegressor(maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                        maxDepth=_depth(p["max_depth"]), subsamplingRate=float(p["subsample"]),
                        featureSubsetStrategy=str(float(p["colsample_bytree"])), maxBins=256,
                        maxMemoryInMB=tree_mb, seed=seed, **common)


ROWS_PER_PARTITION = 200_000


def series_frame(X: DataFrame, labels: DataFrame, sid, rows=None) -> DataFrame:
    """One series' training rows: X joined 1:1 on t with its labels."""
    lab = labels.filter(F.col("sid") == sid)
    if rows is not None:
        lab = lab.filter(rows)
    return X.join(lab.select("t", F.col("label").cast("double").alias("label")), "t")


def sized(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> tuple[DataFrame, int]:
    """Repartition an iterative learner's input to ~``rows_per_partition``
    rows per task and cache it: boosting runs several jobs per round, so a
    small frame spread over many shuffle partitions pays scheduling cost on
    every job, while a large one keeps one task per block of rows."""
    n = df.count()
    parts = max(1, -(-n // rows_per_partition))
    return df.repartition(parts).cache(), n


def grid_points(grid: dict) -> list[dict]:
    """Cartesian grid in sklearn's ParameterGrid order (keys sorted)."""
    from itertools import product
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in product(*[grid[k] for k in keys])]


def grid_search(X: DataFrame, labels: DataFrame, family: str, sid, folds: DataFrame,
                grid: dict, cfg: PanelConfig, features: str = "features") -> tuple[dict, float, DataFrame]:
    """Mean MSE over expanding folds for every grid point of one series;
    least MSE wins, first grid point on ties. ``folds`` is (fold, train_lo,
    test_lo, test_hi). Fits run on a bounded thread pool; fold MSEs are
    reduced in one aggregation. Returns (best params, best MSE, table)."""
    points = grid_points(grid)
    fb = [(r["fold"], r["train_lo"], r["test_lo"], r["test_hi"]) for r in folds.collect()]
    data, _ = sized(series_frame(X, labels, sid))
    stats = {}

    def run(job):
        gi, (fold, lo, tlo, thi) = job
        tr = data.filter((F.col("t") >= lo) & (F.col("t") < tlo))
        te = data.filter((F.col("t") >= tlo) & (F.col("t") < thi))
        if fold not in stats:
            r = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("sd")).first()
            stats[fold] = (int(r["n"]), float(r["sd"] or 0.0))
        n, sd = stats[fold]
        m = estimator(family, points[gi], n, sd, cfg.seed, features, cfg.tree_memory_mb).fit(tr)
        err = F.col("label") - F.col("prediction")
        mse = m.transform(te).agg(F.avg(err * err)).first()[0]
        return gi, fold, float(mse)

    jobs = [(gi, f) for gi in range(len(points)) for f in fb]
    with ThreadPoolExecutor(max_workers=max(1, cfg.fit_parallelism)) as pool:
        res = list(pool.map(run, jobs))
    data.unpersist()
    spark = X.sparkSession
    table = spark.createDataFrame([(gi, f, m) for gi, f, m in res], "point int, fold bigint, mse double")
    mean = table.groupBy("point").agg(F.avg("mse").alias("cv_mse"))
    best = mean.orderBy("cv_mse", "point").first()
    return points[best["point"]], float(best["cv_mse"]), mean


def r2_table(preds: DataFrame) -> DataFrame:
    e = F.col("y") - F.col("yhat")
    g = preds.groupBy("family", "sid").agg(F.sum(e * e).alias("sse"),
                                            (F.var_pop("y") * F.count("y")).alias("sst"))
    return g.select("family", "sid", r2_from_sums("sse", "sst").alias("r2"))
