"""Hyper-parameter search (G2-G5) and parameter roll-ups.

``ridge1_grid_cv`` is the closed-form, single-feature ridge version of G2:
per (series, fold) sufficient statistics are one grouped aggregate, the grid
is expanded per statistics row (grid size is configuration, not data), and
fold MSEs are reduced with partial aggregation. The estimator-agnostic grid
search over Spark ML models lives in ``models.grid_search``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig
from . import split as split_ops


def ridge1_grid_cv(fs: DataFrame, cfg: PanelConfig, alphas, x: str = "lag1",
                   y: str = "v", bounds_from: DataFrame | None = None) -> DataFrame:
    """Mean fold MSE of y ~ b0 + b*x (sklearn Ridge, intercept unpenalised)
    for every alpha; returns (sid, alpha, apos, cv_mse)."""
    folds = split_ops.fold_bounds(bounds_from if bounds_from is not None else fs, cfg)
    rows = fs.select("sid", "t", F.col(x).alias("x"), F.col(y).alias("y")).join(
        F.broadcast(folds), (F.col("t") >= F.col("train_lo")) & (F.col("t") < F.col("test_hi")))
    is_train = F.col("t") < F.col("test_lo")
    tr = rows.filter(is_train).groupBy("sid", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    grid = F.posexplode(F.array(*[F.lit(float(a)) for a in alphas])).alias("apos", "alpha")
    coef = tr.select("sid", "fold", "mx", "my",
                     (F.col("sxx") - F.col("n") * F.col("mx") * F.col("mx")).alias("cxx"),
                     (F.col("sxy") - F.col("n") * F.col("mx") * F.col("my")).alias("cxy"), grid)
    coef = coef.select("sid", "fold", "apos", "alpha",
                       (F.col("cxy") / (F.col("cxx") + F.col("alpha"))).alias("b"),
                       "mx", "my").withColumn("b0", F.col("my") - F.col("b") * F.col("mx"))
    te = rows.filter(~is_train).join(coef, ["sid", "fold"])
    err = F.col("y") - (F.col("b0") + F.col("b") * F.col("x"))
    per_fold = te.groupBy("sid", "fold", "apos", "alpha").agg(F.avg(err * err).alias("mse"))
    return per_fold.groupBy("sid", "apos", "alpha").agg(F.avg("mse").alias("cv_mse"))


def best_params(cv: DataFrame) -> DataFrame:
    """Least mean MSE per series, first grid point on ties (GridSearchCV)."""
    key = F.struct("cv_mse", "apos")
    return cv.groupBy("sid").agg(F.min_by("alpha", key).alias("alpha"),
                                 F.min("cv_mse").alias("cv_mse"))


def params_long(best: DataFrame, names=("alpha",)) -> DataFrame:
    """(sid, param, value) from one column per parameter."""
    return best.select("sid", F.explode(F.array(*[
        F.struct(F.lit(n).alias("param"), F.col(n).cast("double").alias("value")) for n in names]))
        .alias("_p")).select("sid", "_p.param", "_p.value")


def param_mode(params: DataFrame) -> DataFrame:
    """Per parameter the most common value and how many series use it;
    ties go to the value seen first (smallest sid)."""
    counts = params.groupBy("param", "value").agg(F.count(F.lit(1)).cast("bigint").alias("n_series"),
                                                  F.min("sid").alias("_first"))
    best = counts.groupBy("param").agg(
        F.min_by(F.struct("value", "n_series"), F.struct(-F.col("n_series"), F.col("_first"))).alias("_b"))
    return best.select("param", F.col("_b.value").alias("value"), F.col("_b.n_series").alias("n_series"))


def param_consensus(params: DataFrame) -> DataFrame:
    """One value when all series agree, else the first series' value
    (the reference's "most common" branch is unreachable, T14)."""
    return params.groupBy("param").agg(
        F.min_by("value", "sid").alias("value"),
        F.countDistinct("value").cast("bigint").alias("n_distinct"))


def broadcast_group_params(groups: DataFrame, rep_params: DataFrame) -> DataFrame:
    """Each member gets its group's parameters. ``groups`` (sid,
    group_id, representative); ``rep_params`` keyed by representative sid."""
    p = rep_params.withColumnRenamed("sid", "representative")
    return groups.join(p, "representative")
