"""Ensembles: weighted (E1, J6) and stacked (E2), plus stand-in forecasters.

Both ensembles work per series on long prediction tables. The stacked
meta-model is a ridge regression on the base predictions; it is fitted from
per-series sufficient statistics (sums of products, one grouped aggregate
with partial aggregation), and only the m x m system of each series is
solved in Python, on a table with one row per series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORECASTERS = {"persist": "lag1", "rollmean3": "rollmean3", "ewm5": "ewm5"}


def forecaster_predictions(features: DataFrame, label: str = "v",
                           forecasters: dict[str, str] = FORECASTERS) -> DataFrame:
    """Deterministic stand-ins for trained models: a feature column used as
    the forecast. Returns (family, sid, t, y, yhat[, split])."""
    keep = [c for c in ("sid", "t", "split") if c in features.columns]
    pairs = ", ".join(f"'{fam}', `{c}`" for fam, c in forecasters.items())
    return features.selectExpr(*keep, f"`{label}` as y",
                               f"stack({len(forecasters)}, {pairs}) as (family, yhat)")


def ensemble_weights(val_r2: DataFrame, candidates: DataFrame) -> DataFrame:
    """E1 weights per (sid, family): validation R^2 where positive, normalized
    over the series' candidates; equal weights if none is positive."""
    c = val_r2.join(candidates.select("family"), "family", "left_semi")
    n_cand = candidates.select(F.count(F.lit(1))).scalar()
    pos = F.when(F.col("r2") > 0, F.col("r2")).otherwise(F.lit(0.0))
    tot = F.sum(pos).over(Window.partitionBy("sid"))
    w = F.when(tot > 0, pos / tot).otherwise(F.lit(1.0) / n_cand)
    return c.select("sid", "family", w.alias("weight"))


def weighted_predictions(preds: DataFrame, weights: DataFrame, name: str = "Ensemble") -> DataFrame:
    """Sum of weight x yhat per (sid, t); families with weight 0 drop out."""
    j = preds.join(weights.filter(F.col("weight") != 0), ["sid", "family"])
    g = j.groupBy("sid", "t").agg(F.sum(F.col("weight") * F.col("yhat")).alias("yhat"),
                                 F.first("y").alias("y"))
    return g.select(F.lit(name).alias("family"), "sid", "t", "y", "yhat")


# ------------------------------------------------------------------ stacking
def _solve_ridge(alpha: float, m: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = float(r["n"])
        sx = np.array([r[f"s{i}"] for i in range(m)])
        sy = float(r["sy"])
        sxx = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        sxy = np.array([r[f"s{i}y"] for i in range(m)])
        mx, my = sx / n, sy / n
        cxx = sxx - n * np.outer(mx, mx)
        cxy = sxy - n * mx * my
        beta = np.linalg.solve(cxx + alpha * np.eye(m), cxy)
        b0 = my - mx @ beta
        return pd.DataFrame({"sid": [r["sid"]], "intercept": [float(b0)],
                             "coef": [beta.astype(float).tolist()]})
    return solve


def stack_fit(val_preds: DataFrame, bases: list[str], alpha: float = 0.1) -> DataFrame:
    """E2 meta-model per series: ridge (sklearn alpha, with intercept) of y on
    the bases' validation predictions. Returns (sid, intercept, coef)."""
    m = len(bases)
    wide = val_preds.groupBy("sid", "t", "y").pivot("family", bases).agg(F.first("yhat"))
    p = [F.col(f"`{b}`") for b in bases]
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy")]
    aggs += [F.sum(p[i]).alias(f"s{i}") for i in range(m)]
    aggs += [F.sum(p[i] * F.col("y")).alias(f"s{i}y") for i in range(m)]
    aggs += [F.sum(p[i] * p[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    stats = wide.groupBy("sid").agg(*aggs)
    schema = T.StructType([T.StructField("sid", T.StringType()),
                           T.StructField("intercept", T.DoubleType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType()))])
    return stats.groupBy("sid").applyInPandas(_solve_ridge(alpha, m), schema)


def stack_predict(preds: DataFrame, model: DataFrame, bases: list[str],
                  name: str = "Ensemble") -> DataFrame:
    wide = preds.groupBy("sid", "t", "y").pivot("family", bases).agg(F.first("yhat"))
    j = wide.join(model, "sid")
    yhat = F.col("intercept")
    for i, b in enumerate(bases):
        yhat = yhat + F.col("coef")[i] * F.col(f"`{b}`")
    return j.select(F.lit(name).alias("family"), "sid", "t", "y", yhat.alias("yhat"))
