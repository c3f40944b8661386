"""Reshaping, scaling and filters (P1-P13) and the relational joins J1, J2.

Scalers are plain aggregate tables ``(sid, mu, sd)``; applying them is an
equi-join on ``sid`` whose strategy the planner picks from the table's
runtime size (broadcast under the threshold, skew-split sort-merge above).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt_panel(wide: DataFrame, id_col: str = "t", value_cols: list[str] | None = None) -> DataFrame:
    """Wide (t, s1, s2, ...) -> long (sid, t, v)."""
    value_cols = value_cols or [c for c in wide.columns if c != id_col]
    long = wide.select(F.col(id_col).cast("bigint").alias("t"),
                       *[F.col(c).cast("double").alias(c) for c in value_cols])
    return long.unpivot(["t"], value_cols, "sid", "v").select("sid", "t", "v")


def pivot_panel(panel: DataFrame, sids: list[str], value: str = "v") -> DataFrame:
    """Long -> wide with an explicit value list (no distinct pass)."""
    return panel.groupBy("t").pivot("sid", sids).agg(F.first(value))


def scaler_stats(panel: DataFrame, value: str = "v", rows: Column | None = None) -> DataFrame:
    """Per-series mean and population std (sklearn StandardScaler, ddof 0, T3).
    ``rows`` restricts the fit (``fit_on='train'``, T2)."""
    src = panel if rows is None else panel.filter(rows)
    return src.groupBy("sid").agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))


def standardize(panel: DataFrame, stats: DataFrame | None = None, value: str = "v",
                out: str = "z") -> DataFrame:
    """z = (v - mu) / sd; a constant series maps to 0."""
    stats = stats if stats is not None else scaler_stats(panel, value)
    j = panel.join(stats, "sid")
    z = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("mu")) / F.col("sd"))
    return j.select(*panel.columns, z.alias(out))


def inverse_standardize(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """P5: v = z * sd + mu (sd = 0 keeps mu, as sklearn's scale_ = 1)."""
    j = df.join(stats, "sid")
    scale = F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd"))
    return j.select(*[(F.col(c) * scale + F.col("mu")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def standardize_wide(inputs: DataFrame, x: str = "x", rows: Column | None = None) -> DataFrame:
    """Column-wise z-score of an array column (ddof 0).

    One ``Summarizer`` pass gives the mean and variance vectors (partial sums
    per task); they come back as one-row scalar subqueries, so the plan's size
    does not depend on the width and nothing passes through the driver.
    """
    src = inputs if rows is None else inputs.filter(rows)
    m = src.select(array_to_vector(x).alias("v")).select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("m")).select(
        vector_to_array("m.mean").alias("mu"),
        # the summarizer's variance has n - 1 below
        F.transform(vector_to_array("m.variance"), lambda q: F.sqrt(q * (F.col("m.count") - 1) / F.col("m.count"))).alias("sd"))
    both = inputs.withColumns({"_mu": m.select("mu").scalar(), "_sd": m.select("sd").scalar()})
    centred = F.zip_with(F.col(x), F.col("_mu"), lambda a, mu: a - mu)
    zs = F.zip_with(centred, F.col("_sd"), lambda d, sd: F.when(sd == 0, F.lit(0.0)).otherwise(d / sd))
    return both.withColumn(x, zs).drop("_mu", "_sd")


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL / NaN -> 0."""
    return df.select(*[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def trim_warmup(df: DataFrame, n_lags: int) -> DataFrame:
    """P10."""
    return df.filter(F.col("t") >= n_lags)


def trim_horizon(df: DataFrame, horizon: int) -> DataFrame:
    """Drop the last h steps when h > 1 (n taken from the data)."""
    if horizon <= 1:
        return df
    n = df.select(F.max("t") + 1).scalar()
    return df.filter(F.col("t") < n - horizon)


def first_series(panel: DataFrame, k: int) -> DataFrame:
    """The first k series by sid; k rows reach the semi join."""
    keep = panel.select("sid").distinct().orderBy("sid").limit(k)
    return panel.join(F.broadcast(keep), "sid", "left_semi")


def sample_series(panel: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """P12 (random): k series, those with the smallest seeded hashes."""
    keep = panel.select("sid").distinct().orderBy(F.xxhash64("sid", F.lit(seed)), "sid").limit(k)
    return panel.join(F.broadcast(keep), "sid", "left_semi")


def family_order(families: list[str]) -> Column:
    """Position of ``family`` in the configured list (ties keep list order)."""
    return F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))


def positive_models(avg_r2: DataFrame, families: list[str], top: int = 3,
                    exclude: tuple[str, ...] = (), min_count: int = 1) -> DataFrame:
    """O3 + P13: top families by mean R^2, keep those with R^2 > 0; empty
    when fewer than ``min_count`` remain."""
    src = avg_r2.filter(~F.col("family").isin(list(exclude))) if exclude else avg_r2
    top_df = src.orderBy(F.desc("avg_r2"), family_order(families)).limit(top)
    pos = top_df.filter(F.col("avg_r2") > 0)
    if min_count > 1:
        n = pos.select(F.count(F.lit(1))).scalar()
        pos = pos.filter(n >= min_count)
    return pos


def align_inputs(features: DataFrame, inputs: DataFrame) -> DataFrame:
    """1:1 equi-join on t."""
    return features.join(inputs, "t", "inner")


def actual_vs_pred(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """(sid, t, y) x (family, sid, t, yhat)."""
    return preds.join(labels, ["sid", "t"])


def union_all(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)
