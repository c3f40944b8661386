"""Evaluation and reporting.

Input is a long *scored* table ``(family, sid, t, y, yhat[, split])``. Every
metric is a grouped aggregate; report tables have O(families x series) rows,
so their windows and sorts are tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import pct_improvement
from ..functions.stats import count_if, r2_from_sums
from .reshape import family_order


def _err():
    return F.col("y") - F.col("yhat")


def series_r2(scored: DataFrame) -> DataFrame:
    """V2: R^2 per (family, sid); SST = 0 -> 1 if perfect else 0."""
    e = _err()
    g = scored.groupBy("family", "sid").agg(
        F.sum(e * e).alias("sse"),
        (F.var_pop("y") * F.count("y")).alias("sst"))
    return g.select("family", "sid", r2_from_sums("sse", "sst").alias("r2"))


def pooled_errors(scored: DataFrame) -> DataFrame:
    """V1: MSE, RMSE, MAE over all series x steps per family."""
    e = _err()
    g = scored.groupBy("family").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return g.select("family", "mse", F.sqrt("mse").alias("rmse"), "mae")


def macro_r2(r2: DataFrame) -> DataFrame:
    """Mean of per-series R^2 per family."""
    return r2.groupBy("family").agg(F.avg("r2").alias("avg_r2"))


def pooled_r2(scored: DataFrame) -> DataFrame:
    """V5: one R^2 over all flattened values per family."""
    e = _err()
    g = scored.groupBy("family").agg(F.sum(e * e).alias("sse"),
                                     (F.var_pop("y") * F.count("y")).alias("sst"))
    return g.select("family", r2_from_sums("sse", "sst").alias("r2_pooled"))


def model_comparison(scored: DataFrame) -> DataFrame:
    """V7: mean R^2, MSE, RMSE, MAE per family."""
    return pooled_errors(scored).join(macro_r2(series_r2(scored)), "family")


def accuracy(mae_col: str = "mae"):
    """V6: max(0, 1 - scaled MAE)."""
    return F.greatest(F.lit(0.0), 1 - F.col(mae_col))


def difficult_series(r2: DataFrame) -> DataFrame:
    """V8: series whose best R^2 over families is below 0."""
    return r2.groupBy("sid").agg(F.max("r2").alias("best_r2")).filter(F.col("best_r2") < 0)


def r2_matrix(r2: DataFrame, sids: list[str]) -> DataFrame:
    """V9: family x series grid, explicit pivot values."""
    return r2.groupBy("family").pivot("sid", sids).agg(F.first("r2"))


def r2_sign_counts(r2: DataFrame) -> DataFrame:
    """Series with R^2 > 0 and <= 0 per family."""
    return r2.groupBy("family").agg(count_if(F.col("r2") > 0).alias("n_positive"),
                                    count_if(F.col("r2") <= 0).alias("n_nonpositive"))


def r2_histogram(r2: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max per family, last bin closed,
    empty bins kept (the bin spine is generated per family, ``bins`` rows)."""
    rng = r2.groupBy("family").agg(F.min("r2").alias("lo"), F.max("r2").alias("hi"))
    j = r2.join(rng, "family")
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("r2") - F.col("lo")) / width * bins), F.lit(bins - 1)))
    counts = j.groupBy("family", b.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    spine = rng.select("family", "lo", "hi",
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")))
                       .alias("bin"))
    edge = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / bins
    return spine.join(counts, ["family", "bin"], "left").select(
        "family", "bin", edge(F.col("bin")).alias("lo_edge"), edge(F.col("bin") + 1).alias("hi_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def top_models(avg_r2: DataFrame, families: list[str], k: int = 3) -> DataFrame:
    """O3: top k families by mean R^2 (list order on ties)."""
    w = Window.orderBy(F.desc("avg_r2"), family_order(families))
    return avg_r2.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def best_worst_series(r2: DataFrame, k: int = 3) -> DataFrame:
    """K best and k worst series by R^2 per family. The two lists are
    taken independently, so with fewer than 2k series some stand in both."""
    sides = F.filter(F.array(F.struct(F.lit("best").alias("side"), F.col("_b").cast("bigint").alias("rank")),
                             F.struct(F.lit("worst").alias("side"), F.col("_w").cast("bigint").alias("rank"))),
                     lambda s: s["rank"] <= k)
    best = Window.partitionBy("family").orderBy(F.desc("r2"), "sid")
    worst = Window.partitionBy("family").orderBy("r2", "sid")
    ranked = r2.select("*", F.row_number().over(best).alias("_b"), F.row_number().over(worst).alias("_w"))
    return ranked.select("family", "sid", "r2", F.inline(sides))


def best_model(avg_r2: DataFrame, families: list[str]) -> DataFrame:
    """Argmax family by mean R^2, first in list order on ties."""
    key = F.struct(F.col("avg_r2"), (-family_order(families)).alias("o"))
    return avg_r2.agg(F.max_by("family", key).alias("best_family"),
                      F.max("avg_r2").alias("best_avg_r2"))


def best_model_distribution(r2: DataFrame, families: list[str]) -> DataFrame:
    """A10: best family per series (list order on ties), then count and
    percent per family; families that never win are listed with 0."""
    key = F.struct(F.col("r2"), (-family_order(families)).alias("o"))
    winners = r2.groupBy("sid").agg(F.max_by("family", key).alias("family"))
    n_series = r2.select(F.countDistinct("sid")).scalar()
    counts = winners.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    fams = r2.select("family").distinct()
    out = fams.join(counts, "family", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return out.select("family", n.alias("n_series"), (n * 100.0 / n_series).alias("pct"))


def errors_original_scale(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """V4: V1 after inverse scaling (P5) of y and yhat."""
    from .reshape import inverse_standardize
    inv = inverse_standardize(scored, stats, ["y", "yhat"])
    return pooled_errors(inv).join(pooled_r2(inv), "family")


#: fixed value: the R^2 of the reference's earlier run that its summary compares with
PREVIOUS_R2 = 0.947


def final_summary(scored_test: DataFrame, chosen: DataFrame, stats: DataFrame, previous_r2: float = PREVIOUS_R2) -> DataFrame:
    """One row for the chosen family: R^2, RMSE, MAE (scaled and
    original), pooled original-scale R^2, accuracy, and the improvement of R^2
    over an earlier run in percent (F7)."""
    fam = chosen.select("best_family").scalar()
    s = scored_test.filter(F.col("family") == fam)
    scaled = model_comparison(s)
    orig = errors_original_scale(s, stats).select(
        "family", F.col("mse").alias("mse_orig"), F.col("rmse").alias("rmse_orig"),
        F.col("mae").alias("mae_orig"), F.col("r2_pooled").alias("r2_pooled_orig"))
    return scaled.join(orig, "family").select(
        "family", "avg_r2", "mse", "rmse", "mae", "mse_orig", "rmse_orig", "mae_orig",
        "r2_pooled_orig", accuracy().alias("accuracy"), pct_improvement("avg_r2", F.lit(previous_r2)).alias("improvement_pct"))
