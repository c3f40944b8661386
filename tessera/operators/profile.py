"""Series profiling (A1-A6) and cluster features.

All statistics are grouped aggregates on ``sid`` (partial aggregation in
every task, one row per series after the shuffle), so a hot series costs no
more than a cold one. Autocorrelation uses the blocked halo layout of
``windows``, the correlogram pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import adjusted_kurtosis, adjusted_skew, count_if, safe_corr
from ..session import stored
from .windows import windowed


def series_stats(panel: DataFrame, value: str = "v") -> DataFrame:
    """A1: mean, std (ddof 1), min, max, range, zeros, missing per series."""
    v = F.col(value)
    return panel.groupBy("sid").agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"),
        count_if(v == 0).alias("zeros"),
        count_if(v.isNull()).alias("missing"),
    )


def stats_rollup(stats: DataFrame) -> DataFrame:
    """A2: min of mins, max of maxes, mean of means, mean of stds."""
    return stats.agg(F.min("min").alias("min_min"), F.max("max").alias("max_max"),
                     F.avg("mean").alias("avg_mean"), F.avg("std").alias("avg_std"))


def series_shape(panel: DataFrame, value: str = "v") -> DataFrame:
    """A4: pandas-style (bias-adjusted) skewness and excess kurtosis."""
    return panel.groupBy("sid").agg(adjusted_skew(value).alias("skew"),
                                    adjusted_kurtosis(value).alias("kurt"))


def autocorr_lags(panel: DataFrame, lags=(1, 7, 14), value: str = "v",
                  block: int = 512) -> DataFrame:
    """A5: Pearson autocorrelation ``Series.autocorr(lag)`` per series."""
    lagged = windowed(panel, lambda w: [F.lag(value, k).over(w).alias(f"_l{k}") for k in lags],
                      max(lags), 0, block)
    return lagged.groupBy("sid").agg(*[safe_corr(value, f"_l{k}").alias(f"ac{k}") for k in lags])


def _lag_sums(block: int):
    """Sums of products, and numbers of pairs, by distance inside pairs of
    blocks, added up over a task's pairs at the same distance of blocks."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def flush():
            for (sid, apart), (s, n) in held.items():
                yield pd.DataFrame({"sid": [sid], "apart": [apart], "s": [s], "n": [np.rint(n)]})
            held.clear()

        def spectra(places, values):
            x = np.zeros((2, 2 * block))
            x[0, places], x[1, places] = values, 1.0
            return np.fft.rfft(x)

        for pdf in it:
            for r in pdf.itertuples():
                both = np.fft.irfft(np.conj(spectra(r.o, r.d)) * spectra(r.o_b, r.d_b))
                both = np.concatenate([both[:, block + 1:], both[:, :block]], 1)      # distances 1 - block .. block - 1
                key = (r.sid, r.j - r.i)
                held[key] = held[key] + both if key in held else both
                if len(held) > 256:
                    yield from flush()
        yield from flush()
    return run


def correlogram(panel: DataFrame, max_lag: int | None = None, value: str = "v",
                block: int = 4096) -> DataFrame:
    """r_h = sum_t (x_t - mu)(x_{t+h} - mu) / n / c0 for h = 1..max_lag
    (pandas ``autocorrelation_plot``; default: every lag, n - 1), with the
    99 % band z/sqrt(n).

    A series is cut into blocks; every pair of blocks within reach is one row,
    and gives the sums of its 2 * block - 1 lags by a Fourier transform. So all
    lags of a long series are spread over tasks, and only sums by (series,
    distance of blocks, lag) cross the shuffle. Steps without a value pair
    with nothing.
    """
    stats = panel.groupBy("sid").agg(F.avg(value).alias("_mu"), F.count(value).alias("_n"),
                                     F.var_pop(value).alias("_c0"))
    reach = F.lit((int(max_lag) + block - 1) // block).cast("long") if max_lag is not None else None
    centred = panel.filter(F.col(value).isNotNull()).join(stats.select("sid", "_mu"), "sid").select(
        "sid", F.floor(F.col("t") / block).alias("i"), F.pmod("t", F.lit(block)).cast("int").alias("o"),
        (F.col(value) - F.col("_mu")).alias("d"))
    packed = centred.groupBy("sid", "i").agg(F.collect_list(F.struct("o", "d")).alias("c"))
    packed = stored(packed.select("sid", "i", F.col("c.o").alias("o"), F.col("c.d").alias("d")), "series_blocks")
    last = packed.groupBy("sid").agg(F.max("i").alias("last"))
    stop = F.col("last") if reach is None else F.least(F.col("last"), F.col("i") + reach)
    left = packed.join(last, "sid").select("sid", "i", "o", "d", F.explode(F.sequence("i", stop)).alias("j"))
    right = packed.select("sid", F.col("i").alias("j"), F.col("o").alias("o_b"), F.col("d").alias("d_b"))
    sums = left.join(right, ["sid", "j"]).select("sid", "i", "j", "o", "d", "o_b", "d_b").mapInPandas(
        _lag_sums(block), "sid string, apart bigint, s array<double>, n array<double>")
    lags = sums.select("sid", "apart", F.posexplode(F.arrays_zip("s", "n")).alias("at", "e")).select(
        "sid", (F.col("apart") * block + F.col("at") - (block - 1)).alias("lag"), "e.s", "e.n").filter("lag >= 1 AND n > 0")
    if max_lag is not None:
        lags = lags.filter(F.col("lag") <= max(int(max_lag), 1))
    j = lags.groupBy("sid", "lag").agg(F.sum("s").alias("_s")).join(stats, "sid")
    r = F.try_divide(F.col("_s") / F.col("_n"), F.col("_c0"))
    return j.select("sid", F.col("lag").cast("bigint").alias("lag"), r.alias("acf"),
                    (F.lit(2.5758293035489004) / F.sqrt(F.col("_n"))).alias("band99"),
                    (F.lit(1.959963984540054) / F.sqrt(F.col("_n"))).alias("band95"))


def cluster_features(panel: DataFrame, value: str = "v", block: int = 512) -> DataFrame:
    """(mean, std, min, max, skew, kurt, ac1, ac7, ac14) per series,
    standardized across series (ddof 0); undefined entries -> 0 (T19)."""
    a = series_stats(panel, value).select("sid", "mean", "std", "min", "max")
    b = series_shape(panel, value)
    c = autocorr_lags(panel, (1, 7, 14), value, block)
    feats = stored(a.join(b, "sid").join(c, "sid").select("sid", *[
        F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in CLUSTER_FEATURES]), "series_features")
    # the across-series scaling is one row of means and deviations
    scale = feats.agg(F.struct(*[F.struct(F.avg(n).alias("mu"), F.stddev_pop(n).alias("sd")).alias(n) for n in CLUSTER_FEATURES])
                      .alias("s")).scalar()
    scaled = feats.withColumn("_s", scale)
    return scaled.select("sid", *[F.when(F.col(f"_s.{n}.sd") == 0, F.lit(0.0)).otherwise(
        (F.col(n) - F.col(f"_s.{n}.mu")) / F.col(f"_s.{n}.sd")).alias(n) for n in CLUSTER_FEATURES])


CLUSTER_FEATURES = ["mean", "std", "min", "max", "skew", "kurt", "ac1", "ac7", "ac14"]
