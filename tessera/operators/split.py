"""Chronological split (D1) and expanding-window folds.

Cut points are computed once as a one-row aggregate and applied through
scalar subqueries, so labelling rows is a narrow projection (no join, no
sort, no driver round trip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig


def split_bounds(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """One row: n, start, train_end, val_end, end (reference index arithmetic,
    truncating ``int()`` in double precision, F5)."""
    n = F.max("t") + 1
    start = F.lit(cfg.n_lags if cfg.n_lags else 0)
    end = n - cfg.forecast_horizon if cfg.forecast_horizon > 1 else n
    adjusted = (end - start).cast("double")
    train_end = start + F.floor(adjusted * F.lit(1 - cfg.test_size - cfg.val_size))
    val_end = start + F.floor(adjusted * F.lit(1 - cfg.test_size))
    return panel.agg(n.cast("bigint").alias("n"), start.cast("bigint").alias("start"),
                     train_end.cast("bigint").alias("train_end"),
                     val_end.cast("bigint").alias("val_end"), end.cast("bigint").alias("end"))


def chronological_split(panel: DataFrame, cfg: PanelConfig,
                        bounds: DataFrame | None = None) -> DataFrame:
    """Add ``split`` in {train, val, test, drop}."""
    b = bounds if bounds is not None else split_bounds(panel, cfg)
    start, te, ve, end = (b.select(c).scalar() for c in ("start", "train_end", "val_end", "end"))
    t = F.col("t")
    split = (F.when(t < start, "drop").when(t < te, "train").when(t < ve, "val")
             .when(t < end, "test").otherwise("drop"))
    return panel.withColumn("split", split)


def fold_bounds(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """D2 bounds: ``TimeSeriesSplit(k)`` over the train rows; test size
    n_train // (k + 1), fold i tests [n_train - (k-i+1)*ts, + ts)."""
    b = split_bounds(panel, cfg)
    k = cfg.cv_folds
    n_train = F.col("train_end") - F.col("start")
    ts = F.floor(n_train / (k + 1))
    folds = F.sequence(F.lit(1), F.lit(k))
    return b.select("start", F.explode(folds).alias("fold"), n_train.alias("n_train"),
                    ts.alias("ts")).select(
        "fold",
        F.col("start").alias("train_lo"),
        (F.col("start") + F.col("n_train") - (k - F.col("fold") + 1) * F.col("ts")).alias("test_lo"),
        (F.col("start") + F.col("n_train") - (k - F.col("fold")) * F.col("ts")).alias("test_hi"),
    )


def expanding_folds(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Rows tagged ``(fold, role)``; each row appears at most k times.

    The fold table has k rows (bounded by the configuration), so it is
    broadcast; each panel row meets it once inside its task.
    """
    fb = fold_bounds(panel, cfg)
    j = panel.join(F.broadcast(fb), (F.col("t") >= F.col("train_lo")) & (F.col("t") < F.col("test_hi")))
    role = F.when(F.col("t") < F.col("test_lo"), "train").otherwise("test")
    return j.select(*panel.columns, F.col("fold").cast("bigint").alias("fold"), role.alias("role"))
