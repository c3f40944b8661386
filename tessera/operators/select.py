"""Feature assembly (P6, P8) and importance-based selection.

Importances live in a long table ``(idx, importance)`` (optionally per
``sid``); ranking and running sums are windows over the feature axis, which
is bounded by the feature count, never by the data.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import safe_corr


def assemble_features(feats: DataFrame, names: list[str], extra: list[DataFrame] = (),
                      prefix: DataFrame | None = None) -> DataFrame:
    """One row per t with every series' features in feature-major,
    series-minor order (``lag1_output0, lag1_output1, ...``), then the
    columns of each ``extra`` per-t table (e.g. Fourier); ``prefix`` (t, x)
    goes first (the SVD scores). Each t-group holds one struct per series."""
    packed = feats.groupBy("t").agg(F.array_sort(F.collect_list(
        F.struct("sid", F.array(*[F.col(n).cast("double") for n in names]).alias("f")))).alias("_a"))
    k = F.sequence(F.lit(0), F.lit(len(names) - 1))
    arr = F.flatten(F.transform(k, lambda i: F.transform("_a", lambda e: e["f"][i])))
    out = packed.select("t", arr.alias("features"))
    for e in extra:
        cols = [c for c in e.columns if c != "t"]
        out = out.join(e, "t").select("t", F.concat("features", F.array(*[F.col(c).cast("double") for c in cols]))
                                      .alias("features"))
    if prefix is not None:
        out = out.join(prefix, "t").select("t", F.concat(F.col("x").cast("array<double>"), "features")
                                           .alias("features"))
    return out


def slice_features(df: DataFrame, indices: list[int], col: str = "features",
                   out: str = "selected") -> DataFrame:
    """Keep the selected positions of a vector (or array) column."""
    from pyspark.ml.linalg import VectorUDT
    is_vec = isinstance(df.schema[col].dataType, VectorUDT)
    src = df if is_vec else df.withColumn(col, array_to_vector(col))
    return VectorSlicer(inputCol=col, outputCol=out, indices=list(indices)).transform(src)


def stand_in_importance(assembled: DataFrame, labels: DataFrame) -> DataFrame:
    """Deterministic stand-in for tree importances: corr(feature, label)^2
    normalized to sum 1. ``labels`` is (t, y) of the reference series,
    1:1 on t; positions are exploded in-task and reduced with partial
    aggregation, so only (idx) sums cross the shuffle."""
    j = assembled.join(labels, "t")
    long = j.select(F.posexplode("features").alias("idx", "x"), "y")
    r2 = long.groupBy("idx").agg(F.coalesce(F.pow(safe_corr("x", "y"), 2), F.lit(0.0)).alias("_r2"))
    tot = F.sum("_r2").over(Window.partitionBy())  # one row per feature
    return r2.select(F.col("idx").cast("int").alias("idx"),
                     F.when(tot > 0, F.col("_r2") / tot).otherwise(F.lit(0.0)).alias("importance"))


def _order(by_sid: bool) -> Window:
    w = Window.partitionBy("sid") if by_sid else Window.partitionBy()
    return w.orderBy(F.desc("importance"), "idx")


def importance_rank(imp: DataFrame) -> DataFrame:
    """O1: rank by importance descending (idx breaks ties)."""
    by_sid = "sid" in imp.columns
    return imp.withColumn("rank", F.row_number().over(_order(by_sid)).cast("bigint"))


def top_importance(imp: DataFrame, k: int = 30) -> DataFrame:
    """O2."""
    return importance_rank(imp).filter(F.col("rank") <= k)


def cumulative_importance(imp: DataFrame) -> DataFrame:
    """Running sum in rank order."""
    by_sid = "sid" in imp.columns
    w = _order(by_sid).rowsBetween(Window.unboundedPreceding, 0)
    return importance_rank(imp).withColumn("cum_importance", F.sum("importance").over(w))


def select_by_importance(imp: DataFrame, threshold: float, floor: int) -> DataFrame:
    """The smallest prefix whose cumulative importance reaches
    ``threshold`` (1 if never, as argmax of all-False), at least ``floor``
    features, at most all of them (T9)."""
    cum = cumulative_importance(imp)
    keys = ["sid"] if "sid" in imp.columns else []
    hit = F.min(F.when(F.col("cum_importance") >= threshold, F.col("rank")))
    n_sel = F.least(F.greatest(F.coalesce(hit, F.lit(1)), F.lit(floor)), F.count(F.lit(1)))
    if keys:
        n = cum.groupBy(*keys).agg(n_sel.alias("n_selected"))
        return cum.join(n, keys).filter(F.col("rank") <= F.col("n_selected"))
    n = cum.agg(n_sel.alias("n_selected")).scalar()
    return cum.filter(F.col("rank") <= n).withColumn("n_selected", n.cast("bigint"))


def group_importance(imp: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Total importance per feature group (dictionary: idx, name, grp)."""
    keys = ["sid"] if "sid" in imp.columns else []
    return imp.join(dictionary, "idx").groupBy(*keys, "grp").agg(
        F.sum("importance").alias("importance"))
