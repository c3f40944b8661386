"""Aggregate and scalar column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def paired(x, y) -> tuple[Column, Column]:
    """Null each side where the other is null (pairwise-complete semantics)."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def safe_corr(x, y) -> Column:
    """Pearson r over rows where both sides are present; NULL (not an error)
    when either side is constant or fewer than two rows remain (T19)."""
    px, py = paired(x, y)
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def adjusted_skew(x) -> Column:
    """Bias-adjusted sample skewness G1 (pandas ``skew``); NULL when n < 3."""
    n = F.count(col(x)).cast("double")
    g1 = F.skewness(col(x))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x) -> Column:
    """Bias-adjusted excess kurtosis G2 (pandas ``kurt``); NULL when n < 4."""
    n = F.count(col(x)).cast("double")
    g2 = F.kurtosis(col(x))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def r2_from_sums(sse, sst) -> Column:
    """R^2 = 1 - SSE/SST; a constant target scores 1 if perfect else 0."""
    sse, sst = col(sse), col(sst)
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        1 - sse / sst)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def round6(c) -> Column:
    """Rounded output for value comparison; ``+ 0.0`` folds -0.0 into 0.0."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def ewm_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def carry_blocks(q: float, block: int, tol: float = 1e-18) -> int:
    """How many preceding blocks an exponentially decaying carry must fold so
    the dropped tail weighs less than ``tol`` (relative)."""
    qb = q ** block
    if qb <= 0.0:
        return 1
    if qb >= 1.0:
        raise ValueError("decay factor must be < 1")
    return max(1, math.ceil(math.log(tol) / math.log(qb)))
