"""Scalar helpers of the reference (F1-F8) as Spark column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import col


def fourier_terms(t, periods, steps_per_unit: int = 24) -> list[Column]:
    """sin / cos(2*pi*t / (steps_per_unit * period)) for every period,
    named ``sin_period{p}`` / ``cos_period{p}`` in the reference order."""
    out = []
    for p in periods:
        w = 2 * math.pi / (steps_per_unit * p)
        out.append(F.sin(col(t) * F.lit(w)).alias(f"sin_period{p}"))
        out.append(F.cos(col(t) * F.lit(w)).alias(f"cos_period{p}"))
    return out


def threshold_pred(r, lo: float, hi: float = 1.0) -> Column:
    """lo < |r| < hi."""
    a = F.abs(col(r))
    return (a > lo) & (a < hi)


def pct_improvement(new, old) -> Column:
    """(new - old) / old * 100."""
    return (col(new) - col(old)) / col(old) * 100
