"""Window features over a dense long panel.

Physical layout
---------------
A time-ordered window per series would put a whole series into one task,
which fails when one series holds a large share of the rows. Every bounded
window here therefore runs on ``(sid, block)`` partitions: the panel is cut
into blocks of ``block`` consecutive steps and the last ``lookback`` rows of
each block are copied into the next one as *halo* rows (and the first
``lookahead`` rows into the previous one). Windows evaluate over the halo,
then halo rows are dropped. The duplicate volume is ``lookback / block``.

The exponentially weighted mean (W8) has unbounded memory, so it runs as a
blocked scan: a running sum inside each block plus a carry folded from the
preceding blocks' totals (only as many blocks as the decay leaves visible
in double precision). It is exact to rounding and parallel inside a series.

All windows require a dense ``t`` per series (the panel builders fill gaps),
so a row offset equals a time offset.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PanelConfig
from ..functions.scalar import fourier_terms
from ..functions.stats import carry_blocks, ewm_alpha

HALO = "_halo"
BLK = "_blk"


def block_layout(panel: DataFrame, block: int, lookback: int = 0,
                 lookahead: int = 0) -> tuple[DataFrame, int]:
    """Assign every row to its block, plus halo copies for its neighbours."""
    block = max(int(block), int(lookback), int(lookahead), 1)
    t = F.col("t")
    blk = F.floor(t / F.lit(block)).cast("bigint")
    o = t - blk * block
    parts = [F.struct(blk.alias(BLK), F.lit(False).alias(HALO))]
    if lookback:
        parts.append(F.when(o >= block - lookback,
                            F.struct((blk + 1).alias(BLK), F.lit(True).alias(HALO))))
    if lookahead:
        parts.append(F.when(o < lookahead,
                            F.struct((blk - 1).alias(BLK), F.lit(True).alias(HALO))))
    arr = F.filter(F.array(*parts), lambda s: s.isNotNull())
    # An explicit exchange: rows that arrive partitioned by series would satisfy
    # the window's clustering as they are, and a series would be one task.
    return panel.select("*", F.inline(arr)).repartition("sid", BLK), block


def block_window() -> Window:
    return Window.partitionBy("sid", BLK).orderBy("t")


def frame(w: Window, back: int, fwd: int = 0) -> Window:
    return w.rowsBetween(-back, fwd)


def windowed(panel: DataFrame, build, lookback: int = 0, lookahead: int = 0,
             block: int = 512) -> DataFrame:
    """Evaluate ``build(window) -> [Column]`` on the halo layout and return
    the panel's columns plus the built ones, halo rows removed."""
    lay, _ = block_layout(panel, block, lookback, lookahead)
    cols = build(block_window())
    out = lay.select(*panel.columns, *cols, HALO)
    return out.filter(~F.col(HALO)).drop(HALO)


# ---------------------------------------------------------------- expressions
def lag_cols(w: Window, lags, v: str = "v") -> list[Column]:
    """Lag k zero-filled (the reference clears the first k rows)."""
    return [F.lag(v, k, 0.0).over(w).alias(f"lag{k}") for k in lags]


def rolling_cols(w: Window, windows, stats=("mean", "std", "min", "max"),
                 v: str = "v", shift: int = 0) -> list[Column]:
    """Trailing min_periods=1 statistics; std of a single row is 0."""
    out = []
    for n in windows:
        f = w.rowsBetween(-(n - 1) - shift, -shift)
        for s in stats:
            if s == "mean":
                c = F.avg(v).over(f)
            elif s == "std":
                c = F.coalesce(F.stddev_samp(v).over(f), F.lit(0.0))
            elif s == "min":
                c = F.min(v).over(f)
            else:
                c = F.max(v).over(f)
            out.append(c.alias(f"roll{s}{n}"))
    return out


def rolling_full_cols(w: Window, n: int, v: str = "v") -> list[Column]:
    """Mean / std that stay NULL until the window holds n rows."""
    f = w.rowsBetween(-(n - 1), 0)
    full = F.count(v).over(f) >= n
    return [F.when(full, F.avg(v).over(f)).alias(f"fullmean{n}"),
            F.when(full, F.stddev_samp(v).over(f)).alias(f"fullstd{n}")]


def diff_cols(w: Window, orders, v: str = "v", shift: int = 0) -> list[Column]:
    """Period-k difference y_t - y_{t-k}; undefined -> 0 (T4)."""
    out = []
    for k in orders:
        cur = F.col(v) if shift == 0 else F.lag(v, shift).over(w)
        out.append(F.coalesce(cur - F.lag(v, k + shift).over(w), F.lit(0.0)).alias(f"diff{k}"))
    return out


def interaction_col(w: Window, v: str = "v") -> Column:
    """y_{t-1} * y_{t-2}, undefined -> 0."""
    return F.coalesce(F.lag(v, 1).over(w) * F.lag(v, 2).over(w), F.lit(0.0)).alias("interaction")


# ---------------------------------------------------------------- operators
def lag_features(panel: DataFrame, lags=range(1, 9), block: int = 512) -> DataFrame:
    lags = list(lags)
    return windowed(panel, lambda w: lag_cols(w, lags), max(lags), 0, block)


def rolling_features(panel: DataFrame, windows=(3, 7, 14, 30),
                     stats=("mean", "std", "min", "max"), block: int = 512) -> DataFrame:
    return windowed(panel, lambda w: rolling_cols(w, windows, stats),
                    max(windows) - 1, 0, block)


def rolling_full(panel: DataFrame, n: int = 14, block: int = 512) -> DataFrame:
    return windowed(panel, lambda w: rolling_full_cols(w, n), n - 1, 0, block)


def diff_features(panel: DataFrame, orders=(1, 2, 3), block: int = 512) -> DataFrame:
    return windowed(panel, lambda w: diff_cols(w, orders), max(orders), 0, block)


def lag_interaction(panel: DataFrame, block: int = 512) -> DataFrame:
    return windowed(panel, lambda w: [interaction_col(w)], 2, 0, block)


def lead_target(panel: DataFrame, horizon: int = 1, block: int = 512) -> DataFrame:
    """label = y_{t+h} (tail 0) when h > 1; h = 1 keeps y_t."""
    if horizon <= 1:
        return panel.withColumn("label", F.col("v"))
    return windowed(panel, lambda w: [F.lead("v", horizon, 0.0).over(w).alias("label")],
                    0, horizon, block)


# ---------------------------------------------------------------- EWM
def ewm_block_limit(spans, block: int) -> int:
    """Largest block for which the in-block weights q^-o stay far inside the
    double range (q^-block <= 1e300) for every span."""
    limit = block
    for s in spans:
        q = 1.0 - ewm_alpha(s)
        limit = min(limit, int(300 / -math.log10(q)))
    return max(1, limit)


def _ewm_block_exprs(spans, block: int, v: str = "v"):
    """Per span: the in-block running sum of v*q^-o (halo rows excluded)."""
    o = F.col("t") - F.col(BLK) * block
    out = []
    for s in spans:
        q = 1.0 - ewm_alpha(s)
        if block * -math.log10(q) > 300:
            raise ValueError(f"block {block} too long for span {s}: q^-block overflows")
        term = F.when(~F.col(HALO), F.col(v) * F.pow(F.lit(q), -o))
        out.append(F.sum(term).over(
            Window.partitionBy("sid", BLK).orderBy("t")
            .rowsBetween(Window.unboundedPreceding, 0)).alias(f"_ls{s}"))
    return out


def _ewm_carries(rows: DataFrame, spans, block: int, v: str = "v") -> DataFrame:
    """(sid, blk, carry per span): EWM numerator at the end of the previous block."""
    o = F.col("t") - F.col(BLK) * block
    totals = rows.groupBy("sid", BLK).agg(*[
        F.sum(F.col(v) * F.pow(F.lit(1.0 - ewm_alpha(s)), F.lit(block - 1) - o)).alias(f"_T{s}")
        for s in spans])
    cols = []
    for s in spans:
        q = 1.0 - ewm_alpha(s)
        k = carry_blocks(q, block)
        qb = q ** block
        f = Window.partitionBy("sid").orderBy(BLK).rowsBetween(-k, -1)
        prev = F.collect_list(f"_T{s}").over(f)
        cols.append(F.aggregate(prev, F.lit(0.0), lambda acc, x: acc * F.lit(qb) + x)
                    .alias(f"_C{s}"))
    return totals.select("sid", BLK, *cols)


def _ewm_finish(df: DataFrame, spans, block: int, shift_causal: bool = False) -> list[Column]:
    o = (F.col("t") - F.col(BLK) * block).cast("double")
    out = []
    for s in spans:
        q = 1.0 - ewm_alpha(s)
        num = F.pow(F.lit(q), o) * F.col(f"_ls{s}") + F.pow(F.lit(q), o + 1) * F.coalesce(
            F.col(f"_C{s}"), F.lit(0.0))
        den = (1 - F.pow(F.lit(q), F.col("t").cast("double") + 1)) / (1 - q)
        out.append((num / den).alias(f"ewm{s}"))
    return out


def ewm_mean(panel: DataFrame, spans=(5, 10, 20), block: int = 512) -> DataFrame:
    """W8 on its own: pandas ``ewm(span).mean()`` with adjust=True."""
    lay, block = block_layout(panel, ewm_block_limit(spans, block), 0, 0)
    local = lay.select(*panel.columns, BLK, HALO, *_ewm_block_exprs(spans, block))
    core = local.filter(~F.col(HALO))
    carries = _ewm_carries(core, spans, block)
    j = core.join(carries, ["sid", BLK], "left")
    return j.select(*panel.columns, *_ewm_finish(j, spans, block))


# ---------------------------------------------------------------- all features
def feature_names(cfg: PanelConfig) -> list[str]:
    """Per-series feature columns in the reference's block order."""
    names = [f"lag{k}" for k in range(1, cfg.n_lags + 1)]
    stats = ("mean", "std", "min", "max") if cfg.rolling_minmax else ("mean", "std")
    for n in cfg.rolling_windows:
        names += [f"roll{s}{n}" for s in stats]
    names += [f"diff{k}" for k in cfg.diff_orders]
    names += [f"ewm{s}" for s in cfg.ewm_spans]
    if cfg.lag_interaction:
        names.append("interaction")
    return names


def series_features(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Every per-series feature of ``cfg`` in one exchange + one window pass.

    compat mode (``causal=False``) keeps y_t inside rolling / diff / EWM
    features like the reference (T1); ``causal=True`` ends those frames at t-1.
    """
    stats = ("mean", "std", "min", "max") if cfg.rolling_minmax else ("mean", "std")
    sh = 1 if cfg.causal else 0
    back = cfg.max_lookback
    lay, block = block_layout(panel, ewm_block_limit(cfg.ewm_spans, cfg.block_size), back, 0)

    def build(w):
        cols = lag_cols(w, range(1, cfg.n_lags + 1))
        cols += rolling_cols(w, cfg.rolling_windows, stats, shift=sh)
        cols += diff_cols(w, cfg.diff_orders, shift=sh)
        if cfg.lag_interaction:
            cols.append(interaction_col(w))
        return cols

    w = block_window()
    local = lay.select(*panel.columns, BLK, HALO, *build(w), *_ewm_block_exprs(cfg.ewm_spans, block))
    core = local.filter(~F.col(HALO))
    if cfg.ewm_spans:
        carries = _ewm_carries(core, cfg.ewm_spans, block)
        core = core.join(carries, ["sid", BLK], "left")
        ewm = _ewm_finish(core, cfg.ewm_spans, block)
    else:
        ewm = []
    names = feature_names(cfg)
    out = core.select(*panel.columns, *[c for c in names if not c.startswith("ewm")], *ewm)
    if cfg.causal and cfg.ewm_spans:
        # EWM known at t is the one ending at t-1: shift inside the same layout
        out = windowed(out, lambda w2: [F.coalesce(F.lag(f"ewm{s}", 1).over(w2), F.lit(0.0))
                                        .alias(f"_e{s}") for s in cfg.ewm_spans], 1, 0, block)
        for s in cfg.ewm_spans:
            out = out.drop(f"ewm{s}").withColumnRenamed(f"_e{s}", f"ewm{s}")
    return out.select(*panel.columns, *names)


def fourier_frame(steps: DataFrame, cfg: PanelConfig) -> DataFrame:
    """F1 on the distinct time steps."""
    return steps.select("t", *fourier_terms(F.col("t"), cfg.fourier_periods,
                                           cfg.steps_per_period_unit))
