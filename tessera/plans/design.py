"""The shared design matrix of the forecasting pipeline (stages 3-5).

inputs --P4--> standardized --R1--> SVD scores (t, k)
panel  --P3--> z --W*/F1--> per-series features --P6--> per-t vector
X = [svd | series features | fourier] on the t's present in both (J1)
labels = (sid, t, label = z at t, or forecast_horizon steps ahead, split) on the same t's (D1, W10)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PanelConfig
from ..operators import reduce, reshape, select, split, windows
from ..operators.correlation import series_order
from ..sources import panels
from . import common as C


@dataclass
class Design:
    X: DataFrame            # (t, features VECTOR), cached
    labels: DataFrame       # (sid, t, label, split)
    stats: DataFrame        # scaler (sid, mu, sd)
    dictionary: DataFrame   # (idx, name, grp)
    sids: list
    n_features: int
    k: int
    singular_values: list
    scores: DataFrame
    inputs: DataFrame


def build_design(spark: SparkSession, base: str, cfg: PanelConfig, panel: DataFrame | None = None,
                 use_svd: bool = True) -> Design:
    panel = panel if panel is not None else C.hourly(spark, base)
    inp = panels.inputs(spark, base)
    # Keep the time steps present in both the panel and the inputs
    steps = panel.select("t").distinct()
    inp = inp.join(steps, "t", "left_semi")
    panel = panel.join(inp.select("t"), "t", "left_semi")
    if cfg.fit_on == "train":
        b = split.split_bounds(panel, cfg)
        fit_rows = F.col("t") < b.select("train_end").scalar()
    else:
        fit_rows = None
    st = reshape.scaler_stats(panel, rows=fit_rows)
    z = reshape.standardize(panel, st).select("sid", "t", F.col("z").alias("v"))
    sids = series_order(panel)
    k, svals, scores = 0, [], None
    if use_svd:
        inp_std = reshape.standardize_wide(inp, rows=fit_rows).cache()
        n_rows = inp_std.count()
        width = inp_std.select(F.max(F.size("x"))).first()[0]
        k = reduce.n_components(n_rows, width, cfg.n_components)
        scores, svals = reduce.svd_reduce(inp_std, k, rows=fit_rows)
        scores = scores.cache()
    feats = windows.series_features(z, cfg)
    fourier = [windows.fourier_frame(z.select("t").distinct(), cfg)] if cfg.fourier_periods else []
    names = windows.feature_names(cfg)
    asm = select.assemble_features(feats, names, fourier, prefix=scores)
    X = asm.select("t", array_to_vector("features").alias("features")).cache()
    # The label is the value ``forecast_horizon`` steps ahead; the last steps have none and are dropped by D1
    ahead = windows.lead_target(z, cfg.forecast_horizon, cfg.block_size)
    labels = split.chronological_split(ahead, cfg).select("sid", "t", "label", "split").cache()
    d = C.feature_dictionary(spark, sids, cfg, n_svd=k)
    nf = k + len(names) * len(sids) + 2 * len(cfg.fourier_periods)
    return Design(X, labels, st, d, sids, nf, k, svals, scores, inp_std if use_svd else inp)
