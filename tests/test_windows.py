"""Window features against pandas semantics (W1-W9), on halo blocks that
cut every series several times."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.config import V1, V2
from tessera.operators import windows as W


def _expected(s: pd.Series, cfg):
    exp = {}
    for k in range(1, cfg.n_lags + 1):
        a = np.roll(s.values, k)
        a[:k] = 0
        exp[f"lag{k}"] = a
    for n in cfg.rolling_windows:
        r = s.rolling(n, min_periods=1)
        exp[f"rollmean{n}"] = r.mean().values
        exp[f"rollstd{n}"] = r.std().fillna(0).values
        if cfg.rolling_minmax:
            exp[f"rollmin{n}"] = r.min().values
            exp[f"rollmax{n}"] = r.max().values
    for k in cfg.diff_orders:
        exp[f"diff{k}"] = s.diff(k).fillna(0).values
    for sp in cfg.ewm_spans:
        exp[f"ewm{sp}"] = s.ewm(span=sp).mean().values
    if cfg.lag_interaction:
        x = (s.shift(1) * s.shift(2)).values
        x[np.isnan(x)] = 0
        exp["interaction"] = x
    return exp


def _check(panel, cfg, tol=1e-9):
    f = W.series_features(panel, cfg).toPandas().sort_values(["sid", "t"])
    pdf = panel.toPandas().sort_values(["sid", "t"])
    for sid, g in pdf.groupby("sid"):
        ff = f[f.sid == sid].set_index("t")
        for c, e in _expected(g.set_index("t")["v"], cfg).items():
            assert np.max(np.abs(ff[c].values - e)) < tol * max(1.0, np.max(np.abs(e))), (sid, c)


def test_v2_features_match_pandas_across_blocks(hourly_small):
    _check(hourly_small, V2.with_(block_size=50))


def test_v1_features_match_pandas(hourly_small):
    _check(hourly_small, V1.with_(block_size=37))


def test_single_row_series(spark):
    p = spark.createDataFrame([("a", 0, 5.0)], "sid string, t bigint, v double")
    r = W.series_features(p, V2).first()
    assert r["lag1"] == 0 and r["rollstd3"] == 0 and r["diff1"] == 0 and r["ewm5"] == 5.0


def test_long_series_ewm_finite(spark):
    """The naive weighted sum overflows past t ~ 1750 for span 5; the blocked
    scan stays finite and equal to pandas."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=5000)
    p = spark.createDataFrame(pd.DataFrame({"sid": "a", "t": np.arange(5000), "v": v}))
    out = W.ewm_mean(p, (5, 20), block=512).toPandas().sort_values("t")
    for sp in (5, 20):
        exp = pd.Series(v).ewm(span=sp).mean().values
        assert np.all(np.isfinite(out[f"ewm{sp}"]))
        assert np.max(np.abs(out[f"ewm{sp}"].values - exp)) < 1e-9


def test_causal_features_do_not_see_current_value(hourly_small):
    """Leak test: with causal=True, changing y at t changes no feature at t."""
    cfg = V2.with_(causal=True, block_size=64)
    t0 = 100
    bumped = hourly_small.withColumn("v", F.when(F.col("t") == t0, F.col("v") + 1000.0).otherwise(F.col("v")))
    names = W.feature_names(cfg)
    a = W.series_features(hourly_small, cfg).filter(F.col("t") == t0).orderBy("sid").select(*names).collect()
    b = W.series_features(bumped, cfg).filter(F.col("t") == t0).orderBy("sid").select(*names).collect()
    assert a == b


def test_compat_mode_is_leaky(hourly_small):
    """Compat features (rollmean, diff, ewm) contain y_t."""
    bumped = hourly_small.withColumn("v", F.when(F.col("t") == 100, F.col("v") + 1000.0).otherwise(F.col("v")))
    a = W.series_features(hourly_small, V2).filter("t = 100").orderBy("sid").select("diff1").collect()
    b = W.series_features(bumped, V2).filter("t = 100").orderBy("sid").select("diff1").collect()
    assert a != b


def test_lead_target(hourly_small):
    out = W.lead_target(hourly_small, 3, block=40).toPandas().sort_values(["sid", "t"])
    for sid, g in out.groupby("sid"):
        exp = g["v"].shift(-3).fillna(0).values
        assert np.allclose(g["label"].values, exp)
