"""Tiled correlations and block-pair correlograms: same answers at every tile
and block size, gaps included."""
import numpy as np
import pandas as pd
import pytest

from tessera.operators import correlation, profile


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(11):
        for t in range(150):
            if rng.random() > 0.1 and not (s == 7 and t > 60) and not (s == 8 and t <= 60):
                rows.append((f"s{s:02d}", t, None if rng.random() < 0.05 else float(rng.normal() + (t % 7) * (s % 3)) if s != 4 else 2.0))
    return pd.DataFrame(rows, columns=["sid", "t", "v"]), spark.createDataFrame(rows, "sid string, t bigint, v double").cache()


@pytest.mark.parametrize("tile,steps", [(64, 2048), (4, 16)])
def test_tiled_pairs_equal_pandas(gaps, tile, steps):
    pdf, panel = gaps
    wide = pdf.pivot(index="t", columns="sid", values="v")
    got = {(r.sid_a, r.sid_b): r for r in correlation.pair_moments(panel, tile=tile, steps=steps).collect()}
    names = list(wide.columns)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for (a, b), r in got.items():
        both = wide[[a, b]].dropna()
        assert r.n_common == len(both), (a, b)
        if len(both) > 1:
            assert abs(r.cov - both[a].cov(both[b])) < 1e-9
        want = both[a].corr(both[b]) if len(both) > 1 and both[a].std() > 0 and both[b].std() > 0 else None
        assert (r.r is None) == (want is None) and (want is None or abs(r.r - want) < 1e-9), (a, b)
    links = {(r.sid_a, r.sid_b) for r in correlation.pair_moments(panel, least=0.3, tile=tile, steps=steps).collect()}
    assert links == {k for k, r in got.items() if r.r is not None and 0.3 < abs(r.r) < 1}


def test_nothing_of_all_pairs_on_the_driver(gaps):
    """Groups take links from the tiles; the plan has no local relation of pairs."""
    _, panel = gaps
    plan = correlation.pair_moments(panel, least=0.3)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_correlogram_of_all_lags_by_block_pairs(gaps, block):
    pdf, panel = gaps
    for most in (None, 40):
        got = {(r.sid, r.lag): r.acf for r in profile.correlogram(panel, most, block=block).collect()}
        want = {}
        for sid, g in pdf.dropna().groupby("sid"):
            x = g.set_index("t")["v"]
            d, c0, n = x - x.mean(), x.var(ddof=0), len(x)
            dense = d.reindex(range(150))
            for lag in range(1, 150 if most is None else most + 1):
                pairs = dense * dense.shift(-lag)
                if pairs.notna().any():
                    want[sid, lag] = pairs.sum() / n / c0 if c0 > 0 else None
        assert set(got) == set(want)
        for k in want:
            assert (got[k] is None and want[k] is None) or want[k] is None or abs(got[k] - want[k]) < 1e-9, k


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "sid string, t bigint, v double")
    assert correlation.pair_moments(empty).count() == 0
    assert profile.correlogram(empty, 5).count() == 0
