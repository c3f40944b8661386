"""Property tests for the model-side operators."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import cluster, correlation, ensemble, linear, reduce
from tessera.sources import panels, tables

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(7)
    n, p, sids = 60, 80, ["a", "b", "c"]  # p > n: OLS is under-determined (T16)
    X = rng.normal(size=(n, p))
    X[:, 5] = 1.0  # a constant column
    Y = {s: X[:, :4] @ rng.normal(size=4) + rng.normal(scale=0.1, size=n) for s in sids}
    xdf = spark.createDataFrame([(t, X[t].tolist()) for t in range(n)], "t bigint, x array<double>").select(
        "t", array_to_vector("x").alias("features"))
    lab = spark.createDataFrame([(s, t, float(Y[s][t])) for s in sids for t in range(n)],
                                "sid string, t bigint, label double")
    return X, Y, xdf, lab, sids


def _centered(X, y):
    return X - X.mean(0), y - y.mean()


def test_gram_ols_is_min_norm_lstsq(spark, design):
    X, Y, xdf, lab, sids = design
    st = linear.gram_stats(xdf, lab, sids)
    for sid, b0, coef in linear.solve(st, "LinearRegression"):
        Xc, yc = _centered(X, Y[sid])
        b = np.linalg.lstsq(Xc, yc, rcond=None)[0]
        assert np.max(np.abs(np.array(coef) - b)) < 1e-7
        assert abs(b0 - (Y[sid].mean() - X.mean(0) @ b)) < 1e-7


def test_gram_ridge_matches_normal_equations(spark, design):
    X, Y, xdf, lab, sids = design
    st = linear.gram_stats(xdf, lab, sids)
    for sid, b0, coef in linear.solve(st, "Ridge", 1.0):
        Xc, yc = _centered(X, Y[sid])
        b = np.linalg.solve(Xc.T @ Xc + np.eye(X.shape[1]), Xc.T @ yc)
        assert np.max(np.abs(np.array(coef) - b)) < 1e-6


def test_gram_lasso_kkt(spark, design):
    X, Y, xdf, lab, sids = design
    st = linear.gram_stats(xdf, lab, sids)
    alpha = 0.1
    for sid, _, coef in linear.solve(st, "Lasso", alpha):
        b = np.array(coef)
        Xc, yc = _centered(X, Y[sid])
        g = Xc.T @ (yc - Xc @ b) / len(yc)
        act = np.abs(b) > 0
        assert act.sum() >= 1
        assert np.max(np.abs(g[act] - alpha * np.sign(b[act]))) < 1e-6
        assert np.max(np.abs(g[~act])) <= alpha + 1e-6


def test_linear_predictions_join(spark, design):
    X, Y, xdf, lab, sids = design
    st = linear.gram_stats(xdf, lab, sids)
    coefs = linear.fit_linear(spark, st, [("Ridge", "Ridge", 1.0)])
    pred = linear.predict_linear(xdf, lab, coefs).toPandas()
    sol = {s: (b0, np.array(c)) for s, b0, c in linear.solve(st, "Ridge", 1.0)}
    for r in pred.itertuples():
        b0, c = sol[r.sid]
        assert abs(r.yhat - (b0 + X[r.t] @ c)) < 1e-9


def test_svd_matches_numpy(spark):
    from tessera.operators.reshape import standardize_wide
    inp = standardize_wide(panels.inputs(spark, SF_SMALL)).cache()
    A = np.array([r["x"] for r in inp.orderBy("t").collect()])
    k = 10
    scores, s = reduce.svd_reduce(inp, k)
    sv = np.linalg.svd(A, compute_uv=False)[:k]
    assert np.allclose(s, sv, rtol=1e-8)
    S = np.array([r["x"] for r in scores.orderBy("t").collect()])
    # scores are orthogonal with squared norms sigma^2 (sign-free check)
    G = S.T @ S
    assert np.allclose(G, np.diag(sv ** 2), atol=1e-6 * sv[0] ** 2)
    ev = reduce.explained_variance(scores, inp).first()["explained_variance"]
    assert abs(ev - (sv ** 2).sum() / (A ** 2).sum()) < 1e-9


def test_kmeans_restarts_not_worse(spark):
    from tessera.operators.profile import cluster_features
    feats = cluster_features(panels.monthly(spark, SF_SMALL)).cache()
    _, best = cluster.kmeans_groups(feats, 3, seed=42, restarts=4)
    for s in range(42, 46):
        _, single = cluster.kmeans_groups(feats, 3, seed=s, restarts=1)
        assert best <= single + 1e-9


def test_stacking_matches_sklearn_ridge_form(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sid in ("a", "b"):
        for t in range(40):
            y = rng.normal()
            rows += [("m1", sid, t, y, y + rng.normal(scale=0.3)), ("m2", sid, t, y, 0.5 * y + rng.normal(scale=0.3))]
    df = spark.createDataFrame(rows, "family string, sid string, t bigint, y double, yhat double")
    fit = {r["sid"]: r for r in ensemble.stack_fit(df, ["m1", "m2"], 0.1).collect()}
    pdf = pd.DataFrame(rows, columns=["family", "sid", "t", "y", "yhat"])
    for sid in ("a", "b"):
        w = pdf[pdf.sid == sid].pivot(index="t", columns="family", values="yhat")
        y = pdf[(pdf.sid == sid) & (pdf.family == "m1")].set_index("t").y.loc[w.index].values
        Xc = w.values - w.values.mean(0)
        b = np.linalg.solve(Xc.T @ Xc + 0.1 * np.eye(2), Xc.T @ (y - y.mean()))
        assert np.allclose(fit[sid]["coef"], b, atol=1e-9)
        assert abs(fit[sid]["intercept"] - (y.mean() - w.values.mean(0) @ b)) < 1e-9


def test_constant_series_corr_is_null(spark):
    rows = [("c", t, 3.0) for t in range(20)] + [("x", t, float(t % 7)) for t in range(20)]
    p = spark.createDataFrame(rows, "sid string, t bigint, v double")
    r = correlation.corr_matrix(p).first()
    assert r["r"] is None
    from tessera.operators.profile import autocorr_lags
    ac = {x["sid"]: x["ac1"] for x in autocorr_lags(p).collect()}
    assert ac["c"] is None and ac["x"] is not None


def test_connected_components_brute_force(spark):
    rng = np.random.default_rng(11)
    nodes = [f"n{i:02d}" for i in range(30)]
    edges = {tuple(sorted(rng.choice(nodes, 2, replace=False))) for _ in range(25)}
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for n in nodes:
        comp.setdefault(find(n), []).append(n)
    expected = {n: min(m) for m in comp.values() for n in m}
    ndf = spark.createDataFrame([(n,) for n in nodes], "sid string")
    edf = spark.createDataFrame(list(edges), "sid_a string, sid_b string")
    got = {r["sid"]: r["component"] for r in correlation.connected_components(ndf, edf).collect()}
    assert got == expected


def test_row_index_dense(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 3 + 1).alias("k"), F.rand(1).alias("r"))
    out = tables.row_index(df.orderBy("r"), "k").toPandas().sort_values("k")
    assert list(out["t"]) == list(range(5000))


def test_correlogram_matches_pandas_formula(spark, hourly_small):
    from tessera.operators.profile import correlogram
    pdf = hourly_small.toPandas()
    out = correlogram(hourly_small, 30, block=64).toPandas()
    for sid, g in pdf.groupby("sid"):
        x = g.sort_values("t")["v"].values
        n, mu = len(x), x.mean()
        c0 = ((x - mu) ** 2).sum() / n
        for h in (1, 5, 30):
            exp = ((x[:n - h] - mu) * (x[h:] - mu)).sum() / n / c0
            got = out[(out.sid == sid) & (out.lag == h)]["acf"].iloc[0]
            assert abs(got - exp) < 1e-10


def test_grid_search_over_expanding_folds(spark, design):
    """G2 with a Spark ML estimator: the winner is the least mean fold MSE
    (first grid point on ties), and every point is scored on every fold."""
    from tessera.config import V2
    from tessera.operators import models
    X, Y, xdf, lab, sids = design
    folds = spark.createDataFrame([(1, 0, 15, 30), (2, 0, 30, 45), (3, 0, 45, 60)],
                                  "fold bigint, train_lo bigint, test_lo bigint, test_hi bigint")
    grid = {"n_estimators": [3], "learning_rate": [0.1], "max_depth": [1, 2], "subsample": [1.0]}
    best, mse, table = models.grid_search(xdf, lab, "GradientBoosting", "a", folds, grid, V2.with_(fit_parallelism=2))
    rows = sorted((r["point"], r["cv_mse"]) for r in table.collect())
    assert len(rows) == 2
    win = min(rows, key=lambda r: (r[1], r[0]))
    assert abs(mse - win[1]) < 1e-12
    assert best == models.grid_points(grid)[win[0]]


@pytest.mark.parametrize("cells", [1 << 23, 0])
def test_series_solved_from_rows_equal_the_gram_pass(spark, design, cells):
    """OLS, Ridge and Lasso with p > n: a task's SVD and residual descent, or the Gram pass."""
    X, Y, xdf, lab, sids = design
    fits = [("o", "LinearRegression", 0.0), ("r", "Ridge", {"a": 1.0, "b": 2.0, "c": 1.0}), ("l", "Lasso", 0.1)]
    got = {(r.family, r.sid): r for r in linear.fit_series(xdf, lab, fits, local_cells=cells).collect()}
    st = linear.gram_stats(xdf, lab, sids)
    for name, family, alpha in fits:
        for s in sids:
            want = {r[0]: r for r in linear.solve(st, family, alpha[s] if isinstance(alpha, dict) else alpha)}[s]
            assert abs(got[name, s].intercept - want[1]) < 1e-6
            assert np.max(np.abs(np.array(got[name, s].coef) - np.array(want[2]))) < 1e-6


def test_series_with_own_rows(spark, design):
    """A series that lacks steps is solved on its own rows."""
    X, Y, xdf, lab, sids = design
    some = lab.filter("sid != 'b' OR t % 3 != 0")
    got = {r.sid: r for r in linear.fit_series(xdf, some, [("r", "Ridge", 1.0)]).collect()}
    keep = np.array([t for t in range(60) if t % 3])
    Xc, yc = _centered(X[keep], Y["b"][keep])
    b = np.linalg.solve(Xc.T @ Xc + np.eye(X.shape[1]), Xc.T @ yc)
    assert np.max(np.abs(np.array(got["b"].coef) - b)) < 1e-6


def test_randomized_svd_of_wide_inputs(spark):
    """The range finder: same singular values and scores (up to sign) on a decaying spectrum."""
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(120, 120)))[0], np.linalg.qr(rng.normal(size=(300, 300)))[0]
    A = u[:, :60] * 0.7 ** np.arange(60) @ v[:60]
    inp = spark.createDataFrame([(t, A[t].tolist()) for t in range(120)], "t bigint, x array<double>").repartition(5).cache()
    scores, s = reduce.svd_reduce(inp, 10, gram_width=100)
    assert np.allclose(s, 0.7 ** np.arange(10), atol=1e-8)
    S = np.array([r["x"] for r in scores.orderBy("t").collect()])
    assert np.allclose(np.abs(S), np.abs(u[:, :10] * 0.7 ** np.arange(10)), atol=1e-6)
    again = reduce.svd_reduce(inp.repartition(2), 10, gram_width=100)[1]
    assert np.allclose(s, again, atol=1e-12)


def test_kmeans_cost_is_that_of_its_groups(spark):
    from tessera.operators.profile import CLUSTER_FEATURES, cluster_features
    feats = cluster_features(panels.monthly(spark, SF_SMALL)).cache()
    groups, cost = cluster.kmeans_groups(feats, 3, seed=1, restarts=3)
    pdf = feats.join(groups, "sid").toPandas()
    x = pdf[CLUSTER_FEATURES].to_numpy()
    want = sum(((x[pdf.group_id == g] - x[pdf.group_id == g].mean(0)) ** 2).sum() for g in set(pdf.group_id))
    assert abs(cost - want) < 1e-9 and pdf.group_id.nunique() == 3
    assert cluster.kmeans_groups(feats.limit(0), 3)[0].count() == 0


def test_wide_file_as_one_array_column(spark, tmp_path):
    path = tmp_path / "wide.csv"
    width = 4000
    rows = [[str(r * 0.5 + c) if (r + c) % 7 else "" for c in range(width)] for r in range(6)]
    path.write_text("\n".join([",".join(f"c{c}" for c in range(width)), *map(",".join, rows)]) + "\n")
    wide, names = tables.read_wide_array(spark, str(path))
    assert len(names) == width and wide.count() == 6
    long = tables.wide_array_to_long(wide, names)
    assert len(long._jdf.queryExecution().analyzed().toString()) < 1_000_000
    got = {(r.sid, r.t): r.v for r in long.filter("sid in ('c0', 'c13', 'c3999')").collect()}
    assert got == {(f"c{c}", r): (r * 0.5 + c if (r + c) % 7 else None) for c in (0, 13, 3999) for r in range(6)}
