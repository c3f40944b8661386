"""Tree growth of all series together: an exact reference on tied-free data,
both ways of growing, the model table and importances."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.config import V2
from tessera.operators import model_table, trees

N, WIDTH = 90, 6


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(N, WIDTH))
    Y = {"a": 2 * X[:, 0] + np.sin(2 * X[:, 1]) + 0.05 * rng.normal(size=N), "b": X[:, 2] * X[:, 3] + 0.05 * rng.normal(size=N)}
    xdf = spark.createDataFrame([(t, X[t].tolist()) for t in range(N)], "t bigint, features array<double>").cache()
    lab = spark.createDataFrame([(s, t, float(Y[s][t]), "train" if t < 70 else "val") for s in Y for t in range(N)],
                                "sid string, t bigint, label double, split string").cache()
    return X, Y, xdf, lab


def exact_tree(X, y, w, depth, penalty=0.0, use=None, mins=(2, 1)):
    """Greedy recursion over the midpoints of all values, whoever is in the sample: (feature, threshold, left, right) or a value."""
    W, G = w.sum(), (w * y).sum()
    value = G / (W + penalty)
    rows = np.flatnonzero(w > 0)
    best = (1e-12, None)
    if depth and len(rows) >= mins[0]:
        for f in range(X.shape[1]) if use is None else use:
            v = np.unique(X[:, f])
            for c in (v[:-1] + v[1:]) / 2:
                left = w * (X[:, f] <= c)
                right = w - left
                if min((left > 0).sum(), (right > 0).sum()) < max(mins[1], 1):
                    continue
                gain = ((left * y).sum() ** 2 / (left.sum() + penalty) + (right * y).sum() ** 2 / (right.sum() + penalty)
                        - G ** 2 / (W + penalty))
                if gain > best[0] * (1 + 1e-10):
                    best = (gain, (f, c, left, right))
    if best[1] is None:
        return value
    f, c, left, right = best[1]
    return f, c, exact_tree(X, y, left, depth - 1, penalty, use, mins), exact_tree(X, y, right, depth - 1, penalty, use, mins)


def apply(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def exact_boost(X, y, t, p, at):
    out, rest = np.full(len(at), y.mean()), y - y.mean()
    for k in range(1, p.trees + 1):
        tree = exact_tree(X, rest, trees.row_weights(p, k, t), p.depth, p.penalty, trees.used_features(p, k, X.shape[1]))
        rest = rest - p.rate * np.array([apply(tree, x) for x in X])
        out += p.rate * np.array([apply(tree, x) for x in at])
    return out


def exact_forest(X, y, t, p, at):
    mean = y.mean()
    grown = [exact_tree(X, y - mean, trees.row_weights(p, k, t), p.depth, mins=(p.min_split, p.min_leaf)) for k in range(p.trees)]
    return mean + np.mean([[apply(g, x) for x in at] for g in grown], 0)


PARAMS = {
    "boost": trees.TreeParams("boost", trees=2, depth=3, rate=0.3),
    "hist": trees.TreeParams("boost", trees=2, depth=3, rate=0.3, sample=0.7, features=0.5, penalty=1.0),
    "forest": trees.TreeParams("forest", trees=2, depth=trees.UNLIMITED),
    "pruned": trees.TreeParams("forest", trees=2, depth=4, min_split=8, min_leaf=3),
}


def near(pairs):
    """Cuts lie on bin borders, the reference's between the values at a node:
    rows between the two may go another way, so rows of the fit are compared."""
    return max(abs(a - b) for a, b in pairs)


@pytest.mark.parametrize("kind,cells", [(k, c) for k in PARAMS for c in (1 << 20, 60 * WIDTH, 0)
                                        if c != 60 * WIDTH or PARAMS[k].kind == "forest"])
def test_growth_equals_exact_reference(spark, data, kind, cells):
    """In one task (all cells allowed), by blocks and levels (none), and, for
    forests, by levels first and then in tasks."""
    X, Y, xdf, lab = data
    p = PARAMS[kind]
    grown = trees.fit_trees(xdf, lab, p, F.col("split") == "train", local_cells=cells)
    m = model_table.tree_models("m", grown, p.kind == "forest")
    got = {(r.sid, r.t): r.yhat for r in model_table.predict_models(m, xdf, lab, F.col("split") == "train").collect()}
    fit = exact_boost if p.kind == "boost" else exact_forest
    t = np.arange(70)
    numbers = range(1, p.trees + 1) if p.kind == "boost" else range(p.trees)
    inside = np.all([trees.row_weights(p, k, t) > 0 for k in numbers], 0)     # rows in every tree's sample
    assert inside.sum() >= 20
    for s, y in Y.items():
        want = fit(X[:70], y[:70], t, p, X[:70])
        assert near((got[s, i], want[i]) for i in np.flatnonzero(inside)) < 1e-9


def test_both_ways_give_the_same_trees(spark, data, monkeypatch):
    _, _, xdf, lab = data
    monkeypatch.setattr(trees, "BLOCK_ROWS", 16)
    monkeypatch.setattr(trees, "FEATURE_BLOCK", 4)
    for p in PARAMS.values():
        a, b = (trees.fit_trees(xdf, lab, p, F.col("split") == "train", local_cells=c) for c in (1 << 20, 0))
        ma, mb = (model_table.tree_models("m", g, p.kind == "forest") for g in (a, b))
        pa, pb = ({(r.sid, r.t): r.yhat for r in model_table.predict_models(m, xdf, lab).collect()} for m in (ma, mb))
        assert len(pa) == 2 * N and near((pa[k], pb[k]) for k in pa) < 1e-9
        shape = lambda g: sorted((r.sid, r.tree, sorted(r.n), r.depth) for r in g.collect())
        assert shape(a) == shape(b)


def test_own_parameters_per_series(spark, data):
    _, _, xdf, lab = data
    grown = trees.fit_trees(xdf, lab, PARAMS["boost"], per_series={"b": trees.TreeParams("boost", trees=2, depth=1, rate=1.0)})
    count = {r.sid: (r.n, r.d) for r in grown.groupBy("sid").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    assert count == {"a": (3, 3), "b": (3, 1)}


def test_all_six_families_in_one_table(spark, data, tmp_path, monkeypatch):
    from tessera.operators import models
    small = {**models.DEFAULTS, "RandomForest": {"n_estimators": 8, "max_depth": None}}
    small["GradientBoosting"] = {**small["GradientBoosting"], "n_estimators": 20}
    small["XGBoost"] = {**small["XGBoost"], "n_estimators": 20}
    monkeypatch.setattr(model_table, "DEFAULTS", small)
    _, _, xdf, lab = data
    vectors = xdf.select("t", array_to_vector("features").alias("features"))
    m = model_table.fit_models(vectors, lab, V2.families, V2, F.col("split") == "train")
    m.write.parquet(str(tmp_path / "models"))
    again = spark.read.parquet(str(tmp_path / "models"))
    preds = model_table.predict_models(again, xdf, lab, F.col("split") == "val")
    assert preds.count() == 6 * 2 * 20
    assert preds.columns == ["family", "sid", "t", "y", "yhat", "split"]
    assert preds.filter("yhat IS NULL OR isnan(yhat)").count() == 0
    plan = preds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 0                 # plan does not grow with families or series
    imp = model_table.importances(again).collect()
    total = {}
    for r in imp:
        total[r.family, r.sid] = total.get((r.family, r.sid), 0) + r.importance
    assert set(total) == {(f, s) for f in ("RandomForest", "GradientBoosting", "XGBoost") for s in "ab"}
    assert all(abs(v - 1) < 1e-9 for v in total.values())
    top = {(r.family, r.sid): r.idx for r in sorted(imp, key=lambda r: r.importance)}
    assert all(top[f, "a"] == 0 for f in ("RandomForest", "GradientBoosting", "XGBoost"))


def test_constant_labels_and_single_rows(spark):
    xdf = spark.createDataFrame([(t, [float(t), 1.0]) for t in range(5)], "t bigint, features array<double>")
    lab = spark.createDataFrame([("c", t, 3.0) for t in range(5)] + [("one", 2, 7.0), ("none", 9, 1.0), ("null", 1, None)],
                                "sid string, t bigint, label double")
    for p in (PARAMS["boost"], PARAMS["forest"]):
        for cells in (1 << 20, 0):
            m = model_table.tree_models("m", trees.fit_trees(xdf, lab, p, local_cells=cells), p.kind == "forest")
            got = {(r.sid, r.t): r.yhat for r in model_table.predict_models(m, xdf, lab).collect()}
            assert got == {**{("c", t): 3.0 for t in range(5)}, ("one", 2): 7.0}


@pytest.mark.parametrize("family", ["RandomForest", "GradientBoosting", "XGBoost"])
def test_staged_grid_equals_single_fits(spark, data, family):
    """Errors read off one growth equal those of a model grown for the point alone."""
    from tessera.operators.models import DEFAULTS, grid_points
    _, _, xdf, lab = data
    lab = lab.filter("sid = 'a'")
    grid = {"RandomForest": {"n_estimators": [2, 4], "max_depth": [None, 2], "min_samples_split": [2, 9]},
            "GradientBoosting": {"n_estimators": [2, 4], "max_depth": [2], "subsample": [0.7]},
            "XGBoost": {"n_estimators": [2, 4], "max_depth": [2], "colsample_bytree": [0.5]}}[family]
    points, folds = grid_points(grid), [(1, 0, 40, 60), (2, 0, 60, 80)]
    staged = {(r.point, r.fold): r.mse for r in trees.grid_errors(xdf, lab, family, DEFAULTS[family], points, folds).collect()}
    assert len(staged) == 2 * len(points)
    edges = trees.cut_points(xdf.filter("t < 80"), 1024)
    x = np.array([r.features for r in xdf.orderBy("t").collect()])
    y = np.array([r.label for r in lab.orderBy("t").collect()])
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.uint16)
    for i, q in enumerate(points):
        p = trees.family_params(family, {**DEFAULTS[family], **q})
        for fold, _, lo, hi in folds:
            t = np.arange(lo)
            inner = np.ascontiguousarray(bins[:, :lo])
            grown = [g for _, g in (trees.boost(inner, y[:lo], t, p) if p.kind == "boost" else
                                    trees.forest(inner, y[:lo], t, p, range(p.trees)))]
            out = np.sum([np.array(g.value)[trees.walk(g, bins[:, lo:hi])] for g in grown], 0)
            want = np.mean((y[lo:hi] - (out / len(grown) if p.kind == "forest" else out)) ** 2)
            assert abs(staged[i, fold] - want) < 1e-9
    best = trees.best_points(trees.grid_errors(xdf, lab, family, DEFAULTS[family], points, folds)).head()
    mean = [np.mean([staged[i, f] for f in (1, 2)]) for i in range(len(points))]
    assert best.point == int(np.argmin(mean)) and abs(best.cv_mse - min(mean)) < 1e-12


def test_grid_of_a_large_series(spark, data):
    from tessera.operators.models import DEFAULTS
    _, _, xdf, lab = data
    points, folds = [{"n_estimators": 1, "max_depth": 1}, {"n_estimators": 2, "max_depth": 1}], [(1, 0, 40, 60)]
    errors = [{(r.sid, r.point, r.fold): r.mse for r in trees.grid_errors(
        xdf, lab, "GradientBoosting", DEFAULTS["GradientBoosting"], points, folds, local_cells=c).collect()} for c in (1 << 20, 0)]
    assert set(errors[0]) == set(errors[1]) and len(errors[0]) == 4
    assert near((errors[0][k], errors[1][k]) for k in errors[0]) < 1e-9


@pytest.mark.parametrize("kind", list(PARAMS))
def test_nodes_cut_by_counts_equal_sorted_ones(monkeypatch, kind):
    """Large nodes from sums by bin, small ones in value order: the same trees
    wherever the border lies, with ties, repeated values and rows of weight 0."""
    rng = np.random.default_rng(3)
    n, p = 400, PARAMS[kind]
    bins = np.stack([rng.integers(0, k, n) for k in (2, 7, 40, 300, 1000)] + [np.zeros(n, int)]).astype(np.uint16)
    y, t = rng.normal(size=n) + bins[2] / 20, np.arange(n)

    def structure(border):
        monkeypatch.setattr(trees, "SORTED_ROWS", border)
        some = trees.forest(bins, y, t, p, range(p.trees)) if p.kind == "forest" else trees.boost(bins, y, t, p)
        return [(k, g.feature, g.cut, g.left, g.right, g.n, np.round(g.value, 9).tolist()) for k, g in some]

    want = structure(n)
    for border in (0, 5, 60):
        assert structure(border) == want


def test_large_nodes_need_no_sorted_rows(monkeypatch):
    """Boosting a long series to a small depth sorts none of its rows."""
    rng = np.random.default_rng(4)
    bins, y, t = rng.integers(0, 50, (3, 20_000)).astype(np.uint16), rng.normal(size=20_000), np.arange(20_000)
    y += bins[0] + 30 * (bins[1] > 25)
    assert trees.value_order(bins) is None
    monkeypatch.setattr(trees, "_sorted_cuts", None)
    p = trees.TreeParams("boost", trees=3, depth=2)
    assert [max(g.depths()) for _, g in trees.boost(bins, y, t, p)] == [0, 2, 2, 2]


def test_families_are_fitted_side_by_side(data, monkeypatch):
    """Boosted families have a task a series and would leave cores idle one after another."""
    import threading
    _, _, xdf, lab = data
    meet, fit = threading.Barrier(3, timeout=60), trees.fit_trees

    def together(X, labels, p, *rest, **more):
        meet.wait()
        return fit(X, labels, trees.replace(p, trees=2, depth=2), *rest, **more)

    monkeypatch.setattr(trees, "fit_trees", together)
    order = ["RandomForest", "Ridge", "GradientBoosting", "XGBoost"]
    m = model_table.fit_models(xdf, lab, order, V2, F.col("split") == "train")
    assert sorted((r.family, r.sid) for r in m.collect()) == sorted((f, s) for f in order for s in "ab")
