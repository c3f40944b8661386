"""Goldens from the reference run logs on literal frames."""
import pytest
from pyspark.sql import functions as F

from tessera.config import V1, V2
from tessera.operators import cluster, reshape, select, split, tune
from tessera.plans import common as C


def _steps(spark, n):
    return spark.createDataFrame([("s", t, 0.0) for t in range(n)], "sid string, t bigint, v double")


@pytest.mark.parametrize("cfg,expected", [(V1, (289, 62, 63)), (V2, (287, 62, 62))])
def test_split_419(spark, cfg, expected):
    out = split.chronological_split(_steps(spark, 419), cfg)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert (counts["train"], counts["val"], counts["test"]) == expected
    assert counts["drop"] == cfg.n_lags


def test_feature_counts(spark):
    sids = [str(i) for i in range(40)]
    assert C.feature_dictionary(spark, sids, V1, n_svd=300).count() == 820
    d2 = C.feature_dictionary(spark, sids, V2, n_svd=300)
    assert d2.count() == 1546
    groups = {r["grp"] for r in d2.select("grp").distinct().collect()}
    assert groups == {"SVD", "Lagged", "Rolling Mean", "Rolling Std", "Rolling Min/Max", "Diff", "EWM",
                      "Fourier", "Interaction"}


def test_cluster_count():
    assert cluster.n_clusters(40, 5) == 5
    assert cluster.n_clusters(25, 5) == 5
    assert cluster.n_clusters(5, 5) == 3


# fixed values: top importances printed by the two runs
IMP_V1 = [0.939956, 0.031529, 0.011924, 0.005925, 0.003025]
IMP_V2 = [0.911190, 0.034993, 0.018256, 0.015766, 0.007622, 0.004535, 0.003285, 0.000690, 0.000630,
          0.000569, 0.000145, 0.000143, 0.000116, 0.000101, 0.000098, 0.000056, 0.000053, 0.000051,
          0.000050, 0.000046]


@pytest.mark.parametrize("imp,thr,floor,expected", [(IMP_V1, 0.90, 5, 5), (IMP_V2, 0.80, 20, 20),
                                                    (IMP_V1, 0.999, 1, 1), ([0.2, 0.2], 0.99, 1, 1)])
def test_selection(spark, imp, thr, floor, expected):
    df = spark.createDataFrame(list(enumerate(imp)), "idx int, importance double")
    sel = select.select_by_importance(df, thr, floor)
    assert sel.count() == expected
    assert sel.select(F.max("n_selected")).first()[0] == expected


# fixed values: station groups of the v2 run (1-based)
GROUPS_40 = [[1, 15, 21, 37], [2, 3, 6, 7, 8, 9, 10, 11, 18, 20, 25, 26, 27, 29, 34], [16, 31, 33],
             [4, 12, 14, 19, 22, 24, 28, 30, 35, 38, 39, 40], [5, 13, 17, 23, 32, 36]]


def _groups(spark):
    rows = [(f"{s:02d}", g) for g, members in enumerate(GROUPS_40) for s in members]
    return spark.createDataFrame(rows, "sid string, group_id bigint")


def test_group_sizes_and_representatives(spark):
    g = _groups(spark)
    reps = {r["group_id"]: (r["representative"], r["n_members"])
            for r in cluster.group_representative(g).collect()}
    assert [reps[i][1] for i in range(5)] == [4, 15, 3, 12, 6]
    assert [int(reps[i][0]) for i in range(5)] == [1, 2, 16, 4, 5]


def test_param_mode_v2(spark):
    # fixed values: best parameters per group of the v2 run
    maps = [{"learning_rate": 0.05, "max_depth": 3, "n_estimators": 300, "subsample": 0.8}] + \
        [{"learning_rate": 0.01, "max_depth": 3, "n_estimators": 100, "subsample": 0.7}] * 4
    rows = [(f"{s:02d}", k, float(v)) for g, members in enumerate(GROUPS_40) for s in members
            for k, v in maps[g].items()]
    params = spark.createDataFrame(rows, "sid string, param string, value double")
    mode = {r["param"]: (r["value"], r["n_series"]) for r in tune.param_mode(params).collect()}
    assert mode == {"n_estimators": (100.0, 36), "learning_rate": (0.01, 36), "max_depth": (3.0, 40),
                    "subsample": (0.7, 36)}


def test_param_consensus_v1(spark):
    # fixed values: best parameters of the first three stations in the v1 run
    maps = [{"learning_rate": 0.1, "max_depth": 3, "n_estimators": 200, "subsample": 0.8},
            {"learning_rate": 0.01, "max_depth": 3, "n_estimators": 100, "subsample": 0.8},
            {"learning_rate": 0.01, "max_depth": 7, "n_estimators": 100, "subsample": 0.8}]
    rows = [(f"{i:02d}", k, float(v)) for i, m in enumerate(maps) for k, v in m.items()]
    params = spark.createDataFrame(rows, "sid string, param string, value double")
    out = {r["param"]: r["value"] for r in tune.param_consensus(params).collect()}
    assert out == {"n_estimators": 200.0, "learning_rate": 0.1, "max_depth": 3.0, "subsample": 0.8}


@pytest.mark.parametrize("r2,exclude,expected", [
    # fixed values: mean validation R^2 per family of the two runs
    ({"LinearRegression": -4.1684, "Ridge": -4.1599, "Lasso": 0.8754, "RandomForest": 0.8844,
      "GradientBoosting": 0.9194, "Optimized": -0.6710}, (), ["GradientBoosting", "RandomForest", "Lasso"]),
    ({"LinearRegression": -1.1760, "Ridge": -1.1747, "Lasso": 0.9252, "RandomForest": 0.9626,
      "GradientBoosting": 0.9664, "XGBoost": 0.9597, "Optimized": -0.1112}, ("Optimized",),
     ["GradientBoosting", "RandomForest", "XGBoost"]),
])
def test_ensemble_candidates(spark, r2, exclude, expected):
    df = spark.createDataFrame(list(r2.items()), "family string, avg_r2 double")
    got = [r["family"] for r in reshape.positive_models(df, list(r2), 3, exclude).orderBy(
        F.desc("avg_r2")).collect()]
    assert got == expected


def test_accuracy_and_improvement(spark):
    from tessera.functions.scalar import pct_improvement
    from tessera.operators.evaluate import accuracy
    df = spark.createDataFrame([(0.0798, 0.9716, 0.947)], "mae double, new double, old double")
    r = df.select(accuracy().alias("a"), pct_improvement("new", "old").alias("p")).first()
    assert abs(r["a"] - 0.9202) < 1e-12
    assert abs(r["p"] - 2.5977) < 1e-3
