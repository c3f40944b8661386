"""End-to-end pipeline (v2 behaviour) on the smallest tables, linear
families only to keep the test short; tree families are covered by the
registered model queries."""
import os

from conftest import SF_SMALL


def test_pipeline_v2_linear(spark, tmp_path):
    from tessera.config import V2
    from tessera.plans.pipeline import run_pipeline
    cfg = V2.with_(families=("LinearRegression", "Ridge", "Lasso"), importance_source="first")
    res = run_pipeline(spark, SF_SMALL, cfg, str(tmp_path))
    assert res["k"] == 64
    assert res["n_features"] == 64 + 5 * 31 + 6
    fams = {r["family"] for r in res["comparison"].collect()}
    assert {"LinearRegression", "Ridge", "Lasso", "Optimized"} <= fams
    s = res["summary"]
    assert s["rmse"] >= 0 and 0 <= s["accuracy"] <= 1
    assert abs(s["rmse"] ** 2 - s["mse"]) < 1e-9
    # selection ran on a RandomForest of the first series (best family is linear, v2 rule)
    assert res["selected_features"].count() >= cfg.min_features
    assert os.path.isdir(os.path.join(tmp_path, "reports", "model_summary"))
    assert os.path.isdir(os.path.join(tmp_path, "best_model", "tables", "scaler"))
    assert res["r2_test"].count() == len(fams) * 5


def test_saved_models_predict_again(spark, tmp_path, monkeypatch):
    """Trees, a refit and both ensembles: saved, loaded, equal predictions."""
    from pyspark.sql import functions as F

    from tessera.config import V1, V2
    from tessera.operators import models
    from tessera.plans.pipeline import load_and_predict, run_pipeline

    monkeypatch.setitem(models.DEFAULTS, "RandomForest", {"n_estimators": 4, "max_depth": 4, "min_samples_split": 2,
                                                          "min_samples_leaf": 1})
    small = {"RandomForest": {"n_estimators": [3], "max_depth": [3]}, "Ridge": {"alpha": [0.1, 1.0]}}
    seen = set()
    for cfg in (V1.with_(families=("Ridge", "RandomForest"), forecast_horizon=2),
                V2.with_(families=("RandomForest",), tune_strategy="sampled"), V2.with_(families=("Ridge", "Lasso"))):
        out = str(tmp_path / f"m{len(seen)}{cfg.ensemble}{len(cfg.families)}")
        res = run_pipeline(spark, SF_SMALL, cfg, out, grids=small)
        seen.add(res["chosen"])
        d = res["design"]
        again = load_and_predict(spark, res["model_path"], d.X, d.labels, F.col("split") == "test")
        a = res["test_predictions"].select("sid", "t", F.col("yhat").alias("p"))
        b = again.filter(F.col("family") == res["chosen"]).select("sid", "t", "yhat")
        j = a.join(b, ["sid", "t"], "full").agg(F.count("*").alias("n"), F.count("p").alias("p"), F.count("yhat").alias("q"),
                                                F.max(F.abs(F.col("p") - F.col("yhat"))).alias("d")).head()
        assert j.n == j.p == j.q and j.d < 1e-9


def test_horizon_labels_are_later_values(spark):
    from pyspark.sql import functions as F

    from tessera.config import V1
    from tessera.plans.design import build_design

    one = build_design(spark, SF_SMALL, V1, use_svd=False)
    three = build_design(spark, SF_SMALL, V1.with_(forecast_horizon=3), use_svd=False)
    a = one.labels.select("sid", (F.col("t") - 3).alias("t"), F.col("label").alias("later"))
    j = three.labels.filter("split != 'drop'").join(a, ["sid", "t"], "left")
    assert j.filter("later is null or abs(later - label) > 1e-12").count() == 0
    assert three.labels.filter("split = 'test'").agg(F.max("t")).head()[0] == one.labels.agg(F.max("t")).head()[0] - 3
