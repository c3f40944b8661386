"""The three entry points of the reference as Spark jobs.

* ``run_profile``  load + analyse only (statistics, correlations, groups)
* ``run_pipeline`` the full flow, v1 or v2 behaviour chosen by ``PanelConfig``
  (``V1`` / ``V2``): design matrix -> baselines -> selection -> tuning ->
  refit -> ensemble -> evaluation -> save.

Every stage is a lazy DataFrame plan or a job for all series; the driver only
holds report rows, coefficient vectors and parameter maps, O(series x families).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PanelConfig
from ..operators import (cluster, correlation, ensemble, evaluate, linear, model_table, models, profile, reshape,
                         select, split, trees, tune)
from ..session import stored
from ..sources import panels, sinks
from .design import build_design

TREES = ("RandomForest", "GradientBoosting", "XGBoost")


def run_profile(spark: SparkSession, base: str, cfg: PanelConfig, out: str,
                panel: DataFrame | None = None) -> dict:
    """Stage 1-2: statistics (written), roll-up, correlations, correlogram,
    rolling full-window stats, and groups (correlation groups in v1,
    K-means clusters in v2)."""
    panel = panel if panel is not None else panels.hourly(spark, base)
    stats = profile.series_stats(panel)
    res = {"stats_path": sinks.write_table(stats, spark, "output_statistics",
                                           os.path.join(out, "data_analysis", "output_statistics"), fmt="csv"),
           "rollup": profile.stats_rollup(stats).first().asDict(),
           "corr": correlation.corr_matrix(panel)}
    if cfg.tune_strategy == "first_k":
        groups = correlation.corr_groups(panel, cfg.corr_threshold, min_degree=cfg.corr_min_degree)
        groups = groups.withColumnRenamed("component", "group_id")
    else:
        feats = profile.cluster_features(panel)
        k = cluster.n_clusters(feats.count(), cfg.n_station_clusters)
        groups, _ = cluster.kmeans_groups(feats, k, cfg.seed, cfg.kmeans_restarts)
    res["groups"] = groups
    res["groups_path"] = sinks.write_table(cluster.group_members(groups), spark, "station_groups",
                                           os.path.join(out, "station_groups"))
    return res


def _fit_predict(d, families, cfg, params=None, X=None, name=None):
    """Baselines (or a refit): the model table of all series, and its long
    predictions (family, sid, t, y, yhat, split)."""
    X = X if X is not None else d.X
    table = stored(model_table.fit_models(X, d.labels, families, cfg, F.col("split") == "train", params, name), "models")
    return model_table.predict_models(table, X, d.labels, F.col("split").isin("val", "test")).cache(), table


def run_pipeline(spark: SparkSession, base: str, cfg: PanelConfig, out: str,
                 grids: dict | None = None) -> dict:
    """The full flow; returns the final summary and report tables."""
    res = {"profile": run_profile(spark, base, cfg, out)}
    d = build_design(spark, base, cfg)
    res["n_features"], res["k"] = d.n_features, d.k
    families = list(cfg.families)
    # stage 6: baselines
    preds, fitted = _fit_predict(d, families, cfg)
    val_r2 = evaluate.series_r2(preds.filter(F.col("split") == "val")).cache()
    avg = evaluate.macro_r2(val_r2)
    best = evaluate.best_model(avg, families).first()
    best_family = best["best_family"]
    res["baseline_avg_r2"] = {r["family"]: r["avg_r2"] for r in avg.collect()}
    res["best_distribution"] = evaluate.best_model_distribution(val_r2, families)
    res["difficult"] = evaluate.difficult_series(val_r2)
    # stage 7: selection on the reference series' tree importances
    ref = d.sids[0]
    sel_family = best_family if best_family in TREES else ("RandomForest" if cfg.tune_strategy != "first_k"
                                                           else None)
    selected = None
    if sel_family is not None:
        # compat (T8): the first series' model decides for all; "mean" averages every series
        source = fitted.filter(F.col("family") == sel_family)
        if sel_family not in families:
            source = stored(model_table.fit_models(d.X, d.labels, [sel_family], cfg, F.col("split") == "train"), "selector")
        every = model_table.importances(source)
        owners = every.filter(F.col("sid") == ref) if cfg.importance_source == "first" else every
        # features that no tree uses count as 0
        n_owners = owners.select(F.countDistinct("sid")).scalar()
        imp = d.dictionary.select("idx").join(owners.groupBy("idx").agg(F.sum("importance").alias("total")), "idx", "left").select(
            "idx", F.coalesce(F.col("total") / n_owners, F.lit(0.0)).alias("importance"))
        imp = stored(imp, "importances")
        sel = select.select_by_importance(imp, cfg.importance_threshold, cfg.min_features)
        selected = sorted(r["idx"] for r in sel.select("idx").collect())
        res["selected_features"] = sel.join(d.dictionary, "idx")
        res["group_importance"] = select.group_importance(imp, d.dictionary)
    Xs = d.X if selected is None else select.slice_features(d.X, selected).select(
        "t", F.col("selected").alias("features")).cache()
    # stage 8: tuning of the best family
    grid = (grids or (models.GRIDS_V1 if cfg.tune_strategy == "first_k" else models.GRIDS_V2)).get(best_family)
    params = {}
    if grid:
        fb = split.fold_bounds(d.labels.select("sid", "t").distinct(), cfg)
        folds = [(r["fold"], r["train_lo"], r["test_lo"], r["test_hi"]) for r in fb.collect()]
        if cfg.tune_strategy == "first_k":
            targets = d.sids[:cfg.tune_first_k]
        elif cfg.tune_strategy == "groups":
            g = res["profile"]["groups"]
            reps = cluster.group_representative(g)
            targets = [r["representative"] for r in reps.collect()]
        else:
            sampled = reshape.sample_series(d.labels, cfg.tune_sample, cfg.seed).select("sid").distinct()
            targets = sorted(r["sid"] for r in sampled.collect())
        tuned = {}
        if best_family in model_table.LINEAR:
            cv = linear.linear_grid_cv(Xs, d.labels, targets, folds, best_family, grid["alpha"])
            tuned = {r["sid"]: {"alpha": r["alpha"]} for r in tune.best_params(cv).collect()}
        else:
            points = models.grid_points(grid)
            errors = trees.grid_errors(Xs, d.labels.filter(F.col("sid").isin(list(targets))), best_family,
                                       models.DEFAULTS[best_family], points, folds, cfg.seed)
            tuned = {r["sid"]: points[r["point"]] for r in trees.best_points(errors).collect()}   # a row per tuned series
        if cfg.tune_strategy == "first_k":  # A13: one consensus setting for every series
            first = tuned[min(tuned)]
            params = {s: first for s in d.sids}
        elif cfg.tune_strategy == "groups":
            g = res["profile"]["groups"]
            rep_of = {r["sid"]: r["representative"] for r in g.join(
                cluster.group_representative(g), "group_id").collect()}
            params = {s: tuned[rep_of[s]] for s in d.sids if rep_of.get(s) in tuned}
        else:
            near = correlation.nearest_series(correlation.corr_matrix(d.labels.withColumnRenamed("label", "v")),
                                              spark.createDataFrame([(s,) for s in targets], "sid string"))
            params = dict(tuned)
            params.update({r["sid"]: tuned[r["nearest"]] for r in near.collect() if r["nearest"] in tuned})
        res["params"] = params
    # stage 9: refit ("Optimized")
    opt, opt_fitted = _fit_predict(d, [best_family], cfg, params, Xs, name="Optimized")
    preds = preds.unionByName(opt)
    all_families = families + ["Optimized"]
    val_all = evaluate.series_r2(preds.filter(F.col("split") == "val"))
    avg_all = evaluate.macro_r2(val_all).cache()
    # the refit replaces the baseline if it validates better
    best = evaluate.best_model(avg_all.filter(F.col("family").isin(best_family, "Optimized")),
                               [best_family, "Optimized"]).first()
    # stage 10: ensemble
    test = preds.filter(F.col("split") == "test")
    members, side = [], {}  # families the ensemble is made of, and its tables
    if cfg.ensemble == "weighted":
        cands = reshape.positive_models(avg_all, all_families, 3)
        if cands.count():
            w = ensemble.ensemble_weights(val_all, cands)
            members, side = [r["family"] for r in cands.collect()], {"weights": w}
            test = test.unionByName(ensemble.weighted_predictions(test, w).withColumn("split", F.lit("test")))
    else:
        cands = reshape.positive_models(avg_all, all_families, 3, ("Optimized",), 2)
        bases = [r["family"] for r in cands.collect()]
        if len(bases) >= 2:
            fit = ensemble.stack_fit(preds.filter((F.col("split") == "val") & F.col("family").isin(bases)),
                                     bases, models.STACK_ALPHA)
            members, side = bases, {"meta": fit}
            stacked = ensemble.stack_predict(test.filter(F.col("family").isin(bases)), fit, bases)
            test = test.unionByName(stacked.withColumn("split", F.lit("test")))
    test = test.cache()
    # stage 11: evaluation; compat choice compares the ensemble's test R^2 with
    # the best validation R^2
    comp = evaluate.model_comparison(test)
    res["comparison"] = comp
    chosen = best["best_family"]
    ens = comp.filter(F.col("family") == "Ensemble").select("avg_r2").collect()
    if ens and ens[0][0] > best["best_avg_r2"]:
        chosen = "Ensemble"
    chosen_df = spark.createDataFrame([(chosen, 0.0)], "best_family string, best_avg_r2 double")
    res["summary"] = evaluate.final_summary(test, chosen_df, d.stats).first().asDict()
    res["r2_test"] = evaluate.series_r2(test)
    # stage 12: save
    reports = {"model_summary": comp, "series_r2": res["r2_test"]}
    if "selected_features" in res:
        reports["selected_features"] = res["selected_features"].orderBy(F.desc("importance"))
    sinks.write_reports(spark, os.path.join(out, "reports"), reports)
    needed = set(members if chosen == "Ensemble" else [chosen])
    tables = {"scaler": d.stats, "dictionary": d.dictionary, "groups": res["profile"]["groups"],
              "models": fitted.unionByName(opt_fitted).filter(F.col("family").isin(*needed))}
    if chosen == "Ensemble":
        tables.update(side)
    if selected is not None:
        tables["selected"] = spark.createDataFrame([(i,) for i in selected], "idx int")
    res["model_path"] = sinks.save_model(spark, os.path.join(out, "best_model"), tables, {
        "chosen": chosen, "members": members if chosen == "Ensemble" else [], "tables": sorted(tables), "config": repr(cfg)})
    res["chosen"], res["test_predictions"], res["design"] = chosen, test.filter(F.col("family") == chosen), d
    return res


def load_and_predict(spark: SparkSession, root: str, X: DataFrame, labels: DataFrame, rows=None) -> DataFrame:
    """Predictions (family, sid, t, y, yhat) of a saved model on a design
    matrix: the models of the families it needs, the refit on the selected
    features, then the ensemble's weights or meta-model."""
    cfg = sinks.load_config(spark, root)
    table = lambda n: spark.read.parquet(os.path.join(root, "tables", n))
    have = set(cfg["tables"])
    Xs = X
    if "selected" in have:
        idx = sorted(r["idx"] for r in table("selected").collect())
        Xs = select.slice_features(X, idx).select("t", F.col("selected").alias("features"))
    lab = labels if rows is None else labels.filter(rows)
    m, is_opt = table("models"), F.col("family") == "Optimized"
    preds = model_table.predict_models(m.filter(~is_opt), X, lab).unionByName(model_table.predict_models(m.filter(is_opt), Xs, lab))
    preds = preds.select("family", "sid", "t", "y", "yhat")
    if "weights" in have:
        return ensemble.weighted_predictions(preds, table("weights"))
    if "meta" in have:
        return ensemble.stack_predict(preds, table("meta"), cfg["members"])
    return preds
