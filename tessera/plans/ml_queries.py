"""Model-fitting queries (registered without an oracle; property-tested).

They read the same tables as the SQL-checked queries and run the reference's
model stages on the hourly design matrix: baselines per family and series,
importance-based selection, tuning over expanding folds, refits, stacking,
reduction and clustering.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..config import V1, V2
from ..operators import (cluster, correlation, ensemble, evaluate, linear, model_table, models, profile, reshape,
                         select, split, trees, tune)
from ..session import scratch_path, stored
from ..sources import sinks, tables
from . import common as C
from . import oracle as O
from . import queries as Q
from .design import build_design
from .queries import register

CFG = V2
def _is(split_name):
    return F.col("split") == split_name


def _design(spark, base):
    """The shared design matrix, built (SVD included) once per run."""
    return C.shared(("design", base), lambda: build_design(spark, base, CFG))


def _model_query(family):
    def fn(spark, base):
        d = _design(spark, base)
        m = model_table.fit_models(d.X, d.labels, [family], CFG, _is("train"))
        return models.r2_table(model_table.predict_models(m, d.X, d.labels, _is("val")))
    fn.__doc__ = f"{family} for every series on the train rows; validation R^2."
    return fn


for _q, _fam in [("fit_ols", "LinearRegression"), ("fit_ridge", "Ridge"), ("fit_lasso", "Lasso"),
                 ("fit_random_forest", "RandomForest"), ("fit_gbt", "GradientBoosting"), ("fit_gbt_hist", "XGBoost")]:
    register(_q)(_model_query(_fam))


def _models(spark, base):
    """The models of all six families, written once per run."""
    def build():
        d = _design(spark, base)
        return stored(model_table.fit_models(d.X, d.labels, CFG.families, CFG, _is("train")), "models")
    return C.shared(("models", base), build)


@register("svd_reduce")
def q_svd(spark, base):
    """SVD scores of the standardized inputs, exploded (t, j, score)."""
    d = _design(spark, base)
    return d.scores.select("t", F.posexplode("x").alias("j", "score"))


@register("svd_norms", O.sql(
    "SELECT t, sum(z * z) AS norm2 FROM (SELECT t, j, CASE WHEN stddev_pop(x) OVER w = 0 THEN 0.0 "
    "ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM (SELECT i.t, unnest(range(len(i.x))) AS j, "
    "unnest(i.x) AS x FROM inputs i WHERE i.t IN (SELECT t FROM hourly)) WINDOW w AS (PARTITION BY j)) GROUP BY t",
    ["t", "norm2"], ["norm2"]))
def q_svd_norms(spark, base):
    """R1 without its sign ambiguity: at full rank a row's scores have the
    squared length of the standardized row."""
    d = _design(spark, base)
    return d.scores.select("t", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("norm2"))


@register("svd_orthogonal", O.sql(
    "SELECT a.j AS i, b.j AS j, 0.0 AS cosine FROM (SELECT unnest(range(k)) AS j FROM kk) a "
    "JOIN (SELECT unnest(range(k)) AS j FROM kk) b ON a.j < b.j", ["i", "j", "cosine"], ["cosine"],
    ["kk AS (SELECT least((SELECT count(*) FROM inputs i WHERE i.t IN (SELECT t FROM hourly)) - 1, max(len(x)), "
     f"{CFG.n_components}) AS k FROM inputs)"]))
def q_svd_orthogonal(spark, base):
    """Score columns are at right angles; with ``svd_norms`` that fixes the axes up to sign."""
    s = _design(spark, base).scores.select("t", F.posexplode("x").alias("j", "v"))
    other = s.select("t", F.col("j").alias("k"), F.col("v").alias("w"))
    size = s.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dot = s.join(other, "t").filter("j < k").groupBy("j", "k").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    both = dot.join(size, "j").join(size.select(F.col("j").alias("k"), F.col("size").alias("size_k")), "k")
    return both.select(F.col("j").alias("i"), F.col("k").alias("j"), F.try_divide("dot", F.col("size") * F.col("size_k")).alias("cosine"))


@register("explained_variance", O.sql(
    "SELECT CASE WHEN least((SELECT count(*) FROM inputs i WHERE i.t IN (SELECT t FROM hourly)), max(len(x)), "
    f"{CFG.n_components}) = max(len(x)) THEN 1.0 END AS explained_variance, "
    f"least((SELECT count(*) FROM inputs i WHERE i.t IN (SELECT t FROM hourly)), max(len(x)), {CFG.n_components}) "
    "AS n_components FROM inputs", ["explained_variance", "n_components"], ["explained_variance"]))
def q_explained_variance(spark, base):
    """A8."""
    from ..operators import reduce
    d = _design(spark, base)
    return reduce.explained_variance(d.scores, d.inputs)


LINEAR = {"LinearRegression": 0.0, "Ridge": 1.0, "Lasso": 0.1}  # reference default alphas
ONE_FEATURE = [
    "x1 AS (SELECT t, lag1 AS x FROM fs WHERE sid = (SELECT min(sid) FROM scaled))",
    "m1 AS (SELECT sid, regr_sxy(v, x) AS sxy, regr_sxx(v, x) AS sxx, avg(v) AS my, avg(x) AS mx, count(*) AS n "
    "FROM fs JOIN x1 USING (t) WHERE split = 'train' GROUP BY sid)",
    "s1 AS (SELECT 'LinearRegression' AS family, sid, sxy / sxx AS slope, my, mx FROM m1 "
    "UNION ALL SELECT 'Ridge', sid, sxy / (sxx + 1.0), my, mx FROM m1 "
    "UNION ALL SELECT 'Lasso', sid, sign(sxy) * greatest(abs(sxy) - 0.1 * n, 0.0) / sxx, my, mx FROM m1)"]


@register("linear_one_feature", O.sql("SELECT family, sid, my - slope * mx AS intercept, slope FROM s1",
                                      ["family", "sid", "intercept", "slope"], ["intercept", "slope"], ONE_FEATURE))
def q_linear_one_feature(spark, base):
    """M1-M3 on one feature (the first series' lag 1), every series: the Gram
    pass and the three solvers against their closed forms."""
    z, _ = C.scaled(C.hourly(spark, base))
    fs = C.feat_split(z, CFG)
    ref = C.reference_sid(z)
    X = fs.filter(F.col("sid") == ref).select("t", array_to_vector(F.array("lag1")).alias("features"))
    labels = fs.select("sid", "t", F.col("v").alias("label"), "split")
    st = linear.gram_stats(X, labels, correlation.series_order(z), _is("train"))
    coefs = linear.fit_linear(spark, st, [(f, f, a) for f, a in LINEAR.items()])
    return coefs.select("family", "sid", "intercept", F.col("coef")[0].alias("slope"))


TWO = [
    "x2 AS (SELECT t, lag1 AS a, rollmean7 AS b FROM fs WHERE sid = (SELECT min(sid) FROM scaled))",
    "m2 AS (SELECT sid, regr_sxx(v, a) AS saa, regr_sxx(v, b) AS sbb, covar_pop(a, b) * count(*) AS sab, "
    "regr_sxy(v, a) AS say, regr_sxy(v, b) AS sby, avg(a) AS ma, avg(b) AS mb, avg(v) AS my, count(*) AS n "
    "FROM fs JOIN x2 USING (t) WHERE split = 'train' GROUP BY sid)",
    # coordinate descent: each round updates both coefficients
    "cd(sid, k, ba, bb) AS (SELECT sid, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM m2 UNION ALL "
    "SELECT c.sid, c.k + 1, na, sign(sby - sab * na) * greatest(abs(sby - sab * na) - 0.1 * n, 0.0) / sbb "
    "FROM (SELECT c.*, m.*EXCLUDE (sid), sign(say - sab * bb) * greatest(abs(say - sab * bb) - 0.1 * n, 0.0) / saa AS na "
    "FROM cd c JOIN m2 m ON m.sid = c.sid WHERE c.k < 400) c)",
    "s2 AS (SELECT 'LinearRegression' AS family, sid, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, "
    "(sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM m2 UNION ALL "
    "SELECT 'Ridge', sid, (say * (sbb + 1) - sby * sab) / ((saa + 1) * (sbb + 1) - sab * sab), "
    "(sby * (saa + 1) - say * sab) / ((saa + 1) * (sbb + 1) - sab * sab) FROM m2 UNION ALL "
    "SELECT 'Lasso', sid, ba, bb FROM cd WHERE k = 400)"]


@register("linear_two_features", O.sql(
    "SELECT s2.family, s2.sid, my - ba * ma - bb * mb AS intercept, ba AS slope_a, bb AS slope_b FROM s2 JOIN m2 USING (sid)",
    ["family", "sid", "intercept", "slope_a", "slope_b"], ["intercept", "slope_a", "slope_b"], TWO))
def q_linear_two_features(spark, base):
    """M1-M3 on two features (the first series' lag 1 and mean of 7), every
    series, as ``fit_*`` solve them: from the rows, without a Gram matrix."""
    z, _ = C.scaled(C.hourly(spark, base))
    fs = C.feat_split(z, CFG)
    X = fs.filter(F.col("sid") == C.reference_sid(z)).select("t", F.array("lag1", "rollmean7").alias("features"))
    labels = fs.select("sid", "t", F.col("v").alias("label"), "split")
    coefs = linear.fit_series(X, labels, [(f, f, a) for f, a in LINEAR.items()], _is("train"))
    return coefs.select("family", "sid", "intercept", F.col("coef")[0].alias("slope_a"), F.col("coef")[1].alias("slope_b"))


@register("predict_linear_models", O.sql(
    "SELECT s2.family, s2.sid, f.t, f.v AS y, my + ba * (a - ma) + bb * (b - mb) AS yhat, f.split FROM s2 JOIN m2 USING (sid) "
    "JOIN fs f ON f.sid = s2.sid JOIN x2 ON x2.t = f.t WHERE f.split IN ('val', 'test')",
    ["family", "sid", "t", "y", "yhat", "split"], ["y", "yhat"], TWO))
def q_predict_linear_models(spark, base):
    """M7 / M8 of the linear families on two features: one model table, written
    and read again, and its predictions on validation and test rows."""
    z, _ = C.scaled(C.hourly(spark, base))
    fs = C.feat_split(z, CFG)
    X = fs.filter(F.col("sid") == C.reference_sid(z)).select("t", array_to_vector(F.array("lag1", "rollmean7")).alias("features"))
    labels = fs.select("sid", "t", F.col("v").alias("label"), "split")
    m = stored(model_table.fit_models(X, labels, list(LINEAR), CFG, _is("train")), "models")
    return model_table.predict_models(m, X, labels, F.col("split").isin("val", "test"))


@register("slice_selected", O.sql(
    "SELECT a.t, s.place, a.value FROM asm a JOIN (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS place FROM "
    f"({{sel}})) s USING (idx)".format(sel=Q.ORACLE["select_by_importance"]), ["t", "place", "value"], ["value"], Q.IMP_CTES))
def q_slice_selected(spark, base):
    """P8 on stand-in importances: the assembled features that X2 selects, in their order."""
    a, _ = Q._assembled(spark, base)
    sel = select.select_by_importance(Q._importance(spark, base), CFG.importance_threshold, CFG.min_features)
    idx = sorted(r["idx"] for r in sel.select("idx").collect())     # as many as features are selected
    out = select.slice_features(a, idx)
    from pyspark.ml.functions import vector_to_array
    return out.select("t", F.posexplode(vector_to_array("selected")).alias("place", "value"))


@register("kmeans_sizes", O.sql(
    "SELECT greatest(3, least(5, count(DISTINCT sid) // 3)) AS n_groups, count(DISTINCT sid) AS n_series FROM monthly",
    ["n_groups", "n_series"], []))
def q_kmeans_sizes(spark, base):
    """Number of groups and of series in them."""
    return q_kmeans(spark, base).agg(F.countDistinct("group_id").alias("n_groups"), F.count(F.lit(1)).alias("n_series"))


@register("csv_panel", O.sql("SELECT sid, t, v FROM monthly", ["sid", "t", "v"], ["v"]))
def q_csv_panel(spark, base):
    """S1 + S2: the monthly panel as a wide CSV in the shared folder, read
    back, numbered and melted."""
    m = C.monthly(spark, base)
    sids = correlation.series_order(m)
    path = sinks.write_table(reshape.pivot_panel(m, sids), spark, "wide_csv", fmt="csv")
    return tables.wide_to_long(tables.read_wide_csv(spark, path), sids, "t")


@register("csv_array_panel", O.sql("SELECT sid, t, v FROM monthly", ["sid", "t", "v"], ["v"]))
def q_csv_array_panel(spark, base):
    """S1 + S2 + P1 as for thousands of columns: the same file read as one array column."""
    m = C.monthly(spark, base)
    path = sinks.write_table(reshape.pivot_panel(m, correlation.series_order(m)), spark, "wide_csv", fmt="csv")
    wide, names = tables.read_wide_array(spark, path)
    return tables.wide_array_to_long(wide, names, "t")


@register("kmeans_groups")
def q_kmeans(spark, base):
    """K-means on the monthly series features, k = max(3, min(5, n // 3)), 10 restarts."""
    m = C.monthly(spark, base)
    feats = profile.cluster_features(m)
    n = feats.count()
    groups, _ = cluster.kmeans_groups(feats, cluster.n_clusters(n, CFG.n_station_clusters), CFG.seed,
                                      CFG.kmeans_restarts)
    return groups


# features without window sums: equal steps have equal values to the last bit, in either engine
STUMP_FEATURES = ("lag2", "lag5", "diff3")
# a series' best cut: running sums over each feature in value order, cuts half way between neighbouring values
STUMP = [
    "tr AS (SELECT f.sid, f.t, f.v AS y, x.lag2, x.lag5, x.diff3 FROM fs f JOIN fs x ON x.t = f.t "
    "AND x.sid = (SELECT min(sid) FROM scaled) WHERE f.split = 'train')",
    "mn AS (SELECT sid, avg(y) AS mean FROM tr GROUP BY sid)",
    "lg AS (SELECT sid, t, 0 AS idx, lag2 AS x, y FROM tr UNION ALL SELECT sid, t, 1, lag5, y FROM tr "
    "UNION ALL SELECT sid, t, 2, diff3, y FROM tr)"]


def _stump_sql(rate, weights):
    """``weights``: CTEs that end in wt (sid, t, w)."""
    return O.sql(
        "SELECT sid, idx, threshold, mean + rate * gl / wl AS left_value, mean + rate * gr / wr AS right_value, gain FROM best",
        ["sid", "idx", "threshold", "left_value", "right_value", "gain"], ["threshold", "left_value", "right_value", "gain"],
        [*STUMP, *weights,
         "vv AS (SELECT sid, idx, x, sum(w * (y - mean)) AS g, sum(w) AS w, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS c "
         "FROM lg JOIN wt USING (sid, t) JOIN mn USING (sid) GROUP BY sid, idx, x)",
         "cu AS (SELECT sid, idx, x, lead(x) OVER p AS nx, sum(g) OVER p AS gl, sum(w) OVER p AS wl, sum(c) OVER p AS cl, "
         "sum(g) OVER q AS g, sum(w) OVER q AS w, sum(c) OVER q AS c FROM vv "
         "WINDOW p AS (PARTITION BY sid, idx ORDER BY x), q AS (PARTITION BY sid, idx))",
         "sc AS (SELECT sid, idx, (x + nx) / 2 AS threshold, gl, wl, g - gl AS gr, w - wl AS wr, "
         "gl * gl / wl + (g - gl) * (g - gl) / (w - wl) - g * g / w AS gain FROM cu WHERE nx IS NOT NULL AND cl > 0 AND c > cl)",
         f"best AS (SELECT sc.*, mean, {rate} AS rate FROM sc JOIN mn USING (sid) "
         "QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(gain, 8) DESC, idx, threshold) = 1)"])


def _hashed_weights(seed, tree):
    """The forest's row weights in SQL: a 64-bit finaliser, then the inverse of Poisson(1)."""
    start = ((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
    mod, step = "18446744073709551616::UHUGEINT", "SELECT sid, t, (xor(x, x >> {}) * {}::UHUGEINT) % {} AS x FROM {}"
    return [f"x0 AS (SELECT sid, t, (t::UHUGEINT + {start}::UHUGEINT) % {mod} AS x FROM tr)",
            f"x1 AS ({step.format(30, 0xBF58476D1CE4E5B9, mod, 'x0')})", f"x2 AS ({step.format(27, 0x94D049BB133111EB, mod, 'x1')})",
            "uu AS (SELECT sid, t, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992 AS u FROM x2)",
            "wt AS (SELECT sid, t, " + " + ".join(f"(u > {float(c)!r}::DOUBLE)::INT" for c in trees.POISSON) + " AS w FROM uu)"]


def _stump(spark, base, p):
    z, _ = C.scaled(C.hourly(spark, base))
    fs = C.feat_split(z, CFG)
    ref = C.reference_sid(z)
    X = fs.filter(F.col("sid") == ref).select("t", F.array(*STUMP_FEATURES).alias("features"))
    labels = fs.select("sid", "t", F.col("v").alias("label"), "split")
    grown = trees.fit_trees(X, labels, p, _is("train")).filter(F.size("feature") == 3)
    mean = labels.filter(_is("train")).groupBy("sid").agg(F.avg("label").alias("mean"))
    lift = F.col("mean") if p.kind == "boost" else F.lit(0.0)
    return grown.join(mean, "sid").select(
        "sid", F.col("feature")[0].alias("idx"), F.col("threshold")[0].alias("threshold"),
        *[(lift + F.col("value")[F.col(side)[0]]).alias(f"{side}_value") for side in ("left", "right")], F.col("gain")[0].alias("gain"))


@register("boosted_stump", _stump_sql(0.5, ["wt AS (SELECT sid, t, 1.0 AS w FROM tr)"]))
def q_boosted_stump(spark, base):
    """M5 / M6: one round of depth 1 at rate 0.5 for every series."""
    return _stump(spark, base, trees.TreeParams("boost", trees=1, depth=1, rate=0.5))


@register("forest_stump", _stump_sql(1.0, _hashed_weights(CFG.seed, 0)))
def q_forest_stump(spark, base):
    """M4: a forest of one tree of depth 1, on its Poisson row weights, for every series."""
    return _stump(spark, base, trees.TreeParams("forest", trees=1, depth=1, seed=CFG.seed))


@register("train_all_series")
def q_train_all(spark, base):
    """M7: every family for every series, in one model table; validation R^2."""
    d = _design(spark, base)
    return models.r2_table(model_table.predict_models(_models(spark, base), d.X, d.labels, _is("val")))


@register("predict_series")
def q_predict(spark, base):
    """M8: predictions of all six families on validation and test rows."""
    d = _design(spark, base)
    return model_table.predict_models(_models(spark, base), d.X, d.labels, F.col("split").isin("val", "test"))


def _importances(spark, base):
    """Importances of every series' random forest, unused features as 0."""
    d = _design(spark, base)

    def build():
        m = model_table.fit_models(d.X, d.labels, ["RandomForest"], CFG, _is("train"))
        return stored(model_table.importances(m), "importances")

    used = C.shared(("rf_importance", base), build)
    every = d.dictionary.select("idx").withColumn("sid", F.explode(F.array(*[F.lit(s) for s in d.sids])))
    return d, every.join(used.drop("family"), ["sid", "idx"], "left").select("sid", "idx", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def _first(d, imp):
    """The reference selects on its first series."""
    return imp.filter(F.col("sid") == d.sids[0]).drop("sid")


@register("feature_importance")
def q_feature_importance(spark, base):
    """Random forest importances of every series with names and groups."""
    d, imp = _importances(spark, base)
    return imp.join(d.dictionary, "idx")


def _selected(spark, base, cfg):
    """The design matrix on the features that X2 selects."""
    d, imp = _importances(spark, base)
    sel = select.select_by_importance(_first(d, imp), cfg.importance_threshold, cfg.min_features)
    idx = sorted(r["idx"] for r in sel.select("idx").collect())
    Xs = select.slice_features(d.X, idx).select("t", F.col("selected").alias("features"))
    return d, Xs, idx


@register("slice_features")
def q_slice(spark, base):
    """Design matrix restricted to the features selected by X2 (0.80 / 20)."""
    from pyspark.ml.functions import vector_to_array
    _, Xs, idx = _selected(spark, base, CFG)
    return Xs.select("t", F.lit(len(idx)).cast("bigint").alias("n_selected"), vector_to_array("features").alias("selected"))


TUNED = "GradientBoosting"      # the winning family of both programs
TUNED_PARAMS = sorted(models.GRIDS_V2[TUNED])


def _tune(d, Xs, sids, grids):
    """The reference's grid of the winning family over expanding folds of
    the train rows; ``sid``, a column per parameter, ``cv_mse``."""
    fb = split.fold_bounds(d.labels.select("sid", "t").distinct(), CFG)
    folds = [(r["fold"], r["train_lo"], r["test_lo"], r["test_hi"]) for r in fb.collect()]
    points = models.grid_points(grids[TUNED])
    errors = trees.grid_errors(Xs, d.labels.filter(F.col("sid").isin(list(sids))), TUNED, models.DEFAULTS[TUNED], points, folds, CFG.seed)
    grid = Xs.sparkSession.createDataFrame([(i, *[float(q[k]) for k in TUNED_PARAMS]) for i, q in enumerate(points)],
                                           ["point", *TUNED_PARAMS])
    best = stored(trees.best_points(errors), "tuned")
    return best.join(F.broadcast(grid), "point").select("sid", *TUNED_PARAMS, "cv_mse")     # a row per grid point


def _as_params(rows):
    """{sid: parameters} of tuned rows."""
    whole = ("max_depth", "n_estimators")
    return {r["sid"]: {k: int(r[k]) if k in whole else r[k] for k in TUNED_PARAMS} for r in rows}


@register("tune_first_k")
def q_tune_first_k(spark, base):
    """G3 (v1): the v1 grid of the winning family for the first 3 series, on the selected features."""
    d, Xs, _ = _selected(spark, base, V1)
    return _tune(d, Xs, d.sids[:V1.tune_first_k], models.GRIDS_V1)


def _groups_hourly(spark, base):
    h = C.hourly(spark, base)
    feats = profile.cluster_features(h)
    n = feats.count()
    g, _ = cluster.kmeans_groups(feats, cluster.n_clusters(n, CFG.n_station_clusters), CFG.seed,
                                 CFG.kmeans_restarts)
    return g


def _tuned_groups(spark, base):
    """G4 (v2): the representatives' parameters and every series' group."""
    def build():
        d, Xs, _ = _selected(spark, base, CFG)
        g = _groups_hourly(spark, base)
        reps = stored(cluster.group_representative(g), "representatives")
        params = _tune(d, Xs, [r["representative"] for r in reps.collect()], models.GRIDS_V2)
        members = g.join(reps.select("group_id", "representative"), "group_id")
        return stored(tune.broadcast_group_params(members, params), "group_params")
    return C.shared(("tuned_groups", base), build)


@register("tune_per_group")
def q_tune_per_group(spark, base):
    """G4 (v2): the v2 grid for each K-means group's representative, given to the group."""
    return _tuned_groups(spark, base)


@register("tune_sampled")
def q_tune_sampled(spark, base):
    """G5 (v2 without clusters): tune 5 seeded-random series; the others take
    the parameters of their most correlated sampled series (J5)."""
    d, Xs, _ = _selected(spark, base, CFG)
    h = C.hourly(spark, base)
    sampled = reshape.sample_series(h, CFG.tune_sample, CFG.seed).select("sid").distinct()
    ids = sorted(r["sid"] for r in sampled.collect())
    params = _tune(d, Xs, ids, models.GRIDS_V2)
    near = correlation.nearest_series(correlation.corr_matrix(h), sampled)
    others = near.join(params.withColumnRenamed("sid", "nearest"), "nearest").select("sid", *TUNED_PARAMS, "cv_mse")
    return params.unionByName(others)


def _optimized(spark, base):
    """The winning family refitted with each series' tuned parameters on the selected features."""
    d, Xs, _ = _selected(spark, base, CFG)
    own = _as_params(_tuned_groups(spark, base).collect())      # a row per series
    return d, Xs, model_table.fit_models(Xs, d.labels, [TUNED], CFG, _is("train"), own, "Optimized")


@register("train_tuned")
def q_train_tuned(spark, base):
    """Validation R^2 of the tuned refit."""
    d, Xs, m = _optimized(spark, base)
    return models.r2_table(model_table.predict_models(m, Xs, d.labels, _is("val")))


@register("stacking_ensemble")
def q_stacking(spark, base):
    """Per-series ridge (alpha 0.1) on the validation predictions of up to
    three trained families with positive mean R^2, applied to the test rows."""
    d = _design(spark, base)
    preds = stored(model_table.predict_models(_models(spark, base), d.X, d.labels, F.col("split").isin("val", "test")), "predictions")
    avg = evaluate.macro_r2(evaluate.series_r2(preds.filter(_is("val"))))
    cands = [r["family"] for r in reshape.positive_models(avg, list(CFG.families), 3, ("Optimized",), 2).collect()]
    if len(cands) < 2:
        return preds.limit(0).select("sid", "t", "y", "yhat")
    some = preds.filter(F.col("family").isin(cands))
    fit = ensemble.stack_fit(some.filter(_is("val")), cands, models.STACK_ALPHA)
    return ensemble.stack_predict(some.filter(_is("test")), fit, cands).select("sid", "t", "y", "yhat")


@register("write_reports", Q.ORACLE["select_by_importance"])
def q_write_reports(spark, base):
    """Selected features, model summary and difficult series written as
    Parquet and read back (selected features shown)."""
    s, _ = C.scored(spark, base)
    r2 = evaluate.series_r2(s.filter(_is("val")))
    imp = Q._importance(spark, base)
    sel = select.select_by_importance(imp, CFG.importance_threshold, CFG.min_features)
    root = sinks.write_reports(spark, scratch_path(spark, "reports"), {
        "selected_features": sel.orderBy(F.desc("importance")),
        "model_summary": evaluate.model_comparison(s.filter(F.col("split") == "test")),
        "difficult_series": evaluate.difficult_series(r2)})
    return spark.read.parquet(root["selected_features"])


_REPORTS = (
    "SELECT 'selected_features' AS report, idx::VARCHAR AS key, importance AS value FROM ({sel}) UNION ALL "
    "SELECT 'model_summary', family, avg_r2 FROM avgr2 WHERE split = 'test' UNION ALL "
    "SELECT 'difficult_series', sid, max(r2) FROM r2 WHERE split = 'val' AND family = 'persist' GROUP BY sid HAVING max(r2) < 0")


@register("write_reports_all", O.sql(_REPORTS.format(sel=Q.ORACLE["select_by_importance"]), ["report", "key", "value"], ["value"]))
def q_write_reports_all(spark, base):
    """All three report tables written and read back, as (report, key, value)."""
    s, _ = C.scored(spark, base)
    sel = select.select_by_importance(Q._importance(spark, base), CFG.importance_threshold, CFG.min_features)
    root = sinks.write_reports(spark, scratch_path(spark, "reports"), {
        "selected_features": sel.orderBy(F.desc("importance")),
        "model_summary": evaluate.model_comparison(s.filter(F.col("split") == "test")),
        "difficult_series": evaluate.difficult_series(evaluate.series_r2(s.filter(_is("val") & (F.col("family") == "persist"))))})
    back = {k: spark.read.parquet(p) for k, p in root.items()}
    column = {"selected_features": ("idx", "importance"), "model_summary": ("family", "avg_r2"), "difficult_series": ("sid", "best_r2")}
    return reshape.union_all([back[k].select(F.lit(k).alias("report"), F.col(a).cast("string").alias("key"), F.col(b).alias("value"))
                              for k, (a, b) in column.items()])


@register("save_model", O.sql("SELECT family, sid, 0.0 AS max_abs_diff FROM (SELECT DISTINCT sid FROM hourly), "
                              "(SELECT unnest(['LinearRegression', 'Ridge', 'Lasso', 'RandomForest', 'GradientBoosting', 'XGBoost']) AS family)",
                              ["family", "sid", "max_abs_diff"], ["max_abs_diff"]))
def q_save_model(spark, base):
    """The model table of all six families, scaler, feature dictionary and
    configuration saved; the loaded models' predictions compared with those of
    the models in memory (max |diff| per family and series)."""
    d = _design(spark, base)
    m = _models(spark, base)
    root = sinks.save_model(spark, scratch_path(spark, "saved_model"), {"models": m, "scaler": d.stats, "dictionary": d.dictionary},
                            {"n_lags": CFG.n_lags, "families": list(CFG.families)})
    loaded = spark.read.parquet(f"{root}/tables/models")
    rows = F.col("split").isin("val", "test")
    a, b = (model_table.predict_models(x, d.X, d.labels, rows).select("family", "sid", "t", F.col("yhat").alias(n))
            for x, n in ((m, "p1"), (loaded, "p2")))
    return a.join(b, ["family", "sid", "t"], "full").groupBy("family", "sid").agg(
        F.max(F.coalesce(F.abs(F.col("p1") - F.col("p2")), F.lit(1e300))).alias("max_abs_diff"))
