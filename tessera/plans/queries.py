"""Registered queries: one per operator of the coverage checklist.

Each entry pairs a Spark callable ``(spark, base) -> DataFrame`` with an
optional DuckDB oracle (``plans.oracle``). Queries without an oracle are the
model-fitting and randomised operators; they are covered by property tests.
Every query reads the given tables (or panels Spark derives from them) in
full, so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import V2
from ..functions.scalar import fourier_terms
from ..functions.stats import round6
from ..operators import (cluster, correlation, ensemble, evaluate, profile, reshape, select,
                         split, tune, windows)
from ..sources import panels, tables
from . import common as C
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_INTS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def fin(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals and widen integers to BIGINT."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f"`{f.name}`")).alias(f.name))
        elif isinstance(f.dataType, _INTS):
            cols.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, base: fin(fn(spark, base))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


CFG = V2
FEATS = windows.feature_names(CFG)
SVAL = "split = 'val'"
STEST = "split = 'test'"


def _r2(spark, base, which):
    return C.split_r2(spark, base, which)


# =================================================================== sources
@register("scan_panel", O.sql("SELECT sid, t, v FROM hourly", ["sid", "t", "v"], ["v"]))
def q_scan_panel(spark, base):
    """Long hourly panel read from the events table."""
    return C.hourly(spark, base)


@register("row_index", O.sql(
    "SELECT row_number() OVER (ORDER BY h) - 1 AS t, n FROM "
    "(SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1)", ["t", "n"], []))
def q_row_index(spark, base):
    """Dense 0-based index of the distinct event hours."""
    ev = tables.read_table(spark, base, "events")
    hours = ev.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return tables.row_index(hours, "h").select("t", "n")


@register("shape_profile", O.sql(
    "SELECT (SELECT count(*) FROM hourly) AS n_rows, (SELECT count(DISTINCT sid) FROM hourly) AS n_series, "
    "(SELECT count(DISTINCT t) FROM hourly) AS n_steps, (SELECT count(*) FROM inputs) AS input_rows, "
    "(SELECT max(len(x)) FROM inputs)::BIGINT AS input_width",
    ["n_rows", "n_series", "n_steps", "input_rows", "input_width"], []))
def q_shape_profile(spark, base):
    """S3."""
    return tables.shape_profile(C.hourly(spark, base), panels.inputs(spark, base))


A1_SQL = ("SELECT sid, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, "
          "max(v) - min(v) AS range, count(*) FILTER (WHERE v = 0) AS zeros, "
          "count(*) FILTER (WHERE v IS NULL) AS missing FROM nullable GROUP BY sid")
A1_COLS = ["sid", "mean", "std", "min", "max", "range", "zeros", "missing"]


@register("write_stats", O.sql(A1_SQL, A1_COLS, ["mean", "std", "min", "max", "range"]))
def q_write_stats(spark, base):
    """A1 written as Parquet to the shared folder and read back."""
    from ..sources import sinks
    path = sinks.write_table(profile.series_stats(panels.nullable(spark, base)), spark, "series_stats")
    return spark.read.parquet(path).select(*A1_COLS)


@register("write_groups", O.sql(
    "SELECT component AS group_id, string_agg(sid, ',' ORDER BY sid) AS members, count(*) AS n_members "
    "FROM groups GROUP BY component", ["group_id", "members", "n_members"], [],
    [O.monthly_corr_edges(C.GROUP_THRESHOLD)]))
def q_write_groups(spark, base):
    """Correlation groups of the monthly panel as member lists, written and read back."""
    from ..sources import sinks
    g = correlation.corr_groups(C.monthly(spark, base), C.GROUP_THRESHOLD).withColumnRenamed(
        "component", "group_id")
    path = sinks.write_table(cluster.group_members(g), spark, "series_groups")
    return spark.read.parquet(path)


# =================================================================== reshape
@register("melt_panel", O.sql("SELECT sid, t, v FROM monthly", ["sid", "t", "v"], ["v"]))
def q_melt_panel(spark, base):
    """Monthly panel pivoted wide and melted back to long."""
    m = C.monthly(spark, base)
    sids = correlation.series_order(m)
    return reshape.melt_panel(reshape.pivot_panel(m, sids), "t", sids)


@register("pivot_panel", O.sql(
    "SELECT t, " + ", ".join(f"max(v) FILTER (WHERE sid = '{s}') AS {s}"
                             for s in ("click", "error", "purchase", "signup", "view"))
    + " FROM hourly GROUP BY t", ["t", "click", "error", "purchase", "signup", "view"],
    ["click", "error", "purchase", "signup", "view"]))
def q_pivot_panel(spark, base):
    """Hourly panel, one column per series (explicit value list)."""
    h = C.hourly(spark, base)
    return reshape.pivot_panel(h, correlation.series_order(h))


@register("standardize", O.sql("SELECT sid, t, v AS z FROM scaled", ["sid", "t", "z"], ["z"]))
def q_standardize(spark, base):
    """P3."""
    h = C.hourly(spark, base)
    return reshape.standardize(h).select("sid", "t", "z")


@register("standardize_wide", O.sql(
    "SELECT t, j, CASE WHEN sd = 0 THEN 0.0 ELSE (xj - mu) / sd END AS z FROM "
    "(SELECT t, j, xj, avg(xj) OVER (PARTITION BY j) AS mu, stddev_pop(xj) OVER (PARTITION BY j) AS sd FROM "
    "(SELECT t, generate_subscripts(x, 1) - 1 AS j, unnest(x) AS xj FROM inputs))",
    ["t", "j", "z"], ["z"]))
def q_standardize_wide(spark, base):
    """Column-wise z-score of the embedding matrix, exploded for comparison."""
    z = reshape.standardize_wide(panels.inputs(spark, base))
    return z.select("t", F.posexplode("x").alias("j", "z")).select("t", F.col("j").cast("bigint"), "z")


@register("inverse_standardize", O.sql("SELECT sid, t, v FROM hourly", ["sid", "t", "v"], ["v"]))
def q_inverse_standardize(spark, base):
    """P5: z back to the original scale."""
    h = C.hourly(spark, base)
    st = reshape.scaler_stats(h)
    z = reshape.standardize(h, st).select("sid", "t", "z")
    return reshape.inverse_standardize(z, st, ["z"]).select("sid", "t", F.col("z").alias("v"))


def _assembled(spark, base, with_fourier=True):
    z, _ = C.scaled(C.hourly(spark, base))
    f = C.features(z, CFG)
    extra = []
    if with_fourier:
        extra.append(windows.fourier_frame(z.select("t").distinct(), CFG))
    return select.assemble_features(f, FEATS, extra), z


def _assembled_sql():
    per = []
    for pos, name in enumerate(FEATS):
        per.append(f"SELECT t, {pos} * s.ns + s.so AS idx, {name} AS value FROM feat "
                   f"JOIN sord s USING (sid)")
    nf = len(FEATS)
    four = []
    for k, p in enumerate(CFG.fourier_periods):
        w = f"2 * pi() / ({CFG.steps_per_period_unit} * {p})"
        four.append(f"SELECT t, {nf} * (SELECT max(ns) FROM sord) + {2 * k} AS idx, sin(t * {w}) AS value "
                    f"FROM (SELECT DISTINCT t FROM feat)")
        four.append(f"SELECT t, {nf} * (SELECT max(ns) FROM sord) + {2 * k + 1} AS idx, cos(t * {w}) AS value "
                    f"FROM (SELECT DISTINCT t FROM feat)")
    return " UNION ALL ".join(per + four)


SORD = ("sord AS (SELECT sid, (dense_rank() OVER (ORDER BY sid) - 1)::BIGINT AS so, "
        "count(*) OVER ()::BIGINT AS ns FROM (SELECT DISTINCT sid FROM scaled))")


@register("assemble_features", O.sql(_assembled_sql(), ["t", "idx", "value"], ["value"], [SORD]))
def q_assemble_features(spark, base):
    """Per-t feature vector (every series' features + Fourier), exploded."""
    a, _ = _assembled(spark, base)
    return a.select("t", F.posexplode("features").alias("idx", "value")).select(
        "t", F.col("idx").cast("bigint"), "value")


@register("fill_zero", O.sql("SELECT sid, t, coalesce(v, 0.0) AS v FROM nullable", ["sid", "t", "v"], ["v"]))
def q_fill_zero(spark, base):
    """The nullable panel with gaps filled by 0."""
    return reshape.fill_zero(panels.nullable(spark, base), ["v"])


@register("trim_warmup", O.sql(f"SELECT sid, t, v, lag{CFG.n_lags} FROM feat WHERE t >= {CFG.n_lags}",
                               ["sid", "t", "v", f"lag{CFG.n_lags}"], ["v", f"lag{CFG.n_lags}"]))
def q_trim_warmup(spark, base):
    """P10: drop the first n_lags steps of the feature frame."""
    z, _ = C.scaled(C.hourly(spark, base))
    f = C.features(z, CFG)
    return reshape.trim_warmup(f, CFG.n_lags).select("sid", "t", "v", f"lag{CFG.n_lags}")


TRIM_H = 3


@register("trim_horizon", O.sql(f"SELECT sid, t, v FROM hourly WHERE t < (SELECT max(t) + 1 FROM hourly) - {TRIM_H}",
                                ["sid", "t", "v"], ["v"]))
def q_trim_horizon(spark, base):
    """P11 with horizon 3."""
    return reshape.trim_horizon(C.hourly(spark, base), TRIM_H)


@register("sample_first_series", O.sql(
    "SELECT sid, t, v FROM hourly WHERE sid IN (SELECT DISTINCT sid FROM hourly ORDER BY sid LIMIT 3)",
    ["sid", "t", "v"], ["v"]))
def q_sample_first_series(spark, base):
    """The first 3 series (the exploration sample of the reference)."""
    return reshape.first_series(C.hourly(spark, base), 3)


@register("positive_models", O.sql("SELECT family, avg_r2 FROM cand", ["family", "avg_r2"], ["avg_r2"]))
def q_positive_models(spark, base):
    """P13 (+O3): top-3 families by validation R^2 that have R^2 > 0."""
    return C.candidates(spark, base).select("family", "avg_r2")


# =================================================================== joins
@register("align_inputs", O.sql(
    "SELECT s.sid, s.t, s.v, list_sum(list_transform(i.x, lambda e: e * e)) AS x_sq "
    "FROM scaled s JOIN inputs i USING (t)", ["sid", "t", "v", "x_sq"], ["v", "x_sq"]))
def q_align_inputs(spark, base):
    """Scaled panel aligned with the input rows on t."""
    z, _ = C.scaled(C.hourly(spark, base))
    j = reshape.align_inputs(z, panels.inputs(spark, base))
    return j.select("sid", "t", "v", F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e).alias("x_sq"))


@register("actual_vs_pred", O.sql(f"SELECT family, sid, t, y, yhat FROM scored WHERE {STEST}",
                                  ["family", "sid", "t", "y", "yhat"], ["y", "yhat"]))
def q_actual_vs_pred(spark, base):
    """Actual vs predicted on the test split."""
    z, _ = C.scaled(C.hourly(spark, base))
    fs = C.feat_split(z, CFG)
    labels = fs.select("sid", "t", F.col("v").alias("y"), "split")
    preds = ensemble.forecaster_predictions(fs).select("family", "sid", "t", "yhat")
    return reshape.actual_vs_pred(labels, preds).filter(F.col("split") == "test").select(
        "family", "sid", "t", "y", "yhat")


@register("series_pairs", O.sql(
    "SELECT a.sid AS sid_a, b.sid AS sid_b, count(*) AS n_common, covar_samp(a.v, b.v) AS cov "
    "FROM hourly a JOIN hourly b ON a.t = b.t AND a.sid < b.sid GROUP BY ALL",
    ["sid_a", "sid_b", "n_common", "cov"], ["cov"]))
def q_series_pairs(spark, base):
    """Pair co-moments at equal t (Gram pass, no pair rows)."""
    return correlation.series_pairs(C.hourly(spark, base))


def _monthly_groups(spark, base):
    m = C.monthly(spark, base)
    g = correlation.corr_groups(m, C.GROUP_THRESHOLD)
    return m, g


def _monthly_params(m):
    fs = split.chronological_split(C.features(m, CFG), CFG, split.split_bounds(m, CFG))
    train = fs.filter(F.col("split") == "train")
    return tune.best_params(tune.ridge1_grid_cv(train, CFG, C.RIDGE_ALPHAS, bounds_from=m))


def _ridge1_sql(src: str, name: str) -> list[str]:
    """Single-feature ridge grid CV (G2 closed form) over the train rows of ``src``."""
    k = CFG.cv_folds
    alphas = ", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(C.RIDGE_ALPHAS))
    return [
        f"{name}_b AS (SELECT {CFG.n_lags} AS start, "
        f"floor((n - {CFG.n_lags})::DOUBLE * {repr(1 - CFG.test_size - CFG.val_size)}::DOUBLE)::BIGINT AS ntr "
        f"FROM (SELECT max(t) + 1 AS n FROM {src}))",
        f"{name}_f AS (SELECT f AS fold, start AS lo, start + ntr - ({k} - f + 1) * (ntr // {k + 1}) AS test_lo, "
        f"start + ntr - ({k} - f) * (ntr // {k + 1}) AS test_hi FROM {name}_b, range(1, {k + 1}) r(f))",
        f"{name}_x AS (SELECT sid, t, v AS y, coalesce(lag(v, 1) OVER ({O.W}), 0.0::DOUBLE) AS x FROM {src})",
        f"{name}_r AS (SELECT x.sid, x.t, x.x, x.y, f.fold, x.t < f.test_lo AS is_train FROM {name}_x x "
        f"JOIN {name}_f f ON x.t >= f.lo AND x.t < f.test_hi)",
        f"{name}_tr AS (SELECT sid, fold, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) AS sxx, "
        f"sum(x * y) AS sxy FROM {name}_r WHERE is_train GROUP BY ALL)",
        f"{name}_c AS (SELECT sid, fold, a.apos, a.alpha, (sxy - n * mx * my) / (sxx - n * mx * mx + a.alpha) AS b, "
        f"mx, my FROM {name}_tr, (VALUES {alphas}) a(apos, alpha))",
        f"{name}_cv AS (SELECT sid, apos, alpha, avg(mse) AS cv_mse FROM (SELECT r.sid, r.fold, c.apos, c.alpha, "
        f"avg(power(r.y - ((c.my - c.b * c.mx) + c.b * r.x), 2)) AS mse FROM {name}_r r JOIN {name}_c c "
        f"ON r.sid = c.sid AND r.fold = c.fold WHERE NOT r.is_train GROUP BY ALL) GROUP BY ALL)",
        f"{name} AS (SELECT sid, arg_min(alpha, struct_pack(m := cv_mse, p := apos)) AS alpha, min(cv_mse) AS cv_mse "
        f"FROM {name}_cv GROUP BY sid)",
    ]


GROUPS_CTE = O.monthly_corr_edges(C.GROUP_THRESHOLD)
MPARAMS = _ridge1_sql("monthly", "mparams")
HPARAMS = _ridge1_sql("scaled", "hparams")


@register("broadcast_group_params", O.sql(
    "SELECT g.sid, g.component AS group_id, r.rep AS representative, p.alpha FROM groups g "
    "JOIN (SELECT component, min(sid) AS rep FROM groups GROUP BY component) r USING (component) "
    "JOIN mparams p ON p.sid = r.rep", ["sid", "group_id", "representative", "alpha"], ["alpha"],
    [GROUPS_CTE] + MPARAMS))
def q_broadcast_group_params(spark, base):
    """Each monthly series gets its correlation group's tuned ridge alpha
    (tuned on the group representative)."""
    m, g = _monthly_groups(spark, base)
    g = g.withColumnRenamed("component", "group_id")
    reps = cluster.group_representative(g).select("group_id", "representative")
    members = g.join(reps, "group_id")
    return tune.broadcast_group_params(members, _monthly_params(m).select("sid", "alpha")).select(
        "sid", "group_id", "representative", "alpha")


@register("nearest_series", O.sql(
    "SELECT u.sid, arg_min(p.sid2, struct_pack(nr := -coalesce(p.r, '-inf'::DOUBLE), s := p.sid2)) AS nearest, "
    "arg_min(p.r, struct_pack(nr := -coalesce(p.r, '-inf'::DOUBLE), s := p.sid2)) AS r FROM "
    "(SELECT DISTINCT sid FROM monthly WHERE sid NOT IN (SELECT sid FROM samp)) u JOIN "
    "(SELECT sid_a AS sid1, sid_b AS sid2, r FROM mpairs UNION ALL SELECT sid_b, sid_a, r FROM mpairs) p "
    "ON p.sid1 = u.sid AND p.sid2 IN (SELECT sid FROM samp) GROUP BY u.sid",
    ["sid", "nearest", "r"], ["r"],
    [GROUPS_CTE, "samp AS (SELECT DISTINCT sid FROM monthly ORDER BY sid LIMIT 5)"]))
def q_nearest_series(spark, base):
    """Unsampled monthly series take the most correlated of the first 5."""
    m = C.monthly(spark, base)
    corr = correlation.corr_matrix(m)
    sampled = m.select("sid").distinct().orderBy("sid").limit(5)
    return correlation.nearest_series(corr, sampled)


# =================================================================== aggregates
@register("series_stats", O.sql(A1_SQL, A1_COLS, ["mean", "std", "min", "max", "range"]))
def q_series_stats(spark, base):
    """A1 on the nullable hourly panel."""
    return profile.series_stats(panels.nullable(spark, base))


@register("stats_rollup", O.sql(
    "SELECT min(min) AS min_min, max(max) AS max_max, avg(mean) AS avg_mean, avg(std) AS avg_std FROM "
    "(SELECT min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std FROM nullable GROUP BY sid)",
    ["min_min", "max_max", "avg_mean", "avg_std"], ["min_min", "max_max", "avg_mean", "avg_std"]))
def q_stats_rollup(spark, base):
    """A2."""
    return profile.stats_rollup(profile.series_stats(panels.nullable(spark, base)))


@register("corr_matrix", O.sql(
    f"SELECT a.sid AS sid_a, b.sid AS sid_b, {O.corr_expr('a.v', 'b.v')} AS r "
    "FROM hourly a JOIN hourly b ON a.t = b.t AND a.sid < b.sid GROUP BY ALL",
    ["sid_a", "sid_b", "r"], ["r"]))
def q_corr_matrix(spark, base):
    """A3."""
    return correlation.corr_matrix(C.hourly(spark, base))


@register("series_shape", O.sql(
    "SELECT sid, CASE WHEN count(v) >= 3 THEN skewness(v) END AS skew, "
    "CASE WHEN count(v) >= 4 THEN kurtosis(v) END AS kurt FROM hourly GROUP BY sid",
    ["sid", "skew", "kurt"], ["skew", "kurt"]))
def q_series_shape(spark, base):
    """A4."""
    return profile.series_shape(C.hourly(spark, base))


AC_LAGS = (1, 7, 14)


@register("autocorr_lags", O.sql(
    "SELECT sid, " + ", ".join(f"{O.corr_expr('v', f'l{k}')} AS ac{k}" for k in AC_LAGS)
    + " FROM (SELECT sid, v, " + ", ".join(f"lag(v, {k}) OVER ({O.W}) AS l{k}" for k in AC_LAGS)
    + " FROM hourly) GROUP BY sid", ["sid", "ac1", "ac7", "ac14"], ["ac1", "ac7", "ac14"]))
def q_autocorr_lags(spark, base):
    """A5."""
    return profile.autocorr_lags(C.hourly(spark, base), AC_LAGS)


@register("correlogram", O.sql(
    "SELECT a.sid, b.t - a.t AS lag, sum((a.v - s.mu) * (b.v - s.mu)) / s.n / s.c0 AS acf, "
    "2.5758293035489004 / sqrt(s.n) AS band99, 1.959963984540054 / sqrt(s.n) AS band95 "
    "FROM hourly a JOIN hourly b ON a.sid = b.sid AND b.t > a.t "
    "JOIN (SELECT sid, avg(v) AS mu, count(v) AS n, var_pop(v) AS c0 FROM hourly GROUP BY sid) s ON s.sid = a.sid "
    "GROUP BY a.sid, b.t - a.t, s.n, s.c0", ["sid", "lag", "acf", "band99", "band95"],
    ["acf", "band99", "band95"]))
def q_correlogram(spark, base):
    """Autocorrelation at every lag 1..n-1 of every series."""
    return profile.correlogram(C.hourly(spark, base))


@register("corr_groups", O.sql("SELECT sid, component FROM groups", ["sid", "component"], [], [GROUPS_CTE]))
def q_corr_groups(spark, base):
    """Monthly series linked at |r| > 0.3, connected components."""
    return _monthly_groups(spark, base)[1]


@register("model_avg_r2", O.sql(f"SELECT family, avg_r2 FROM avgr2 WHERE {SVAL}", ["family", "avg_r2"], ["avg_r2"]))
def q_model_avg_r2(spark, base):
    """Mean validation R^2 per forecaster family."""
    return evaluate.macro_r2(_r2(spark, base, "val"))


@register("best_model_distribution", O.sql(
    "SELECT f.family, count(w.sid) AS n_series, count(w.sid) * 100.0 / (SELECT count(DISTINCT sid) FROM r2) AS pct "
    "FROM fam f LEFT JOIN (SELECT sid, arg_max(family, struct_pack(r := r2, o := -ord)) AS family FROM r2 "
    f"JOIN fam USING (family) WHERE {SVAL} GROUP BY sid) w USING (family) GROUP BY f.family",
    ["family", "n_series", "pct"], ["pct"]))
def q_best_model_distribution(spark, base):
    """A10 on validation R^2."""
    return evaluate.best_model_distribution(_r2(spark, base, "val"), C.FAMILIES)


def _importance(spark, base):
    """Stand-in importances of the reference series on the train rows
    (materialised once per run)."""
    from ..session import materialize

    def build():
        a, z = _assembled(spark, base)
        fs = C.feat_split(z, CFG)
        ref = C.reference_sid(z)
        lab = fs.filter((F.col("sid") == ref) & (F.col("split") == "train")).select("t", F.col("v").alias("y"))
        return materialize(select.stand_in_importance(a, lab))

    return C.shared(("importance", base), build)


IMP_CTES = [SORD,
            "asm AS (" + _assembled_sql() + ")",
            "lab AS (SELECT t, v AS y FROM fs WHERE split = 'train' AND sid = (SELECT min(sid) FROM scaled))",
            f"impr AS (SELECT idx::BIGINT AS idx, coalesce(power({O.corr_expr('a.value', 'l.y')}, 2), 0.0) AS r2 "
            "FROM asm a JOIN lab l USING (t) GROUP BY idx)",
            "imp AS (SELECT idx, CASE WHEN sum(r2) OVER () > 0 THEN r2 / sum(r2) OVER () ELSE 0.0 END AS importance "
            "FROM impr)",
            "rk AS (SELECT idx, importance, row_number() OVER (ORDER BY importance DESC, idx) AS rank, "
            "sum(importance) OVER (ORDER BY importance DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
            "AS cum_importance FROM imp)"]


def _group_case():
    return ("CASE WHEN name LIKE 'svd%' THEN 'SVD' WHEN name LIKE '%lag%' AND name LIKE '%output%' THEN 'Lagged' "
            "WHEN name LIKE '%rollmean%' THEN 'Rolling Mean' WHEN name LIKE '%rollstd%' THEN 'Rolling Std' "
            "WHEN name LIKE '%rollmin%' OR name LIKE '%rollmax%' THEN 'Rolling Min/Max' "
            "WHEN name LIKE '%diff%' THEN 'Diff' WHEN name LIKE '%ewm%' THEN 'EWM' "
            "WHEN name LIKE '%sin_period%' OR name LIKE '%cos_period%' THEN 'Fourier' "
            "WHEN name LIKE '%interaction%' THEN 'Interaction' ELSE 'Other' END")


def _names_sql():
    parts = []
    for pos, name in enumerate(FEATS):
        parts.append(f"SELECT ({pos} * ns + so)::BIGINT AS idx, '{name}_output' || so AS name FROM sord")
    nf = len(FEATS)
    k = 0
    for p in CFG.fourier_periods:
        for fn in ("sin", "cos"):
            parts.append(f"SELECT ({nf} * (SELECT max(ns) FROM sord) + {k})::BIGINT, '{fn}_period{p}'")
            k += 1
    return " UNION ALL ".join(parts)


NAMES_CTE = f"names AS (SELECT idx, name, {_group_case()} AS grp FROM ({_names_sql()}))"


@register("group_importance", O.sql(
    "SELECT n.grp, sum(i.importance) AS importance FROM imp i JOIN names n USING (idx) GROUP BY n.grp",
    ["grp", "importance"], ["importance"], IMP_CTES + [NAMES_CTE]))
def q_group_importance(spark, base):
    """A11 on stand-in importances."""
    z, _ = C.scaled(C.hourly(spark, base))
    sids = correlation.series_order(z)
    d = C.feature_dictionary(spark, sids, CFG)
    return select.group_importance(_importance(spark, base), d)


@register("param_mode", O.sql(
    "SELECT param, arg_min(value, struct_pack(n := -n_series, f := first_sid)) AS value, "
    "arg_min(n_series, struct_pack(n := -n_series, f := first_sid)) AS n_series FROM "
    "(SELECT 'alpha' AS param, alpha AS value, count(*) AS n_series, min(sid) AS first_sid FROM mparams GROUP BY ALL) "
    "GROUP BY param", ["param", "value", "n_series"], ["value"], MPARAMS))
def q_param_mode(spark, base):
    """A12 over per-series tuned ridge alphas of the monthly panel."""
    return tune.param_mode(tune.params_long(_monthly_params(C.monthly(spark, base))))


@register("param_consensus", O.sql(
    "SELECT 'alpha' AS param, arg_min(alpha, sid) AS value, count(DISTINCT alpha) AS n_distinct FROM mparams",
    ["param", "value", "n_distinct"], ["value"], MPARAMS))
def q_param_consensus(spark, base):
    """A13 over per-series tuned ridge alphas of the monthly panel."""
    return tune.param_consensus(tune.params_long(_monthly_params(C.monthly(spark, base))))


@register("r2_sign_counts", O.sql(
    f"SELECT family, count(*) FILTER (WHERE r2 > 0) AS n_positive, count(*) FILTER (WHERE r2 <= 0) AS n_nonpositive "
    f"FROM r2 WHERE {STEST} GROUP BY family", ["family", "n_positive", "n_nonpositive"], []))
def q_r2_sign_counts(spark, base):
    """A14 on test R^2."""
    return evaluate.r2_sign_counts(_r2(spark, base, "test"))


@register("r2_histogram", O.sql(
    "SELECT g.family, g.bin, g.lo + (g.hi - g.lo) * g.bin / 20 AS lo_edge, "
    "g.lo + (g.hi - g.lo) * (g.bin + 1) / 20 AS hi_edge, coalesce(c.n, 0) AS n FROM "
    f"(SELECT family, min(r2) AS lo, max(r2) AS hi, unnest(range(0, 20)) AS bin FROM r2 WHERE {STEST} GROUP BY family) g "
    "LEFT JOIN (SELECT r.family, CASE WHEN m.hi = m.lo THEN 0 ELSE least(floor((r.r2 - m.lo) / (m.hi - m.lo) * 20), 19) "
    f"END::BIGINT AS bin, count(*) AS n FROM r2 r JOIN (SELECT family, min(r2) AS lo, max(r2) AS hi FROM r2 WHERE {STEST} "
    f"GROUP BY family) m USING (family) WHERE r.{STEST} GROUP BY ALL) c ON c.family = g.family AND c.bin = g.bin",
    ["family", "bin", "lo_edge", "hi_edge", "n"], ["lo_edge", "hi_edge"]))
def q_r2_histogram(spark, base):
    """20 equal-width bins of test R^2 per family."""
    return evaluate.r2_histogram(_r2(spark, base, "test"))


@register("group_sizes", O.sql("SELECT component AS group_id, count(*) AS n_members FROM groups GROUP BY component",
                               ["group_id", "n_members"], [], [GROUPS_CTE]))
def q_group_sizes(spark, base):
    """A16 over the monthly correlation groups."""
    return cluster.group_sizes(_monthly_groups(spark, base)[1].withColumnRenamed("component", "group_id"))


# =================================================================== windows
def _feat_query(cols):
    def fn(spark, base):
        z, _ = C.scaled(C.hourly(spark, base))
        return C.features(z, CFG).select("sid", "t", *cols)
    return fn


def _feat_sql(cols):
    return O.sql("SELECT sid, t, " + ", ".join(cols) + " FROM feat", ["sid", "t"] + cols, cols)


_LAGS = [f"lag{k}" for k in range(1, CFG.n_lags + 1)]
_RM = [f"rollmean{n}" for n in CFG.rolling_windows]
_RS = [f"rollstd{n}" for n in CFG.rolling_windows]
_RMIN = [f"rollmin{n}" for n in CFG.rolling_windows]
_RMAX = [f"rollmax{n}" for n in CFG.rolling_windows]
_DIFF = [f"diff{k}" for k in CFG.diff_orders]
_EWM = [f"ewm{s}" for s in CFG.ewm_spans]
for _name, _cols, _doc in [("lag_features", _LAGS, "W1"), ("rolling_mean", _RM, "W2"),
                           ("rolling_std", _RS, "W3"), ("rolling_min", _RMIN, "W4"),
                           ("rolling_max", _RMAX, "W5"), ("diff_k", _DIFF, "W7"),
                           ("ewm_mean", _EWM, "W8"), ("lag_interaction", ["interaction"], "W9")]:
    _fn = _feat_query(_cols)
    _fn.__doc__ = f"{_doc} on the scaled hourly panel."
    register(_name, _feat_sql(_cols))(_fn)


@register("rolling_full_mean_std", O.sql(
    "SELECT sid, t, CASE WHEN count(v) OVER w >= 14 THEN avg(v) OVER w END AS fullmean14, "
    "CASE WHEN count(v) OVER w >= 14 THEN stddev_samp(v) OVER w END AS fullstd14 FROM hourly "
    f"WINDOW w AS ({O.W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)",
    ["sid", "t", "fullmean14", "fullstd14"], ["fullmean14", "fullstd14"]))
def q_rolling_full(spark, base):
    """14-step mean / std, NULL until the window is full (raw scale)."""
    return windows.rolling_full(C.hourly(spark, base), 14).select("sid", "t", "fullmean14", "fullstd14")


LEAD_H = 3


@register("lead_target", O.sql(f"SELECT sid, t, lead(v, {LEAD_H}, 0.0::DOUBLE) OVER ({O.W}) AS label FROM scaled",
                               ["sid", "t", "label"], ["label"]))
def q_lead_target(spark, base):
    """W10 with horizon 3 (h = 1 is the identity, T1)."""
    z, _ = C.scaled(C.hourly(spark, base))
    return windows.lead_target(z, LEAD_H).select("sid", "t", "label")


@register("cumulative_importance", O.sql("SELECT idx, importance, rank, cum_importance FROM rk",
                                         ["idx", "importance", "rank", "cum_importance"],
                                         ["importance", "cum_importance"], IMP_CTES))
def q_cumulative_importance(spark, base):
    """W11 on stand-in importances."""
    return select.cumulative_importance(_importance(spark, base)).select(
        "idx", "importance", "rank", "cum_importance")


# =================================================================== sort / top-k
@register("importance_rank", O.sql("SELECT idx, importance, rank FROM rk", ["idx", "importance", "rank"],
                                   ["importance"], IMP_CTES))
def q_importance_rank(spark, base):
    """O1."""
    return select.importance_rank(_importance(spark, base))


@register("top30_importance", O.sql("SELECT idx, importance, rank FROM rk WHERE rank <= 30",
                                    ["idx", "importance", "rank"], ["importance"], IMP_CTES))
def q_top30(spark, base):
    """O2."""
    return select.top_importance(_importance(spark, base), 30)


@register("select_by_importance", O.sql(
    f"SELECT idx, importance, rank, cum_importance, n_selected FROM rk, (SELECT least(greatest(coalesce(min(rank) "
    f"FILTER (WHERE cum_importance >= {CFG.importance_threshold}), 1), {CFG.min_features}), count(*)) AS n_selected "
    f"FROM rk) WHERE rank <= n_selected",
    ["idx", "importance", "rank", "cum_importance", "n_selected"], ["importance", "cum_importance"], IMP_CTES))
def q_select_by_importance(spark, base):
    """Threshold 0.80, floor 20 (v2) on stand-in importances."""
    return select.select_by_importance(_importance(spark, base), CFG.importance_threshold, CFG.min_features)


@register("top3_models", O.sql(
    "SELECT family, avg_r2, row_number() OVER (ORDER BY avg_r2 DESC, ord) AS rank FROM avgr2 JOIN fam USING (family) "
    f"WHERE {SVAL} QUALIFY rank <= 3", ["family", "avg_r2", "rank"], ["avg_r2"]))
def q_top3_models(spark, base):
    """O3."""
    return evaluate.top_models(evaluate.macro_r2(_r2(spark, base, "val")), C.FAMILIES, 3)


@register("best_worst_series", O.sql(
    "SELECT family, sid, r2, 'best' AS side, row_number() OVER (PARTITION BY family ORDER BY r2 DESC, sid) AS rank "
    f"FROM r2 WHERE {STEST} QUALIFY rank <= 3 UNION ALL "
    "SELECT family, sid, r2, 'worst' AS side, row_number() OVER (PARTITION BY family ORDER BY r2, sid) AS rank "
    f"FROM r2 WHERE {STEST} QUALIFY rank <= 3", ["family", "sid", "r2", "side", "rank"], ["r2"]))
def q_best_worst(spark, base):
    """O4 on test R^2."""
    return evaluate.best_worst_series(_r2(spark, base, "test"), 3)


@register("best_model", O.sql(
    "SELECT arg_max(family, struct_pack(r := avg_r2, o := -ord)) AS best_family, max(avg_r2) AS best_avg_r2 "
    f"FROM avgr2 JOIN fam USING (family) WHERE {SVAL}", ["best_family", "best_avg_r2"], ["best_avg_r2"]))
def q_best_model(spark, base):
    """O5."""
    return evaluate.best_model(evaluate.macro_r2(_r2(spark, base, "val")), C.FAMILIES)


# =================================================================== set ops
@register("concat_chunks", O.sql(
    "SELECT 'hourly' AS panel, sid, t, v FROM hourly UNION ALL SELECT 'monthly', sid, t, v FROM monthly",
    ["panel", "sid", "t", "v"], ["v"]))
def q_concat_chunks(spark, base):
    """UNION ALL of the two panels."""
    return reshape.union_all([C.hourly(spark, base).select(F.lit("hourly").alias("panel"), "*"),
                              C.monthly(spark, base).select(F.lit("monthly").alias("panel"), "*")])


@register("union_model_metrics", O.sql(
    "SELECT s.split, s.family, s.mse, sqrt(s.mse) AS rmse, s.mae, a.avg_r2 FROM "
    "(SELECT split, family, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae FROM scored "
    "WHERE split IN ('val', 'test') GROUP BY ALL) s JOIN avgr2 a USING (split, family)",
    ["split", "family", "mse", "rmse", "mae", "avg_r2"], ["mse", "rmse", "mae", "avg_r2"]))
def q_union_model_metrics(spark, base):
    """Per-family metric tables of both splits stacked."""
    s, _ = C.scored(spark, base)
    parts = [evaluate.model_comparison(s.filter(F.col("split") == w)).select(
        F.lit(w).alias("split"), "family", "mse", "rmse", "mae", "avg_r2") for w in ("val", "test")]
    return reshape.union_all(parts)


# =================================================================== scalar
@register("fourier_terms", O.sql(
    "SELECT t, " + ", ".join(
        f"{fn}(t * 2 * pi() / ({CFG.steps_per_period_unit} * {p})) AS {fn}_period{p}"
        for p in CFG.fourier_periods for fn in ("sin", "cos")) + " FROM (SELECT DISTINCT t FROM hourly)",
    ["t"] + [f"{fn}_period{p}" for p in CFG.fourier_periods for fn in ("sin", "cos")],
    [f"{fn}_period{p}" for p in CFG.fourier_periods for fn in ("sin", "cos")]))
def q_fourier(spark, base):
    """F1 over the time steps of the hourly panel."""
    steps = C.hourly(spark, base).select("t").distinct()
    return steps.select("t", *fourier_terms(F.col("t"), CFG.fourier_periods, CFG.steps_per_period_unit))


# =================================================================== split / clusters
@register("chronological_split", O.sql("SELECT sid, t, split FROM fs", ["sid", "t", "split"], []))
def q_split(spark, base):
    """0.70 / 0.15 / 0.15 after 8 warm-up steps."""
    z, _ = C.scaled(C.hourly(spark, base))
    return split.chronological_split(z, CFG).select("sid", "t", "split")


@register("expanding_folds", O.sql(
    "SELECT x.sid, x.t, f.fold::BIGINT AS fold, CASE WHEN x.t < f.test_lo THEN 'train' ELSE 'test' END AS role "
    "FROM hourly x JOIN hp_f f ON x.t >= f.lo AND x.t < f.test_hi",
    ["sid", "t", "fold", "role"], [], _ridge1_sql("hourly", "hp")[:2]))
def q_folds(spark, base):
    """TimeSeriesSplit(3) over the train rows."""
    return split.expanding_folds(C.hourly(spark, base), CFG).select("sid", "t", "fold", "role")


@register("cluster_features", O.sql(
    "SELECT sid, " + ", ".join(
        f"CASE WHEN stddev_pop(coalesce({c}, 0.0)) OVER () = 0 THEN 0.0 ELSE "
        f"(coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_pop(coalesce({c}, 0.0)) OVER () END AS {c}"
        for c in ("mean", "std", "min", "max", "skew", "kurt", "ac1", "ac7", "ac14"))
    + " FROM (SELECT sid, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, "
    "CASE WHEN count(v) >= 3 THEN skewness(v) END AS skew, CASE WHEN count(v) >= 4 THEN kurtosis(v) END AS kurt, "
    + ", ".join(f"{O.corr_expr('v', f'l{k}')} AS ac{k}" for k in AC_LAGS)
    + " FROM (SELECT sid, v, " + ", ".join(f"lag(v, {k}) OVER ({O.W}) AS l{k}" for k in AC_LAGS)
    + " FROM monthly) GROUP BY sid)",
    ["sid", "mean", "std", "min", "max", "skew", "kurt", "ac1", "ac7", "ac14"],
    ["mean", "std", "min", "max", "skew", "kurt", "ac1", "ac7", "ac14"]))
def q_cluster_features(spark, base):
    """C1 on the monthly panel."""
    return profile.cluster_features(C.monthly(spark, base))


@register("group_representative", O.sql(
    "SELECT component AS group_id, min(sid) AS representative, count(*) AS n_members FROM groups GROUP BY component",
    ["group_id", "representative", "n_members"], [], [GROUPS_CTE]))
def q_group_representative(spark, base):
    """C4 over the monthly correlation groups."""
    return cluster.group_representative(_monthly_groups(spark, base)[1].withColumnRenamed("component", "group_id"))


# =================================================================== evaluation
_TEST = f"(SELECT * FROM scored WHERE {STEST})"


@register("pooled_errors", O.sql(
    f"SELECT family, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, "
    f"avg(abs(y - yhat)) AS mae FROM {_TEST} GROUP BY family", ["family", "mse", "rmse", "mae"],
    ["mse", "rmse", "mae"]))
def q_pooled_errors(spark, base):
    """V1 on the test split."""
    s, _ = C.scored(spark, base)
    return evaluate.pooled_errors(s.filter(F.col("split") == "test"))


@register("series_r2", O.sql(f"SELECT family, sid, r2 FROM r2 WHERE {STEST}", ["family", "sid", "r2"], ["r2"]))
def q_series_r2(spark, base):
    """V2 on the test split."""
    return _r2(spark, base, "test")


@register("macro_r2", O.sql(f"SELECT family, avg_r2 FROM avgr2 WHERE {STEST}", ["family", "avg_r2"], ["avg_r2"]))
def q_macro_r2(spark, base):
    """V3 on the test split."""
    return evaluate.macro_r2(_r2(spark, base, "test"))


_ORIG = (f"(SELECT s.family, s.sid, s.t, s.y * CASE WHEN h.sd = 0 THEN 1.0 ELSE h.sd END + h.mu AS y, "
         f"s.yhat * CASE WHEN h.sd = 0 THEN 1.0 ELSE h.sd END + h.mu AS yhat FROM scored s JOIN hstats h USING (sid) "
         f"WHERE s.{STEST})")


@register("errors_original_scale", O.sql(
    f"SELECT family, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, "
    f"avg(abs(y - yhat)) AS mae, CASE WHEN var_pop(y) * count(y) = 0 THEN (CASE WHEN sum((y - yhat) * (y - yhat)) = 0 "
    f"THEN 1.0 ELSE 0.0 END) ELSE 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) END AS r2_pooled "
    f"FROM {_ORIG} GROUP BY family", ["family", "mse", "rmse", "mae", "r2_pooled"],
    ["mse", "rmse", "mae", "r2_pooled"]))
def q_errors_original(spark, base):
    """V4: test errors after inverse scaling."""
    s, st = C.scored(spark, base)
    return evaluate.errors_original_scale(s.filter(F.col("split") == "test"), st)


@register("pooled_r2", O.sql(
    f"SELECT family, CASE WHEN var_pop(y) * count(y) = 0 THEN (CASE WHEN sum((y - yhat) * (y - yhat)) = 0 "
    f"THEN 1.0 ELSE 0.0 END) ELSE 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) END AS r2_pooled "
    f"FROM {_ORIG} GROUP BY family", ["family", "r2_pooled"], ["r2_pooled"]))
def q_pooled_r2(spark, base):
    """V5: one R^2 over all original-scale test values."""
    from .. operators.reshape import inverse_standardize
    s, st = C.scored(spark, base)
    return evaluate.pooled_r2(inverse_standardize(s.filter(F.col("split") == "test"), st, ["y", "yhat"]))


@register("accuracy_1_minus_mae", O.sql(
    f"SELECT family, greatest(0.0, 1 - avg(abs(y - yhat))) AS accuracy FROM {_TEST} GROUP BY family",
    ["family", "accuracy"], ["accuracy"]))
def q_accuracy(spark, base):
    """V6."""
    s, _ = C.scored(spark, base)
    return evaluate.pooled_errors(s.filter(F.col("split") == "test")).select(
        "family", evaluate.accuracy().alias("accuracy"))


@register("model_comparison", O.sql(
    f"SELECT e.family, e.mse, sqrt(e.mse) AS rmse, e.mae, a.avg_r2 FROM (SELECT family, "
    f"avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae FROM {_TEST} GROUP BY family) e "
    f"JOIN (SELECT family, avg_r2 FROM avgr2 WHERE {STEST}) a USING (family)",
    ["family", "mse", "rmse", "mae", "avg_r2"], ["mse", "rmse", "mae", "avg_r2"]))
def q_model_comparison(spark, base):
    """V7 on the test split."""
    s, _ = C.scored(spark, base)
    return evaluate.model_comparison(s.filter(F.col("split") == "test")).select(
        "family", "mse", "rmse", "mae", "avg_r2")


@register("difficult_series", O.sql(
    f"SELECT sid, max(r2) AS best_r2 FROM r2 WHERE {SVAL} GROUP BY sid HAVING max(r2) < 0",
    ["sid", "best_r2"], ["best_r2"]))
def q_difficult(spark, base):
    """V8 over the three forecasters (validation)."""
    return evaluate.difficult_series(_r2(spark, base, "val"))


@register("difficult_series_persist", O.sql(
    f"SELECT sid, max(r2) AS best_r2 FROM r2 WHERE {SVAL} AND family = 'persist' GROUP BY sid HAVING max(r2) < 0",
    ["sid", "best_r2"], ["best_r2"]))
def q_difficult_persist(spark, base):
    """V8 over ``persist`` alone (non-empty, FIXTURES §4)."""
    return evaluate.difficult_series(_r2(spark, base, "val").filter(F.col("family") == "persist"))


@register("r2_matrix", O.sql(
    "SELECT family, " + ", ".join(f"max(r2) FILTER (WHERE sid = '{s}') AS {s}"
                                  for s in ("click", "error", "purchase", "signup", "view"))
    + f" FROM r2 WHERE {STEST} GROUP BY family", ["family", "click", "error", "purchase", "signup", "view"],
    ["click", "error", "purchase", "signup", "view"]))
def q_r2_matrix(spark, base):
    """V9: family x series test R^2."""
    r2 = _r2(spark, base, "test")
    return evaluate.r2_matrix(r2, correlation.series_order(C.hourly(spark, base)))


@register("final_summary", O.sql(
    "SELECT e.family, a.avg_r2, e.mse, sqrt(e.mse) AS rmse, e.mae, o.mse_orig, sqrt(o.mse_orig) AS rmse_orig, "
    "o.mae_orig, o.r2_pooled_orig, greatest(0.0, 1 - e.mae) AS accuracy, (a.avg_r2 - 0.947) / 0.947 * 100 AS improvement_pct FROM "
    f"(SELECT family, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae FROM {_TEST} GROUP BY family) e "
    f"JOIN (SELECT family, avg_r2 FROM avgr2 WHERE {STEST}) a USING (family) "
    "JOIN (SELECT family, avg((y - yhat) * (y - yhat)) AS mse_orig, avg(abs(y - yhat)) AS mae_orig, "
    "1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) AS r2_pooled_orig "
    f"FROM {_ORIG} GROUP BY family) o USING (family) "
    "WHERE e.family = (SELECT arg_max(family, struct_pack(r := avg_r2, o := -ord)) FROM avgr2 JOIN fam USING (family) "
    f"WHERE {SVAL})",
    ["family", "avg_r2", "mse", "rmse", "mae", "mse_orig", "rmse_orig", "mae_orig", "r2_pooled_orig", "accuracy", "improvement_pct"],
    ["avg_r2", "mse", "rmse", "mae", "mse_orig", "rmse_orig", "mae_orig", "r2_pooled_orig", "accuracy", "improvement_pct"]))
def q_final_summary(spark, base):
    """V10 for the family chosen on validation R^2."""
    s, st = C.scored(spark, base)
    chosen = evaluate.best_model(evaluate.macro_r2(evaluate.series_r2(s.filter(F.col("split") == "val"))),
                                 C.FAMILIES)
    return evaluate.final_summary(s.filter(F.col("split") == "test"), chosen, st)


# =================================================================== ensembles
WEIGHTS_SQL = ("wts AS (SELECT r.sid, r.family, CASE WHEN sum(CASE WHEN r.r2 > 0 THEN r.r2 ELSE 0.0 END) "
               "OVER (PARTITION BY r.sid) > 0 THEN (CASE WHEN r.r2 > 0 THEN r.r2 ELSE 0.0 END) / "
               "sum(CASE WHEN r.r2 > 0 THEN r.r2 ELSE 0.0 END) OVER (PARTITION BY r.sid) "
               "ELSE 1.0 / (SELECT count(*) FROM cand) END AS weight FROM r2 r "
               f"WHERE r.{SVAL} AND r.family IN (SELECT family FROM cand))")


@register("weighted_ensemble", O.sql("SELECT sid, family, weight FROM wts", ["sid", "family", "weight"],
                                     ["weight"], [WEIGHTS_SQL]))
def q_weighted_ensemble(spark, base):
    """Per-series ensemble weights from validation R^2."""
    return ensemble.ensemble_weights(_r2(spark, base, "val"), C.candidates(spark, base))


@register("weighted_predictions", O.sql(
    f"SELECT s.sid, s.t, first(s.y) AS y, sum(w.weight * s.yhat) AS yhat FROM scored s JOIN wts w "
    f"ON w.sid = s.sid AND w.family = s.family WHERE s.{STEST} AND w.weight <> 0 GROUP BY s.sid, s.t",
    ["sid", "t", "y", "yhat"], ["y", "yhat"], [WEIGHTS_SQL]))
def q_weighted_predictions(spark, base):
    """The weighted ensemble's test predictions."""
    s, _ = C.scored(spark, base)
    w = ensemble.ensemble_weights(_r2(spark, base, "val"), C.candidates(spark, base))
    return ensemble.weighted_predictions(s.filter(F.col("split") == "test"), w).select("sid", "t", "y", "yhat")


@register("grid_search_cv", O.sql("SELECT sid, alpha, cv_mse FROM hparams", ["sid", "alpha", "cv_mse"],
                                  ["alpha", "cv_mse"], HPARAMS))
def q_grid_search(spark, base):
    """G2 (single-feature ridge form): per series alpha from the v2 Ridge grid
    by mean MSE over 3 expanding folds of the train rows."""
    z, _ = C.scaled(C.hourly(spark, base))
    fs = C.feat_split(z, CFG).filter(F.col("split") == "train")
    return tune.best_params(tune.ridge1_grid_cv(fs, CFG, C.RIDGE_ALPHAS, bounds_from=z))


# =================================================================== streaming
@register("stream_panel_chunks", O.sql("SELECT sid, t, v FROM cells", ["sid", "t", "v"], ["v"]))
def q_stream_panel(spark, base):
    """U1 (streaming form): hourly cells built incrementally from the events files."""
    import uuid

    from ..session import scratch_path
    from ..streaming import chunks
    run = uuid.uuid4().hex[:8]
    path = chunks.stream_hourly_cells(spark, base, scratch_path(spark, f"stream_cells_{run}"),
                                      scratch_path(spark, f"stream_ckpt_{run}"))
    return chunks.cells_to_panel(spark, path)
