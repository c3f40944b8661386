"""One table for the fitted models of all families.

A row per (family, series): ``intercept`` and ``coef`` of the linear families,
``scale`` and ``trees`` (flat node arrays) of the others; the parts a model
does not have are empty. Prediction joins the label rows with the table on the
series and with X on t, and evaluates one expression: the dot product, and a
walk down every tree. The plan's size does not depend on the number of series
or families, and saving a model is writing the table.

Rows of X without a label are not predicted; a model whose series has no rows
gives none.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig
from . import linear, trees
from .models import DEFAULTS
from .reshape import union_all

TREE = ("array<struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>,"
        "n:array<bigint>,gain:array<double>,depth:int>>")
MODEL_SCHEMA = f"family string, sid string, intercept double, coef array<double>, scale double, trees {TREE}"
NODE_ARRAYS = ("feature", "threshold", "left", "right", "value", "n", "gain", "depth")
LINEAR = ("LinearRegression", "Ridge", "Lasso")
#: label rows of one series that are joined with its model at once
PREDICT_ROWS = 2048


def linear_models(coefs: DataFrame) -> DataFrame:
    """Model rows of coefficients (family, sid, intercept, coef)."""
    return coefs.select("family", F.col("sid").cast("string").alias("sid"), "intercept", "coef", F.lit(0.0).alias("scale"),
                        F.array().cast(TREE).alias("trees"))


def tree_models(family: str, grown: DataFrame, mean: bool) -> DataFrame:
    """Model rows of grown trees; ``mean`` averages them, else they add up."""
    rows = grown.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("tree", *NODE_ARRAYS))).alias("t"))
    size = F.when(F.lit(mean), 1.0 / F.size("t")).otherwise(1.0)
    return rows.select(F.lit(family).alias("family"), "sid", F.lit(0.0).alias("intercept"), F.array().cast("array<double>").alias("coef"),
                       size.alias("scale"), F.transform("t", lambda e: F.struct(*[e[c].alias(c) for c in NODE_ARRAYS])).cast(TREE)
                       .alias("trees"))


def fit_models(X: DataFrame, labels: DataFrame, families, cfg: PanelConfig, rows=None, params: dict | None = None,
               name: str | None = None) -> DataFrame:
    """Every family for every series. ``params`` maps a series to its
    own hyper-parameters; ``name`` replaces the family's name in the table."""
    params = params or {}

    def lines(flat: list[str]) -> DataFrame:
        sids = [r[0] for r in labels.select("sid").distinct().orderBy("sid").collect()]
        fits = [(name or f, f, {s: float(params.get(s, {}).get("alpha", DEFAULTS[f].get("alpha", 0.0))) for s in sids}) for f in flat]
        return linear_models(linear.fit_series(X, labels, fits, rows))

    def grown(f: str) -> DataFrame:
        own = {s: trees.family_params(f, {**DEFAULTS[f], **q}, cfg.seed) for s, q in params.items()}
        return tree_models(name or f, trees.fit_trees(X, labels, trees.family_params(f, DEFAULTS[f], cfg.seed), rows, per_series=own),
                           f == "RandomForest")

    flat = [f for f in families if f in LINEAR]
    jobs = [(lines, flat)] * bool(flat) + [(grown, f) for f in families if f not in LINEAR]
    # a boosted family has a task a series, a forest many: side by side they leave no core idle
    with ThreadPoolExecutor(max_workers=max(1, min(cfg.fit_parallelism, len(jobs)))) as pool:
        return union_all(list(pool.map(lambda job: job[0](job[1]), jobs)))


def _tree_value(tree: Column, x: Column) -> Column:
    """What ``tree`` gives for ``x``: a step down for each of its levels."""
    at = F.aggregate(F.sequence(F.lit(1), F.greatest(tree["depth"], F.lit(1))), F.lit(0), lambda node, _: F.when(
        tree["feature"][node] < 0, node).when(x[tree["feature"][node]] <= tree["threshold"][node], tree["left"][node])
        .otherwise(tree["right"][node]))
    return tree["value"][at]


def _value(x: Column) -> Column:
    """A model row's prediction for the features ``x``."""
    products = F.when(F.size("coef") > 0, F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    summed = F.aggregate("trees", F.lit(0.0), lambda s, tree: s + _tree_value(tree, x))
    return F.col("intercept") + F.coalesce(products, F.lit(0.0)) + F.col("scale") * summed


def predict_models(models: DataFrame, X: DataFrame, labels: DataFrame, rows=None, features: str = "features") -> DataFrame:
    """M8: (family, sid, t, y, yhat[, split]) of every model of a label row's
    series. Rows are joined with the models in blocks of at most PREDICT_ROWS
    steps, so a model is not copied for each of them."""
    lab = labels if rows is None else labels.filter(rows)
    keep = [c for c in ("split",) if c in lab.columns]
    at = lab.select(F.col("sid").cast("string").alias("sid"), "t", F.col("label").cast("double").alias("y"), *keep).join(
        X.select("t", trees._array(features, X).alias("x")), "t")
    packed = at.groupBy("sid", F.floor(F.col("t") / PREDICT_ROWS).alias("block")).agg(
        F.collect_list(F.struct("t", "y", *keep, "x")).alias("r"))
    out = packed.join(models, "sid").select("family", "sid", F.inline(F.transform("r", lambda e: F.struct(
        e["t"].alias("t"), e["y"].alias("y"), _value(e["x"]).alias("yhat"), *[e[c].alias(c) for c in keep]))))
    return out.select("family", "sid", "t", "y", "yhat", *keep)


def importances(models: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """``family, sid, idx, importance`` of every tree model, adding up to 1
    over its features. Forests average their trees' shares of gain, boosted
    models share the whole gain, XGBoost the mean gain of a feature's splits.
    ``families`` maps names in the table to families where they differ."""
    kind = F.col("family")
    for name, family in (families or {}).items():
        kind = F.when(F.col("family") == name, family).otherwise(kind)
    nodes = (models.filter(F.size("trees") > 0).select("family", kind.alias("kind"), "sid", F.posexplode("trees").alias("tree", "e"))
             .select("family", "kind", "sid", "tree", F.inline(F.arrays_zip(F.col("e.feature").alias("idx"), F.col("e.gain").alias("gain")))))
    per_tree = nodes.filter("idx >= 0").groupBy("family", "kind", "sid", "tree", "idx").agg(
        F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    whole = per_tree.groupBy("family", "sid", "tree").agg(F.sum("gain").alias("tree_gain"))
    each = per_tree.join(whole, ["family", "sid", "tree"]).groupBy("family", "kind", "sid", "idx").agg(
        F.sum(F.col("gain") / F.col("tree_gain")).alias("shares"), F.sum("gain").alias("gain"), F.sum("splits").alias("splits"))
    raw = each.select("family", "sid", "idx", F.when(F.col("kind") == "RandomForest", F.col("shares")).when(
        F.col("kind") == "XGBoost", F.col("gain") / F.col("splits")).otherwise(F.col("gain")).alias("raw"))
    total = raw.groupBy("family", "sid").agg(F.sum("raw").alias("total"))
    return raw.join(total, ["family", "sid"]).select("family", "sid", F.col("idx").cast("int").alias("idx"),
                                                     (F.col("raw") / F.col("total")).alias("importance"))
