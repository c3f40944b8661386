"""Cross-series correlation (A3, J3), correlation groups (A7), nearest series.

A tiled Gram: series are numbered and cut into tiles of ``TILE``, steps into
ranges of ``STEPS``; a (tile, range) is one packed row. Every pair of tiles is
one key: its tasks multiply the two tiles' values, squares and presence range
by range, partial sums (200 KB) meet in two steps per pair of tiles, and pairs
of series come out there, so gaps and NULLs are pairwise complete and nothing
of size series^2 is ever in one place. A threshold on |r| is applied inside the pair of tiles, so
groups read only the links they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import threshold_pred
from ..session import stored
from ..sources.tables import row_index
from .components import component_labels

TILE = 64
STEPS = 2048
BUCKETS = 32


def series_order(panel: DataFrame) -> list[str]:
    """Sorted series keys (O(series) to the driver)."""
    return [r[0] for r in panel.select("sid").distinct().orderBy("sid").collect()]


def _tiles(panel: DataFrame, value: str, tile: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """Packed cells ``tile, part, cells (place in tile, step, value)`` of values
    less their series' mean (against cancellation), and each tile's keys."""
    every = panel.select("sid").distinct()
    place = row_index(every, "sid", "pos").withColumn("tile", F.floor(F.col("pos") / tile)).withColumn(
        "at", (F.col("pos") % tile).cast("int"))
    place = stored(place.drop("pos"), "series")
    mean = panel.groupBy("sid").agg(F.avg(value).alias("_mu"))
    cells = (panel.filter(F.col(value).isNotNull()).join(mean, "sid").join(place, "sid")
             .select("tile", F.floor(F.col("t") / steps).alias("part"), "at", F.pmod("t", F.lit(steps)).cast("int").alias("step"),
                     (F.col(value) - F.col("_mu")).alias("d")))
    packed = cells.groupBy("tile", "part").agg(F.collect_list(F.struct("at", "step", "d")).alias("c"))
    packed = packed.select("tile", "part", F.col("c.at").alias("at"), F.col("c.step").alias("step"), F.col("c.d").alias("d"))
    keys = place.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "sid"))).alias("k")).select(
        "tile", F.col("k.sid").alias("keys"))
    return stored(packed, "tiles"), keys


def _products(tile: int, steps: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _sums(it, tile, steps)
    return run


def _dense(at, step, d, tile: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    x, m = np.zeros((steps, tile)), np.zeros((steps, tile))
    x[step, at] = d
    m[step, at] = 1.0
    return x, m


def _sums(it: Iterator[pd.DataFrame], tile: int, steps: int) -> Iterator[pd.DataFrame]:
    """Sums over a task's ranges, per pair of tiles: n, and for both sides the
    sums and sums of squares over common steps, and the products."""
    held: dict[tuple[int, int], np.ndarray] = {}
    bucket = TaskContext.get().partitionId() % BUCKETS

    def flush():
        for k, v in held.items():
            yield pd.DataFrame({"a": [k[0]], "b": [k[1]], "bucket": [bucket], "sums": [v.tobytes()]})
        held.clear()

    for pdf in it:
        for r in pdf.itertuples():
            (x, m), (y, n) = _dense(r.at, r.step, r.d, tile, steps), _dense(r.at_b, r.step_b, r.d_b, tile, steps)
            g = np.stack([m.T @ n, x.T @ n, m.T @ y, (x * x).T @ n, m.T @ (y * y), x.T @ y])
            if (r.a, r.b) in held:
                held[r.a, r.b] += g
            else:
                held[r.a, r.b] = g
            if len(held) > 128:
                yield from flush()
    yield from flush()


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "sums": [sum(np.frombuffer(s, np.float64) for s in pdf["sums"]).tobytes()]})


def _pairs(tile: int, least: float | None, upper: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(6 * tile * tile)
        for s in pdf["sums"].dropna():
            sums += np.frombuffer(s, np.float64)
        k, sx, sy, sxx, syy, sxy = sums.reshape(6, tile, tile)
        a, b = pdf["keys_a"].iloc[0], pdf["keys_b"].iloc[0]
        i, j = np.triu_indices(tile, 1) if key[0] == key[1] else map(np.ravel, np.indices((tile, tile)))
        inside = (i < len(a)) & (j < len(b))
        i, j = i[inside], j[inside]
        k, sx, sy, sxx, syy, sxy = (g[i, j] for g in (k, sx, sy, sxx, syy, sxy))
        with np.errstate(all="ignore"):
            c, vx, vy = sxy - sx * sy / k, sxx - sx * sx / k, syy - sy * sy / k
            varies = (vx > 1e-12 * sxx) & (vy > 1e-12 * syy) & (k > 1)
            r = np.where(varies, np.clip(c / np.sqrt(vx * vy), -1.0, 1.0), np.nan)
            cov = np.where(k > 1, c / (k - 1), np.nan)
            keep = np.ones(len(r), bool) if least is None else (np.abs(r) > least) & (np.abs(r) < upper)
        i, j = i[keep], j[keep]
        return pd.DataFrame({"sid_a": np.array(a, object)[i], "sid_b": np.array(b, object)[j], "n_common": k[keep].astype("int64"),
                             "cov": cov[keep], "r": r[keep]})
    return run


def pair_moments(panel: DataFrame, value: str = "v", least: float | None = None, upper: float = 1.0,
                 tile: int = TILE, steps: int = STEPS) -> DataFrame:
    """(sid_a, sid_b, n_common, cov, r) for every pair a < b over their common
    steps; r is NULL where either is constant there (T19). With ``least`` only
    pairs of least < |r| < upper."""
    tiles, keys = _tiles(panel.select("sid", "t", value), value, tile, steps)
    ka, kb = (keys.select(F.col("tile").alias(n), F.col("keys").alias(f"keys_{n}")) for n in "ab")
    n_tiles = keys.count()
    left = tiles.select(F.col("tile").alias("a"), "part", "at", "step", "d", F.explode(
        F.sequence(F.col("tile"), F.lit(max(n_tiles - 1, 0)).cast("long"))).alias("b"))
    right = tiles.select(F.col("tile").alias("b"), "part", *[F.col(c).alias(f"{c}_b") for c in ("at", "step", "d")])
    sums = left.join(right, ["b", "part"]).mapInPandas(_products(tile, steps), "a long, b long, bucket int, sums binary")
    sums = sums.groupBy("a", "b", "bucket").applyInPandas(_added, "a long, b long, sums binary")
    # pairs of tiles without a common range have no row there, and no common step
    every = ka.select("a", F.explode(F.sequence(F.col("a"), F.lit(max(n_tiles - 1, 0)).cast("long"))).alias("b"))
    found = every.join(sums, ["a", "b"], "left").join(ka, "a").join(kb, "b")
    out = found.groupBy("a", "b").applyInPandas(
        _pairs(tile, least, upper), "sid_a string, sid_b string, n_common long, cov double, r double")
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("sid_a", "sid_b", "n_common", null("cov"), null("r"))


def corr_matrix(panel: DataFrame, value: str = "v") -> DataFrame:
    """A3: Pearson r for every pair a < b over their common steps; NULL for a
    constant series (T19)."""
    return pair_moments(panel, value).select("sid_a", "sid_b", "r")


def series_pairs(panel: DataFrame, value: str = "v") -> DataFrame:
    """Co-moments of every pair a < b at equal t: common steps and sample
    covariance, from the same Gram pass."""
    return pair_moments(panel, value).select("sid_a", "sid_b", "n_common", "cov")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, component = smallest sid reachable) for every node, run until the
    edge set stops changing (``operators.components``)."""
    found = component_labels(edges, "sid_a", "sid_b").withColumnRenamed("node", "sid")
    return nodes.join(found, "sid", "left").select(
        "sid", F.coalesce("component", "sid").alias("component"))


def corr_groups(panel: DataFrame, threshold: float = 0.8, upper: float = 1.0,
                min_degree: int = 1, value: str = "v") -> DataFrame:
    """Series linked when threshold < |r| < upper; groups are the
    connected components (T12 re-aimed); a series with fewer than
    ``min_degree`` links stays alone."""
    edges = pair_moments(panel, value, threshold, upper).filter(threshold_pred(F.col("r"), threshold, upper))
    if min_degree > 1:
        deg = edges.select(F.col("sid_a").alias("sid")).unionByName(
            edges.select(F.col("sid_b").alias("sid"))).groupBy("sid").count()
        ok = deg.filter(F.col("count") >= min_degree).select("sid")
        edges = edges.join(ok.withColumnRenamed("sid", "sid_a"), "sid_a", "left_semi").join(
            ok.withColumnRenamed("sid", "sid_b"), "sid_b", "left_semi")
    nodes = panel.select("sid").distinct()
    return connected_components(nodes, edges)


def nearest_series(corr: DataFrame, sampled: DataFrame) -> DataFrame:
    """Every unsampled series takes the most correlated sampled series
    (signed r; smallest sid on ties). Returns (sid, nearest, r)."""
    both = corr.unionByName(corr.select(F.col("sid_b").alias("sid_a"), F.col("sid_a").alias("sid_b"), "r"))
    cand = both.join(sampled.select(F.col("sid").alias("sid_b")), "sid_b", "left_semi").join(
        sampled.select(F.col("sid").alias("sid_a")), "sid_a", "left_anti")
    key = F.struct((-F.coalesce("r", F.lit(float("-inf")))).alias("_neg_r"), F.col("sid_b"))
    best = cand.groupBy("sid_a").agg(F.min_by(F.struct("sid_b", "r"), key).alias("_b"))
    return best.select(F.col("sid_a").alias("sid"), F.col("_b.sid_b").alias("nearest"),
                       F.col("_b.r").alias("r"))
