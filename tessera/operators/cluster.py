"""Series clustering (C3), representatives (C4) and group sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .profile import CLUSTER_FEATURES


def n_clusters(n_series: int, configured: int) -> int:
    """k = max(3, min(configured, n // 3)) (no silhouette search exists, T13)."""
    return max(3, min(configured, n_series // 3))


def _draws(seed: int, step: int, keys: list[str]) -> np.ndarray:
    """Uniform numbers by (seed, step, series key)."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}|{step}|{k}".encode(), digest_size=8).digest(), "big") + 0.5 for k in keys]) / 2 ** 64


def kmeans_groups(feats: DataFrame, k: int, seed: int = 42, restarts: int = 10,
                  cols=CLUSTER_FEATURES, most: int = 300) -> tuple[DataFrame, float]:
    """K-means on the standardized series features; ``restarts`` seeds,
    the least within-cluster cost wins. Returns ((sid, group_id), cost).

    All restarts run together: a pass assigns every series in every restart and
    sums by (restart, cluster); so passes are jobs, whatever the restarts.
    Starts are k-means++: the next centre is the row of largest
    log(distance^2) plus Gumbel noise hashed from (seed, step, series), which
    is a draw by distance^2. Only centres are on the driver."""
    rows = feats.select(F.col("sid").cast("string").alias("sid"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    rows = stored(rows, "kmeans_rows")
    seeds = [seed + r for r in range(restarts)]
    best_schema = "r int, score double, sid string, x array<double>"

    def nearest(x, centres):
        return ((x[:, None, :] - centres[None]) ** 2).sum(2)

    def starts(step, centres):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                if not len(pdf):
                    continue
                x, keys, out = np.stack(pdf["x"].to_numpy()), pdf["sid"].tolist(), []
                for r, s in enumerate(seeds):
                    gumbel = -np.log(-np.log(_draws(s, step, keys)))
                    if centres is not None:
                        with np.errstate(divide="ignore"):
                            gumbel = gumbel + np.log(nearest(x, centres[r]).min(1))
                    i = int(gumbel.argmax())
                    out.append((r, float(gumbel[i]), keys[i], x[i].tolist()))
                yield pd.DataFrame(out, columns=["r", "score", "sid", "x"])
        top = rows.mapInPandas(run, best_schema).groupBy("r").agg(F.max_by("x", F.struct("score", "sid")).alias("x"))
        return {row["r"]: row["x"] for row in top.collect()}

    centres = None
    for step in range(k):
        found = starts(step, centres)
        if not found:
            return rows.select("sid", F.lit(0).cast("bigint").alias("group_id")), 0.0
        new = np.array([found[r] for r in range(restarts)])[:, None, :]
        centres = new if centres is None else np.concatenate([centres, new], 1)

    def sums(centres):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, count, cost = np.zeros(centres.shape), np.zeros(centres.shape[:2]), np.zeros(centres.shape[:2])
            for pdf in it:
                if len(pdf):
                    x = np.stack(pdf["x"].to_numpy())
                    for r in range(restarts):
                        d = nearest(x, centres[r])
                        at = d.argmin(1)
                        np.add.at(total[r], at, x)
                        np.add.at(count[r], at, 1)
                        np.add.at(cost[r], at, d.min(1))
            yield pd.DataFrame([(r, c, count[r, c], cost[r, c], total[r, c].tolist()) for r in range(restarts)
                                for c in range(k)], columns=["r", "c", "n", "cost", "total"])
        parts = rows.mapInPandas(run, "r int, c int, n double, cost double, total array<double>")
        each = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(len(cols))]
        return parts.groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *each).collect()   # a row a centre

    for _ in range(most):
        moved, cost = centres.copy(), np.zeros(restarts)
        for row in sums(centres):
            cost[row["r"]] += row["cost"]
            if row["n"]:
                moved[row["r"], row["c"]] = [row[f"s{i}"] / row["n"] for i in range(len(cols))]
        if np.abs(moved - centres).max() <= 1e-12:
            break
        centres = moved
    win = int(cost.argmin())
    final = centres[win]

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = nearest(np.stack(pdf["x"].to_numpy()), final).argmin(1) if len(pdf) else []
            yield pd.DataFrame({"sid": pdf["sid"], "group_id": np.array(at, np.int64)})

    return stored(rows.mapInPandas(assign, "sid string, group_id bigint"), "kmeans"), float(cost[win])


def group_representative(groups: DataFrame, key: str = "group_id") -> DataFrame:
    """C4: lowest-ordered member of every non-empty group."""
    return groups.groupBy(key).agg(F.min("sid").alias("representative"),
                                   F.count(F.lit(1)).cast("bigint").alias("n_members"))


def group_sizes(groups: DataFrame, key: str = "group_id") -> DataFrame:
    """A16."""
    return groups.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("n_members"))


def group_members(groups: DataFrame, key: str = "group_id") -> DataFrame:
    """S5 table form: sorted member list per group, as text and array."""
    g = groups.groupBy(key).agg(F.array_sort(F.collect_list("sid")).alias("members"))
    return g.select(key, F.array_join("members", ",").alias("members"), F.size("members")
                    .cast("bigint").alias("n_members"))
