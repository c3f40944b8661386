"""Dimensionality reduction of the wide inputs (R1) and explained variance.

Up to ``GRAM_WIDTH`` columns, ``computeSVD`` runs on an ``IndexedRowMatrix``
keyed by ``t``; its p x p Gram matrix is then a bounded array on the driver.
Wider inputs take a seeded randomized range finder (Halko, Martinsson & Tropp,
2011), as the reference's randomized solver does: sketches X'(X W) are sums over
tasks, orthogonalised by QR between passes, and only p x (k + OVERSAMPLE)
arrays exist. The scores X.V are computed distributed, with V of width x k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GRAM_WIDTH = 2048
OVERSAMPLE = 10
PASSES = 6
SEED = 42


def _passed(src: DataFrame, x: str, w: np.ndarray) -> np.ndarray:
    """X'(X w): summed over a task's rows, then over tasks in blocks of columns."""
    shared = src.sparkSession.sparkContext.broadcast(w)
    width, step = w.shape[0], 256

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shared.value.shape)
        for pdf in it:
            if len(pdf):
                rows = np.stack(pdf["x"].to_numpy())
                total += rows.T @ (rows @ shared.value)
        yield pd.DataFrame({"at": range(0, width, step), "part": [total[i:i + step].tobytes() for i in range(0, width, step)]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "part": [sum(np.frombuffer(b, np.float64) for b in pdf["part"]).tobytes()]})

    schema = "at int, part binary"
    rows = src.select(F.col(x).alias("x")).mapInPandas(run, schema).groupBy("at").applyInPandas(add, schema).collect()
    return np.concatenate([np.frombuffer(r["part"], np.float64).reshape(-1, w.shape[1]) for r in sorted(rows)])  # width x (k + 10)


def randomized_basis(src: DataFrame, k: int, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """V (p x k) and singular values, by subspace iteration from a seeded start."""
    width = src.select(F.size(x).alias("p")).first()["p"]
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, min(width, k + OVERSAMPLE))))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(_passed(src, x, q))[0]
    values, turn = np.linalg.eigh(q.T @ _passed(src, x, q))
    order = np.argsort(values)[::-1][:k]
    return q @ turn[:, order], np.sqrt(np.maximum(values[order], 0.0))


def n_components(n_rows: int, width: int, configured: int = 300) -> int:
    """k = min(configured, n - 1, p)."""
    return max(1, min(configured, n_rows - 1, width))


def svd_reduce(inputs: DataFrame, k: int, x: str = "x", rows=None, gram_width: int = GRAM_WIDTH):
    """Rank-k SVD of the (already scaled) inputs. Returns
    (scores DataFrame (t, x ARRAY<DOUBLE> of length k), singular values).
    ``rows`` restricts the rows that V is fitted on; all rows get scores.
    Rows stay in the JVM: the matrix is made from a vector column, and the
    scores are one expression over V, a one-row table of k arrays."""
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.mllib.util import MLUtils

    spark = inputs.sparkSession
    src = inputs if rows is None else inputs.filter(rows)
    width = src.select(F.size(x).alias("p")).first()
    if width is not None and width["p"] > gram_width:
        basis, values = randomized_basis(src, k, x)
    else:
        matrix = src.select(F.col("t").cast("long").alias("index"), array_to_vector(x).alias("vector"))
        svd = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(matrix, "vector")).computeSVD(k, computeU=False)
        basis, values = svd.V.toArray(), svd.s.toArray()
    v = spark.createDataFrame([(basis.T.tolist(),)], "v array<array<double>>").select("v").scalar()
    dot = lambda c: F.aggregate(F.zip_with(F.col(x), c, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    scores = inputs.withColumn("_v", v).select(F.col("t").cast("long").alias("t"), F.transform("_v", dot).alias("x"))
    return scores, [float(s) for s in values]


def explained_variance(scores: DataFrame, inputs: DataFrame, x: str = "x") -> DataFrame:
    """Sum of component variances over the total input variance (ddof 0)."""
    comp = scores.select(F.posexplode(x).alias("j", "v")).groupBy("j").agg(F.var_pop("v").alias("var"))
    tot = inputs.select(F.posexplode(x).alias("j", "v")).groupBy("j").agg(F.var_pop("v").alias("var"))
    total = tot.select(F.sum("var")).scalar()
    return comp.agg((F.sum("var") / total).alias("explained_variance"),
                    F.count(F.lit(1)).cast("bigint").alias("n_components"))
