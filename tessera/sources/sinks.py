"""Sinks (S4-S7): report tables and model artefacts.

Everything is written under the shared checkpoint folder (or a caller path)
with ``mode("overwrite")`` so a re-run after a lost executor or a failed job
replaces partial output instead of appending to it.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def write_table(df: DataFrame, spark: SparkSession, name: str, path: str | None = None,
                fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write one report table; returns its path."""
    path = path or scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_reports(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """One table per report (selected features, metric summary, ...)."""
    return {k: write_table(v, spark, k, os.path.join(root, k)) for k, v in tables.items()}


def save_model(spark: SparkSession, root: str, tables: dict[str, DataFrame], config: dict) -> str:
    """The model table and side tables (scaler, weights, selection, groups)
    as Parquet, the configuration as JSON."""
    for k, v in tables.items():
        v.write.mode("overwrite").parquet(os.path.join(root, "tables", k))
    cfg = spark.createDataFrame([(json.dumps(config, default=str),)], "config string")
    cfg.write.mode("overwrite").json(os.path.join(root, "config"))
    return root


def load_config(spark: SparkSession, root: str) -> dict:
    """The configuration saved beside a model."""
    return json.loads(spark.read.schema("config string").json(os.path.join(root, "config")).head()[0])
