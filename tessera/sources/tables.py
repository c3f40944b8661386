"""Table readers (S1) and shape profile (S3).

Readers only name the file; column pruning and filter pushdown are left to
Catalyst, so a caller that selects two columns scans two columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(base: str, name: str) -> str:
    p = os.path.join(base, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in base else os.path.join(base, name)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(base, name))


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV of numeric columns. Files are split across tasks; no
    chunk loop. A declared schema avoids an inference pass over the data."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_wide_array(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """S1 for files of thousands of columns: header CSV of plain numbers as one
    array column ``x``, and the column names. One expression reads a line,
    however many columns it has; empty cells are NULL. The header line of each
    file is left out."""
    lines = spark.read.text(path)
    head = lines.first()
    names = head[0].split(",") if head else []
    cells = F.transform(F.split("value", ",", -1), lambda c: F.when(c != "", c.cast("double")))
    return lines.filter(F.col("value") != F.lit(head[0] if head else "")).select(cells.alias("x")), names


def wide_array_to_long(wide: DataFrame, names: list[str], order_by: str | None = None) -> DataFrame:
    """P1 for an array column: the long panel ``(sid, t, v)``; steps are rows in
    the order of the column ``order_by``, which is no series, or of the file."""
    at = names.index(order_by) if order_by is not None else None
    src = wide if at is None else wide.withColumn("_o", F.col("x")[at])
    keys = F.array(*[F.lit(n) for n in names])
    long = row_index(src, None if at is None else "_o").select("t", F.posexplode("x").alias("_i", "v"), keys.alias("_k"))
    return long.filter(F.col("_i") != (-1 if at is None else at)).select(F.col("_k")[F.col("_i")].alias("sid"), "t", "v")


def row_index(df: DataFrame, order_col: str | None = None, name: str = "t") -> DataFrame:
    """Dense 0-based row number without a one-partition sort.

    Rows are range-partitioned on ``order_col`` (or kept in input order when
    it is None, i.e. file order) and written once, each with its partition
    number and its place inside it. The running counts of the partitions are
    taken from that written table, so numbering and offsets always speak of
    the same physical rows, however adaptive execution coalesces partitions.
    """
    base = df
    if order_col is not None:
        base = df.repartitionByRange(order_col).sortWithinPartitions(order_col)
    tagged = stored(base.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)), "row_index")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    # offsets has one row per partition of the written table: a proven size bound for a broadcast
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(
        name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos")).cast("bigint"))
    return out.drop("_pid", "_pos", "_off")


def wide_to_long(df: DataFrame, columns: list[str], order_col: str | None = None) -> DataFrame:
    """S1 + S2 + P1: a wide table of numeric columns as the long panel
    ``(sid, t, v)``, rows numbered in ``order_col`` (or file) order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("sid"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return row_index(df, order_col).select("t", F.inline(pairs)).select("sid", "t", "v")


def shape_profile(panel: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """S3: rows, series and steps of a long panel (plus width of the inputs)."""
    prof = panel.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.countDistinct("sid").cast("bigint").alias("n_series"),
        F.countDistinct("t").cast("bigint").alias("n_steps"),
    )
    if inputs is not None:
        # scalar subqueries: each side is a one-row aggregate
        prof = prof.select(
            "*",
            inputs.select(F.count(F.lit(1)).cast("bigint")).scalar().alias("input_rows"),
            inputs.select(F.max(F.size("x")).cast("bigint")).scalar().alias("input_width"))
    return prof
