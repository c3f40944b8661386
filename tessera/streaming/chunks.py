"""Incremental panel build with Structured Streaming (U1 in streaming form).

The reference reads its input in chunks and concatenates them; here new
event files are picked up as micro-batches (``maxFilesPerTrigger``), hourly
cells are kept as streaming aggregation state per (event hour, series), and
every batch writes the cells that it changed to a folder of its own, named by
the batch, with ``foreachBatch`` (idempotent per batch id, restartable from the
checkpoint in the shared folder). No written cell is ever rewritten, so a
reader never meets half a table; it takes the latest value of each cell. The
state is bounded by series x hours, never by raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table_path


def stream_hourly_cells(spark: SparkSession, base: str, sink: str | None = None,
                        checkpoint: str | None = None, files_per_trigger: int = 1) -> str:
    """Run the stream until the available files are consumed; returns the
    path of the changed cells (hour, sid, v) by batch (``read_cells``)."""
    src_path = table_path(base, "events")
    schema = spark.read.parquet(src_path).schema
    sink = sink or scratch_path(spark, "stream_hourly_cells")
    checkpoint = checkpoint or scratch_path(spark, "stream_hourly_cells_ckpt")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if not src_path.endswith("/") and "." in src_path.rsplit("/", 1)[-1]:
        # a single-file table: stream its folder, restricted to the file name
        folder, name = src_path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
        src_path = folder
    events = reader.parquet(src_path)
    cells = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("sid")).agg(
        F.sum("value").alias("v"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = (cells.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(hour, sid, v): the latest value of every cell."""
    changed = spark.read.parquet(path)
    return changed.groupBy("hour", "sid").agg(F.max_by("v", "batch").alias("v"))


def cells_to_panel(spark: SparkSession, path: str) -> DataFrame:
    """(sid, t, v) with t = hours since the first hour of the stream."""
    cells = read_cells(spark, path)
    origin = cells.select(F.min("hour")).scalar()
    return cells.select("sid", F.timestamp_diff("HOUR", origin, F.col("hour")).cast("bigint").alias("t"), "v")



