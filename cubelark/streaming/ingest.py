"""Observations from a stream into a layer table.

Queries stay batch queries; what streams is the table they read.  Each
micro-batch is aggregated to cells and written under its own number, so a batch
that is run again after a failure replaces its files instead of doubling them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(observations: DataFrame, to_cells: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing cells (time, y, x, layers) of a streaming frame to a Parquet table, one folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        to_cells(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def layer_table(spark: SparkSession, path: str) -> DataFrame:
    """The ingested table; of cells that several batches have, the later batch counts."""
    frame = spark.read.parquet(path)
    layers = [c for c in frame.columns if c not in ("time", "y", "x", "batch")]
    return frame.groupBy("time", "y", "x").agg(*[F.max_by(c, "batch").alias(c) for c in layers])
