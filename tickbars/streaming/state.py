"""Running streams to tables, and small state tables kept beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickbars.session import remove

BatchFn = Callable[[DataFrame, int], None]


def start(stream: DataFrame, batch: BatchFn, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Start a stream with a batch function; by default it handles what is there and stops."""
    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def start_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a stream into a Parquet table, each row exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start(path)


def batch_writer(path: str, change: Callable[[DataFrame], DataFrame] | None = None) -> BatchFn:
    """Write each batch to its own ``batch_id=`` folder; a retry replaces it."""
    def write(rows: DataFrame, batch_id: int) -> None:
        (change(rows) if change else rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


class Versions:
    """A table written whole by every batch, read by the next.

    Batch ids are consecutive, and a retried batch reads the version before it again, so state after
    a failure is what it would have been without one.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return self.at(spark, batch_id - 1) if batch_id > 0 else None

    def at(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v={batch_id}")

    def write(self, state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        if batch_id >= 2:
            remove(state.sparkSession, f"{self.path}/v={batch_id - 2}")
