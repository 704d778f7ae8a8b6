"""Live statistics of feeds: what each subscription handled, as a table that grows with its progress."""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickbars.operators.filters import filter_symbol
from tickbars.operators.latest import latest_by_key
from tickbars.session import exists
from tickbars.streaming.state import BatchFn, start

PARTS = ("added", "updated", "completed")
KEYS = ("provider", "schema", "symbol")
_MARK = "feed-stats"
_ROW = "provider STRING, schema STRING, symbol STRING, sampled_at STRING, buffered_rows BIGINT, " + ", ".join(f"{p} BIGINT" for p in PARTS)


class FeedMonitor(StreamingQueryListener):
    """Writes down the counts that subscriptions report with each batch, a folder per query and batch.

    Counts are observed while the rows go through the subscription's own stream, so they cost no job. A batch that is
    run again replaces its row.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._ended: set[str] = set()
        self._changed = threading.Condition()
        spark.streams.addListener(self)

    def subscribe(self, changes: DataFrame, provider: str, schema: str, symbol: str, callback: BatchFn, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
        """Deliver one symbol's rows of a change feed (column ``part``) to a callback, and count them."""
        counts = [F.count_if(F.col("part") == p).alias(p) for p in PARTS]
        own = filter_symbol(changes, symbol, "Symbol").observe("|".join((_MARK, provider, schema, symbol)), *counts)
        return start(own, callback, checkpoint, trigger=trigger)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, found in progress.observedMetrics.items():
            mark, *keys = name.split("|", 3)
            if mark == _MARK:
                row = (*keys, progress.timestamp, progress.numInputRows, *(found[p] or 0 for p in PARTS))
                self.spark.createDataFrame([row], _ROW).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={progress.id}/batch_id={progress.batchId}")

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.id))
            self._changed.notify_all()

    def close(self, ended: Iterable[StreamingQuery] = (), seconds: float = 60) -> None:
        """Stop listening, once what the given, ended queries reported has been written."""
        ids = {str(q.id) for q in ended}
        with self._changed:
            self._changed.wait_for(lambda: ids <= self._ended, timeout=seconds)
        self.spark.streams.removeListener(self)
        if not ids <= self._ended:
            raise TimeoutError("progress of some queries did not arrive")

    def history(self) -> DataFrame:
        """One row per subscription and batch."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{_ROW}, query STRING, batch_id BIGINT")
        return self.spark.read.schema(f"{_ROW}, query STRING, batch_id BIGINT").parquet(self.path)

    def latest(self) -> DataFrame:
        """The last batch and the totals of each stream, how many queries handle it, and all queries there are."""
        rows = self.history()
        last = latest_by_key(rows, KEYS, "batch_id", "query").select(*KEYS, "sampled_at", *[F.col(p).alias(f"last_{p}_rows") for p in PARTS])
        totals = rows.groupBy(*KEYS).agg(F.count_distinct("query").alias("subscriber_count"), *[F.sum(p).alias(f"total_{p}_rows") for p in PARTS])
        handles = rows.agg(F.count_distinct("query")).first()[0]
        return last.join(totals, list(KEYS)).withColumn("total_handles", F.lit(handles).cast("bigint"))
