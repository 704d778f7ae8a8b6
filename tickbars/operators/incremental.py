"""Scheduled and corrective bar jobs: overlap ingest, recompute after late ticks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.operators.bars import trade_bars
from tickbars.operators.paging import newest_of_known, window_start
from tickbars.session import exists


def incremental_bars(fetched: DataFrame, watermarks: DataFrame, as_of: Column, keys: Sequence[str] = ("exchange", "symbol"), *,
                     days_back: int = 10, overlap: int = 5) -> DataFrame:
    """Bars one scheduled run emits: those in each symbol's window, then all on its first run, else those from its
    cursor on and the newest ``overlap`` ones, which replace their earlier versions downstream. However long
    a run is overdue, no bar between the cursor and now is left out."""
    inside = fetched.join(watermarks.select(*keys, "watermark"), list(keys), "left") \
        .filter(F.col("datetime").between(window_start(as_of, days_back, overlap), as_of))
    return newest_of_known(inside, F.col("watermark").isNotNull(), keys, "datetime", overlap, since="watermark").select(*fetched.columns)


def advance_watermarks(watermarks: DataFrame, emitted: DataFrame, keys: Sequence[str] = ("exchange", "symbol")) -> DataFrame:
    """Watermarks after a run: the newest emitted time, never moving back."""
    new = emitted.groupBy(*keys).agg(F.max("datetime").alias("watermark"))
    return watermarks.select(*keys, "watermark").unionByName(new).groupBy(*keys).agg(F.max("watermark").alias("watermark"))


def ingest_cycle(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], as_of: Column, out: str, cursors: str, run: int,
                 keys: Sequence[str] = ("exchange", "symbol"), **settings: int) -> None:
    """One scheduled run: load the cursors, fetch, write what is to be emitted, advance the cursors.

    ``fetch`` takes the cursors and gives bars. Both tables have a folder per run, so a run that failed half-way
    is repeated as a whole; the cursors of a run are those the next one starts from.
    """
    kinds = ", ".join(f"{k} STRING" for k in keys) + ", watermark TIMESTAMP_NTZ"
    before = f"{cursors}/run={run - 1}"
    marks = spark.read.parquet(before) if exists(spark, before) else spark.createDataFrame([], kinds)
    incremental_bars(fetch(marks), marks, as_of, keys, **settings).write.mode("overwrite").parquet(f"{out}/run={run}")
    advance_watermarks(marks, spark.read.parquet(f"{out}/run={run}"), keys).write.mode("overwrite").parquet(f"{cursors}/run={run}")


def reaggregate_late(bars: DataFrame, trades: DataFrame, late: DataFrame) -> DataFrame:
    """Stored bars after late trades: the (symbol, day) pairs they touch are computed anew.

    ``trades`` is the whole tick table, late rows included. Pairs not touched keep their stored bars.
    """
    def day(column: str) -> Column:
        return F.to_date(F.col(column)).alias("_day")

    touched = late.select("Symbol", day("Timestamp")).distinct()
    again = trades.withColumn("_day", day("Timestamp")).join(touched, ["Symbol", "_day"], "left_semi").drop("_day")
    kept = bars.withColumn("_day", day("Timestamp")).join(touched, ["Symbol", "_day"], "left_anti").drop("_day")
    return kept.select(*bars.columns).unionByName(trade_bars(again).select(*bars.columns))
