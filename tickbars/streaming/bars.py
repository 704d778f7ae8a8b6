"""Live bars in the engine's own window state: closed bars, open bars, roll-ups, closing by heartbeat.

State is bounded by the watermark, and so is patience: trades further behind the newest than ``delay`` are dropped. For
feeds that are to take trades however late, or in any order, see ``partials.LiveBars``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.functions import vwap
from tickbars.operators.bars import finish_bars, finish_quote_bars, quote_aggregates, rollup_aggregates, trade_aggregates

MAX_FILES = 64


def read_ticks(spark, path: str, schema, max_files: int = MAX_FILES) -> DataFrame:
    """A stream of Parquet files with a declared schema; un-zoned times become UTC instants.

    A micro-batch takes ``max_files`` files at most, so a long backlog is read in bounded steps.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    zoned = [f.name for f in stream.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else stream


def _windowed(trades: DataFrame, period_minutes: int, delay: str, *extra: Column) -> DataFrame:
    return trades.withWatermark("Timestamp", delay).groupBy("Symbol", F.window("Timestamp", f"{period_minutes} minutes").alias("w")) \
        .agg(*trade_aggregates(), *extra)


def _exposed(bars: DataFrame, period_minutes: int, others: tuple[str, ...] = ()) -> DataFrame:
    return finish_bars(bars.withColumn("Timestamp", F.col("w.start").cast("timestamp_ntz")), period_minutes, others)


def stream_bars(trades: DataFrame, period_minutes: int = 1, delay: str = "1 minute") -> DataFrame:
    """Trade bars over a stream.

    In append mode a bar comes out once, when the watermark passes its end; in update mode on every
    change. The watermark is that of the whole stream, so progress of any symbol closes the bars of all.
    """
    return _exposed(_windowed(trades, period_minutes, delay), period_minutes)


def stream_changed_bars(trades: DataFrame, period_minutes: int = 1, delay: str = "1 minute") -> DataFrame:
    """Bars with the times of the first and the last batch that touched them, for update mode.

    The time of a batch is kept in its log, so a batch that is run again gives the same values.
    """
    seen = trades.withColumn("_seen", F.current_timestamp())
    times = (F.min("_seen").alias("first_batch"), F.max("_seen").alias("last_batch"))
    return _exposed(_windowed(seen, period_minutes, delay, *times), period_minutes, ("first_batch", "last_batch"))


def stream_rollup(trades: DataFrame, period_minutes: int = 5, delay: str = "1 minute") -> DataFrame:
    """One-minute bars over a stream, rolled up again to longer bars; append mode."""
    ones = _windowed(trades, 1, delay).withColumn("Vwap", vwap(F.col("_pq"), F.col("Volume"))).drop("_pq")
    longer = ones.groupBy("Symbol", F.window("w", f"{period_minutes} minutes").alias("longer")).agg(*rollup_aggregates(F.col("w.start")))
    return _exposed(longer.withColumnRenamed("longer", "w"), period_minutes)


def stream_quote_bars(quotes: DataFrame, period_minutes: int = 1, delay: str = "1 minute") -> DataFrame:
    """Provisional bars over a stream of quotes, in append or update mode like ``stream_bars``.

    Clock rows, with nothing but a time, may be among the quotes: they move the watermark and make no bars.
    """
    windows = quotes.withWatermark("LpTime", delay).groupBy("Exchange", "Symbol", F.window("LpTime", f"{period_minutes} minutes").alias("w"))
    bars = windows.agg(*quote_aggregates(quotes)).filter(F.col("Volume").isNotNull())
    return finish_quote_bars(bars.withColumn("Timestamp", F.col("w.start").cast("timestamp_ntz")), period_minutes)


def with_heartbeats(trades: DataFrame, beats: DataFrame, time_col: str = "Timestamp") -> DataFrame:
    """Trades joined by clock rows that carry nothing but a time.

    They move the watermark on while every symbol is silent, so that bars still close; see
    ``closed_by_clock``.
    """
    return trades.unionByName(beats.select(F.col(time_col).cast("timestamp").alias("Timestamp")), allowMissingColumns=True)


def clock(spark, period: str = "60 seconds", time_col: str = "Timestamp") -> DataFrame:
    """Heartbeats from the clock, one row per second cut to one per period."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load() \
        .filter((F.unix_seconds("timestamp") % F.lit(int(period.split()[0]))) == 0).select(F.col("timestamp").alias(time_col))


def closed_by_clock(trades: DataFrame, beats: DataFrame, period_minutes: int = 1, delay: str = "1 minute") -> DataFrame:
    """Completed bars of a stream that also close while no trade arrives; clock rows make no bars.

    They are told apart by an aggregate. A filter on the symbol would be moved in front of the
    watermark and take the clock rows away before they could move it.
    """
    return stream_bars(with_heartbeats(trades, beats), period_minutes, delay).filter(F.col("Volume").isNotNull())
