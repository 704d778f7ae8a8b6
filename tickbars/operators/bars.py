"""Bars from trades and quotes, and bars from shorter bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import bar_id, bar_window, event_order, price_volume, time_bucket, vwap


def trade_aggregates() -> list[Column]:
    """Aggregates of a bar over trades; open and close follow event order (Timestamp, TradeID)."""
    order = event_order(F.col("Timestamp"), F.col("TradeID"))
    return [
        F.min_by("Price", order).alias("Open"),
        F.max("Price").alias("High"),
        F.min("Price").alias("Low"),
        F.max_by("Price", order).alias("Close"),
        F.sum("Quantity").alias("Volume"),
        F.count(F.lit(1)).alias("Trades"),
        F.sum(F.col("IsBuyerMaker").cast("int")).cast("bigint").alias("BuyerMakerCount"),
        F.sum(F.col("Price") * F.col("Quantity")).alias("_pq"),
    ]


def rollup_aggregates(at: Column) -> list[Column]:
    """Aggregates of a bar over shorter bars; the average price is rebuilt from price times volume."""
    return [
        F.min_by("Open", at).alias("Open"),
        F.max("High").alias("High"),
        F.min("Low").alias("Low"),
        F.max_by("Close", at).alias("Close"),
        F.sum("Volume").alias("Volume"),
        F.sum("Trades").alias("Trades"),
        F.sum("BuyerMakerCount").alias("BuyerMakerCount"),
        F.sum(price_volume(F.col("Vwap"), F.col("Volume"))).alias("_pq"),
    ]


def finish_bars(bars: DataFrame, period_minutes: int = 1, others: Sequence[str] = ()) -> DataFrame:
    """Aggregates to bars with the exposed columns."""
    return bars.withColumn("BarId", bar_id(F.col("Timestamp"), period_minutes)) \
        .withColumn("Vwap", vwap(F.col("_pq"), F.col("Volume"))) \
        .select(*schemas.TRADE_BAR_COLS, *others)


def trade_bars(trades: DataFrame, period_minutes: int = 1, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """Trades to bars per symbol and period.

    Bars of any length come straight from the trades. One shuffle on (keys, period), after a partial
    aggregate in each input task, so the rows of a hot symbol are folded before they move.
    ``rollup_trade_bars`` is for shorter bars that are already stored.
    """
    extra = [k for k in keys if k not in schemas.TRADE_BAR_COLS]
    bars = trades.groupBy(*keys, bar_window(F.col("Timestamp"), period_minutes).alias("_bar")).agg(*trade_aggregates())
    return finish_bars(bars.withColumnRenamed("_bar", "Timestamp"), period_minutes, extra)


def rollup_trade_bars(bars: DataFrame, period_minutes: int, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """Trade bars to longer trade bars."""
    at = F.col("Timestamp")
    extra = [k for k in keys if k not in schemas.TRADE_BAR_COLS]
    longer = bars.groupBy(*keys, bar_window(at, period_minutes).alias("_bar")).agg(*rollup_aggregates(at))
    return finish_bars(longer.withColumnRenamed("_bar", "Timestamp"), period_minutes, extra)


def quote_aggregates(quotes: DataFrame, tiebreak: str = "arrival") -> list[Column]:
    """Aggregates of a provisional bar over quotes."""
    order = event_order(F.col("LpTime"), F.col(tiebreak) if tiebreak in quotes.columns else F.lit(0))
    return [
        F.min_by("LastPrice", order).alias("Open"),
        F.max("LastPrice").alias("High"),
        F.min("LastPrice").alias("Low"),
        F.max_by("LastPrice", order).alias("Close"),
        F.sum("VolDelta").alias("Volume"),
    ]


def finish_quote_bars(bars: DataFrame, period_minutes: int = 1) -> DataFrame:
    """Aggregates to provisional bars with the exposed columns."""
    return bars.withColumn("BarId", bar_id(F.col("Timestamp"), period_minutes)) \
        .withColumn("IsFinal", F.lit(False)) \
        .select(*schemas.UNIFIED_BAR_COLS)


def quote_bars(quotes: DataFrame, period_minutes: int = 1, tiebreak: str = "arrival") -> DataFrame:
    """Quotes to provisional bars of the last price; volume is the sum of volume increments."""
    bars = quotes.groupBy("Exchange", "Symbol", bar_window(F.col("LpTime"), period_minutes).alias("Timestamp")).agg(*quote_aggregates(quotes, tiebreak))
    return finish_quote_bars(bars, period_minutes)


def rollup_unified_bars(bars: DataFrame, period_minutes: int) -> DataFrame:
    """Stitched bars to longer ones; final only when every part is."""
    at = F.col("Timestamp")
    longer = bars.groupBy("Exchange", "Symbol", bar_window(at, period_minutes).alias("_bar")).agg(
        F.min_by("Open", at).alias("Open"),
        F.max("High").alias("High"),
        F.min("Low").alias("Low"),
        F.max_by("Close", at).alias("Close"),
        F.sum("Volume").alias("Volume"),
        F.bool_and("IsFinal").alias("IsFinal"),
    )
    return longer.withColumnRenamed("_bar", "Timestamp") \
        .withColumn("BarId", bar_id(F.col("Timestamp"), period_minutes)) \
        .select(*schemas.UNIFIED_BAR_COLS)


def completed_bars(bars: DataFrame, keys: Sequence[str] = ("Symbol",), latest: DataFrame | None = None) -> DataFrame:
    """Bars with a later bar of the same key; the newest bar of each key is still open.

    Compares with the newest bar time, one row per key and made by a partial aggregate, instead of a
    window that would put all bars of a key in one task.
    """
    newest = bars.groupBy(*keys).agg(F.max("Timestamp").alias("_newest")) if latest is None else latest
    return bars.join(newest, list(keys)).filter(F.col("Timestamp") < F.col("_newest")).select(*bars.columns)


def newest_bar_time(ticks: DataFrame, time_col: str, period_minutes: int, keys: Sequence[str]) -> DataFrame:
    """Newest bar time per key, straight from the rows the bars are made of."""
    return ticks.groupBy(*keys).agg(F.max(time_col).alias("_last")) \
        .select(*keys, time_bucket(F.col("_last"), period_minutes).alias("_newest"))
