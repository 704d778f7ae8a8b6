"""Time bins and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.functions import minutes


def _recent(as_of: Column, period_minutes: int, bars_back: int) -> tuple[Column, Column]:
    """Epoch seconds of the first and the last of the ``bars_back`` bins that end with ``as_of``."""
    if period_minutes <= 0:
        raise ValueError("period_minutes must be positive")
    if bars_back <= 0:
        raise ValueError("bars_back must be positive")
    step = period_minutes * 60
    last = F.floor(F.unix_micros(as_of.cast("timestamp")) / F.lit(step * 1_000_000)) * F.lit(step)
    return last - F.lit((bars_back - 1) * step), last


def _instant(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def bins_recent(spark: SparkSession, as_of: Column, period_minutes: int, bars_back: int = 2) -> DataFrame:
    """The current bin and the ones before it, one row each."""
    return symbol_grid(spark.range(1), as_of, period_minutes, bars_back).select("Timestamp")


def bins_range(spans: DataFrame, period_minutes: int, first: str = "first_bin", last: str = "last_bin") -> DataFrame:
    """Every bin of each row's span, both ends included.

    Expands by day and then within the day, so no array grows with the length of the span.
    """
    day_start, day_end = F.col("_day"), F.col("_day") + F.expr("INTERVAL '1' DAY") - minutes(period_minutes)
    others = [c for c in spans.columns if c not in (first, last)]
    days = spans.withColumn("_day", F.explode(F.sequence(_day_of(first), _day_of(last), F.expr("INTERVAL '1' DAY"))))
    within = F.sequence(F.greatest(F.col(first), day_start), F.least(F.col(last), day_end), minutes(period_minutes))
    return days.select(*others, F.explode(within).alias("Timestamp"))


def _day_of(column: str) -> Column:
    return F.date_trunc("day", F.col(column)).cast("timestamp_ntz")


def symbol_grid(symbols: DataFrame, as_of: Column, period_minutes: int, bars_back: int = 2) -> DataFrame:
    """Every key with every recent bin: each key row is expanded in place, without a join."""
    first, last = _recent(as_of, period_minutes, bars_back)
    return symbols.withColumn("_s", F.explode(F.sequence(first, last, F.lit(period_minutes * 60)))) \
        .withColumn("Timestamp", _instant(F.col("_s"))).drop("_s")


def active_keys(bars: DataFrame, as_of: Column, keys: Sequence[str]) -> DataFrame:
    """Keys with a bar since the start of the UTC day of ``as_of``."""
    return bars.filter(F.col("Timestamp") >= day_start_of(as_of)).select(*keys).distinct()


def day_start_of(as_of: Column) -> Column:
    return F.date_trunc("day", as_of.cast("timestamp")).cast("timestamp_ntz")


def spine_start(as_of: Column, period_minutes: int, bars_back: int = 2) -> Column:
    """Earliest instant that filling at ``as_of`` can need: day start or first bin, if earlier."""
    return F.least(day_start_of(as_of), _instant(_recent(as_of, period_minutes, bars_back)[0]))


def natural_join(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Left outer equi-join that appends the right columns; the right side has one row per key."""
    picked = right if columns is None else right.select(*on, *columns)
    return left.join(picked, list(on), "left")


def fill_bars(bars: DataFrame, as_of: Column, period_minutes: int, keys: Sequence[str] = ("Symbol",),
              bars_back: int = 2) -> DataFrame:
    """Recent bins of the active keys with their bars; ``IsEmpty`` marks bins without one.

    Only bars from the needed start on are read: the filter on the bar time reaches the scan.
    """
    recent = bars.filter(F.col("Timestamp") >= spine_start(as_of, period_minutes, bars_back))
    grid = symbol_grid(active_keys(recent, as_of, keys), as_of, period_minutes, bars_back)
    filled = natural_join(grid, recent, [*keys, "Timestamp"])
    return filled.withColumn("IsEmpty", F.col("Volume").isNull()).select(*bars.columns, "IsEmpty")


def fill_history(bars: DataFrame, period_minutes: int, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """Every bin from the first to the last bar of each key, with ``IsEmpty`` for those without one."""
    spans = bars.groupBy(*keys).agg(F.min("Timestamp").alias("first_bin"), F.max("Timestamp").alias("last_bin"))
    filled = natural_join(bins_range(spans, period_minutes), bars, [*keys, "Timestamp"])
    return filled.withColumn("IsEmpty", F.col("Volume").isNull()).select(*bars.columns, "IsEmpty")


def empty_bars(filled: DataFrame, keys: Sequence[str] = ("Symbol",)) -> DataFrame:
    """Bins without a bar."""
    return filled.filter("IsEmpty").select(*keys, "Timestamp", "IsEmpty")


def union_bins(*bins: DataFrame) -> DataFrame:
    """Distinct bins of several bin tables."""
    merged = bins[0]
    for more in bins[1:]:
        merged = merged.unionByName(more)
    return merged.distinct()
