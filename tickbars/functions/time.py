"""Column functions over instants: buckets, bar numbers, epoch conversion, ordering keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["time_bucket", "bar_window", "day_floor", "bar_id", "event_order", "epoch_us", "ntz", "us_to_ntz", "ns_to_ntz",
           "ms_to_ns", "s_to_ns", "instant_to_ns", "parse_instant", "iso_utc", "minutes"]

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def minutes(n: int) -> Column:
    """Interval of ``n`` minutes."""
    return F.expr(f"INTERVAL '{int(n)}' MINUTE")


def time_bucket(ts: Column, period_minutes: int) -> Column:
    """Start of the UTC period holding ``ts``, un-zoned."""
    period = F.lit(int(period_minutes) * 60_000_000)
    us = epoch_us(ts)
    return us_to_ntz(us - F.pmod(us, period))


def bar_window(ts: Column, period_minutes: int) -> Column:
    """Start of the period as a grouping key; keeps the type of ``ts``; one such key per grouping."""
    return F.window(ts, f"{int(period_minutes)} minutes").getField("start")


def day_floor(ts: Column) -> Column:
    """Start of the UTC day holding ``ts``, un-zoned."""
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def bar_id(ts: Column, period_minutes: int) -> Column:
    """Number of a bar within its UTC day."""
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    return F.floor(minute_of_day / F.lit(int(period_minutes))).cast("bigint")


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch, of a zoned or an un-zoned timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def ntz(value: datetime) -> Column:
    """An un-zoned literal, free of the zone of the machine that builds the plan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def us_to_ntz(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ns_to_ntz(ns: Column) -> Column:
    """Un-zoned UTC timestamp of a nanosecond epoch; sub-microsecond digits are dropped."""
    return us_to_ntz(F.floor(ns.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("bigint"))


def ms_to_ns(ms: Column) -> Column:
    return ms * F.lit(1_000_000)


def s_to_ns(seconds: Column) -> Column:
    """Seconds, possibly fractional or text, to nanoseconds; null if not a number."""
    return (seconds.try_cast("double") * F.lit(1e9)).cast("bigint")


def instant_to_ns(ts: Column) -> Column:
    return epoch_us(ts) * F.lit(1000)


def parse_instant(value: Column) -> Column:
    """Text holding a number (nanoseconds above 1e13, else seconds) or ISO time; null if neither."""
    number = value.try_cast("double")
    as_number = F.when(number > F.lit(1e13), F.floor(value.try_cast("decimal(20,0)") / F.lit(1000)).cast("bigint")) \
        .otherwise((number * F.lit(1e6)).cast("bigint"))
    as_iso = F.unix_micros(F.try_to_timestamp(value))
    return us_to_ntz(F.when(number.isNotNull(), as_number).otherwise(as_iso))


def iso_utc(ts: Column) -> Column:
    """ISO text ending in Z; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", F.concat(whole, F.lit("Z"))) \
        .otherwise(F.concat(whole, F.lit("."), fraction, F.lit("Z")))


def event_order(ts: Column, tiebreak: Column) -> Column:
    """One sortable value for (instant, id).

    A decimal rather than a struct: aggregation buffers of fixed width keep min_by and max_by in a
    hash aggregate, while a struct buffer would sort the whole input first. The factor leaves room
    for every 64-bit id.
    """
    factor = F.lit("20000000000000000000").cast("decimal(20,0)")
    return epoch_us(ts).cast("decimal(18,0)") * factor + tiebreak.cast("decimal(19,0)")
