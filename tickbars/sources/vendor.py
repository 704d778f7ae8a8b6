"""Vendor bars: local time to UTC, bars to ticks, ticks to table rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import instant_to_ns, ns_to_ntz, ntz

# Exchanges whose bars come in local time; every other exchange is in UTC.
EXCHANGE_ZONES = {"BMFBOVESPA": "America/Sao_Paulo"}

_VENDOR_COLS = ("exchange", "symbol", "datetime", "open", "high", "low", "close", "volume")


def local_to_utc(local: Column, zone: Column) -> Column:
    """Un-zoned local time to un-zoned UTC time.

    A local time skipped by a clock change moves forward to the first valid instant; one that
    occurs twice has no single meaning and gives null.
    """
    def utc(x: Column) -> Column:
        return F.to_utc_timestamp(x.cast("timestamp"), zone)

    def back(x: Column) -> Column:
        return F.from_utc_timestamp(x, zone)

    here = local.cast("timestamp")
    guess = utc(local)
    skipped = back(guess) != here
    hour = F.expr("INTERVAL '1' HOUR")
    twice = (back(guess - hour) == here) | (back(guess + hour) == here)
    # Inside a skipped hour the shown time runs ahead by the jump; the first valid instant is the
    # top of the hour that the clocks jump from, in standard time.
    forward = utc((F.date_trunc("hour", here) + hour).cast("timestamp_ntz"))
    return F.when(skipped, forward).when(~twice, guess).cast("timestamp_ntz")


def normalize_vendor_bars(bars: DataFrame, zones: dict[str, str] | None = None) -> DataFrame:
    """Vendor bars to UTC, with the volume column named as such; eight columns in fixed order."""
    zones = EXCHANGE_ZONES if zones is None else zones
    if "volume" not in bars.columns and "value" in bars.columns:
        bars = bars.withColumnRenamed("value", "volume")
    known = F.create_map(*[F.lit(x) for pair in zones.items() for x in pair]) if zones else None
    zone = F.coalesce(known[F.upper("exchange")], F.lit("UTC")) if zones else F.lit("UTC")
    local = F.col("datetime").cast("timestamp_ntz")
    return bars.withColumn("datetime", F.when(zone == "UTC", local).otherwise(local_to_utc(local, zone))) \
        .select(*_VENDOR_COLS)


def bars_to_ticks(bars: DataFrame, final_after: datetime | Column | None = None) -> DataFrame:
    """Vendor bars to ticks named ``EXCH:SYM``.

    All bars are final, or, given ``final_after``, those whose time is before it.
    """
    if final_after is None:
        final = F.lit(True)
    else:
        limit = final_after if isinstance(final_after, Column) else ntz(final_after)
        final = F.col("datetime") < limit
    named = F.concat_ws(":", F.nullif(F.col("exchange"), F.lit("")), F.col("symbol"))
    return bars.select(
        F.lit(schemas.QUOTE_PROVIDER).alias("provider"),
        F.lit(schemas.BARS).alias("stream"),
        named.alias("symbol"),
        instant_to_ns(F.col("datetime")).alias("ts_ns"),
        F.lit(None).cast("bigint").alias("seq"),
        F.struct("exchange", "symbol", "open", "high", "low", "close", "volume").alias("payload"),
        final.alias("is_final"),
    )


def flatten_bars(ticks: DataFrame) -> DataFrame:
    """Bar ticks to rows of the vendor bars table; the symbol is the one in the payload."""
    p = F.col("payload")
    return ticks.select(
        F.coalesce(p["exchange"], F.lit("")).alias("Exchange"),
        F.coalesce(p["symbol"], F.lit("")).alias("Symbol"),
        ns_to_ntz(F.col("ts_ns")).alias("Timestamp"),
        p["open"].alias("Open"),
        p["high"].alias("High"),
        p["low"].alias("Low"),
        p["close"].alias("Close"),
        p["volume"].alias("Volume"),
        F.col("is_final").alias("IsFinal"),
    )
