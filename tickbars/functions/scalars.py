"""Column functions over numbers, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["vwap", "price_volume", "to_double", "to_long", "truthy", "split_exchange_symbol", "stream_key",
           "schema_resolution", "part_to_phase", "natural_key", "meta_to_json", "payload_or_raw",
           "PHASE_OF_PART"]

# Phase reported for each part of a feed; anything else is an update.
PHASE_OF_PART = {
    "added": "open",
    "updated": "update",
    "completed": "close",
    "snapshot": "snapshot",
    "trade": "trade",
}


def vwap(price_qty: Column, volume: Column) -> Column:
    """Volume-weighted price; null without volume."""
    return F.when(volume != 0, price_qty / volume)


def price_volume(vwap_col: Column, volume: Column) -> Column:
    """Price times volume of a bar, rebuilt from its average price; 0 without volume."""
    return F.when(volume == 0, F.lit(0.0)).otherwise(vwap_col * volume)


def to_double(x: Column) -> Column:
    return x.try_cast("double")


def to_long(x: Column) -> Column:
    """Whole number, or a decimal text cut to its whole part; null if not a number."""
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def truthy(x: Column, zero) -> Column:
    """``x`` unless it is null or the empty value of its type."""
    return F.nullif(x, F.lit(zero))


def split_exchange_symbol(raw: Column) -> tuple[Column, Column]:
    """``EXCH:SYM`` to (EXCH, SYM); without a colon the exchange is null."""
    text = F.upper(F.trim(raw))
    parts = F.split(text, ":", 2)
    has_exchange = F.size(parts) == 2
    return F.when(has_exchange, parts[0]), F.when(has_exchange, parts[1]).otherwise(text)


def stream_key(provider: Column, schema: Column, symbol: Column, exchange: Column | None = None) -> Column:
    """``provider|schema|symbol`` with ``@EXCH`` appended when there is an exchange."""
    base = F.concat_ws("|", provider, schema, symbol)
    if exchange is None:
        return base
    return F.concat(base, F.coalesce(F.concat(F.lit("@"), F.nullif(F.upper(exchange), F.lit(""))), F.lit("")))


def schema_resolution(schema: Column) -> Column:
    """``ohlcv_5m`` to ``5m``; null for other schemas."""
    return F.nullif(F.regexp_extract(schema, "ohlcv_(.*)", 1), F.lit(""))


def part_to_phase(part: Column) -> Column:
    phases = F.create_map(*[F.lit(x) for pair in PHASE_OF_PART.items() for x in pair])
    return F.coalesce(phases[part], F.lit("update"))


def natural_key(seq: Column, ts_ns: Column) -> Column:
    """Last field of the natural key: the sequence id, or the instant of a tick without one."""
    return F.coalesce(seq, ts_ns)


def meta_to_json(*fields: Column) -> Column:
    """Fields as one compact JSON text; instants are written as ISO text."""
    return F.to_json(F.struct(*fields), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                                         "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                                         "ignoreNullFields": "false"})


def payload_or_raw(text: Column) -> Column:
    """JSON text as it is; anything else wrapped as ``{"raw": ...}``; null as ``{}``."""
    is_json = F.try_parse_json(text).isNotNull()
    return F.when(text.isNull(), F.lit("{}")).when(is_json, text) \
        .otherwise(F.to_json(F.struct(text.alias("raw"))))
