"""Wire format: row shapes, envelopes as JSON text, and reading them back."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import iso_utc, parse_instant, part_to_phase, schema_resolution, stream_key, to_double, to_long
from tickbars.operators.ordered import numbered

ROWS_PER_ENVELOPE = 5000
_BAR_FIELDS = ("Exchange", "BarId", "Open", "High", "Low", "Close", "Volume")
_TRADE_FIELDS = ("Exchange", "TradeID", "Price", "Quantity", "BuyerID", "SellerID", "IsBuyerMaker")
_QUOTE_FIELDS = ("Exchange", "LastPrice", "Bid", "Ask", "Volume", "Change", "ChangePct", "VolDelta")
# Order of phases and parts within a stream.
_PHASES = ("snapshot", "snapshot_boundary", "live")
_PARTS = ("added", "updated", "completed")


def _as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _shape(df: DataFrame, kind: str, part: Column, provider: Column, time_col: str, names: Sequence[str],
           fields: Iterable[str] | None, *tail: Column) -> DataFrame:
    wanted = None if fields is None else set(fields)
    body = [(F.col(n) if n in df.columns else F.lit(None)).alias(n) for n in names if wanted is None or n in wanted]
    return df.select(F.lit(kind).alias("Type"), part_to_phase(part).alias("Phase"), provider.alias("Provider"), F.col("Symbol"),
                     iso_utc(F.col(time_col)).alias("Timestamp"), *body, *tail)


def shape_bar_row(bars: DataFrame, provider: Column | str, schema: Column | str, part: Column | str,
                  fields: Iterable[str] | None = None, closed: Column | None = None) -> DataFrame:
    """Bars as wire rows.

    ``closed`` says which bars are over; without it every completed or snapshot row counts as closed.
    """
    part, schema = _as_column(part), _as_column(schema)
    over = part.isin("completed", "snapshot") if closed is None else closed
    return _shape(bars, "bar", part, _as_column(provider), "Timestamp", _BAR_FIELDS, fields,
                  schema_resolution(schema).alias("Res"), over.alias("Closed"))


def shape_trade_row(trades: DataFrame, provider: Column | str, part: Column | str, fields: Iterable[str] | None = None) -> DataFrame:
    """Trades as wire rows."""
    return _shape(trades, "trade", _as_column(part), _as_column(provider), "Timestamp", _TRADE_FIELDS, fields)


def shape_quote_row(quotes: DataFrame, provider: Column | str, part: Column | str, fields: Iterable[str] | None = None) -> DataFrame:
    """Quotes as wire rows of their own, with the quote's time and prices."""
    return _shape(quotes, "quote", _as_column(part), _as_column(provider), "LpTime", _QUOTE_FIELDS, fields)


def _position(column: str, names: Sequence[str]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(list(names)), F.col(column)).cast("int"), F.lit(0)), F.lit(len(names) + 1))


def wire_envelope(rows: DataFrame, order: str, *ties: str, row: str = "row", row_type: str, only_completed: bool = False,
                  fields: Sequence[str] = (), protocol: str = schemas.PROTOCOL_ID,
                  rows_per_envelope: int = ROWS_PER_ENVELOPE) -> DataFrame:
    """Feed rows to envelopes: one per (stream, phase, part) and at most ``rows_per_envelope`` rows.

    Input columns: provider, data_schema, symbol, phase, part, watermark_ns, the row as a struct, and
    ``order``, a whole number. A row whose ``order`` is null makes an envelope without rows (the
    boundary). ``rows_per_envelope=1`` gives one envelope per row. Sequence numbers run from 0
    per stream; they come from row counts per (stream, phase, part), so envelopes never gather in one
    task. Reads ``rows`` several times: pass a stored table.
    """
    stream = ("provider", "data_schema", "symbol")
    group = (*stream, "phase", "_part")
    keyed = rows.withColumn("_part", F.coalesce("part", F.lit("")))
    counts = keyed.groupBy(*group).agg(F.count(order).alias("_rows")) \
        .withColumn("_envelopes", F.greatest(F.ceil(F.col("_rows") / F.lit(rows_per_envelope)), F.lit(1)))
    within = Window.partitionBy(*stream).orderBy(_position("phase", _PHASES), _position("_part", _PARTS)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    first_seq = counts.select(*group, F.coalesce(F.sum("_envelopes").over(within), F.lit(0)).alias("_first_seq"))

    empty = F.col(order).isNull()
    placed = numbered(keyed.withColumn("_at", F.coalesce(order, F.lit(0))), group, "_at", *ties)
    chunk = F.floor((F.col("row_no") - 1) / F.lit(rows_per_envelope))
    placed_row = F.struct("row_no", F.col(row).alias("row"))
    packed = placed.groupBy(*group, chunk.alias("_chunk")).agg(
        F.max("watermark_ns").alias("watermark_ns"),
        F.sort_array(F.collect_list(F.when(~empty, placed_row))).alias("_rows"),
        F.count(order).alias("row_count"),
    )
    numbered_envelopes = packed.join(first_seq, list(group)).withColumn("seq", (F.col("_first_seq") + F.col("_chunk")).cast("bigint"))
    part = F.nullif(F.col("_part"), F.lit(""))
    message = F.struct(
        F.lit(schemas.ENVELOPE_VERSION).alias("version"), F.lit(protocol).alias("protocol"), F.col("phase"), part.alias("part"),
        *[F.col(c) for c in stream], F.lit(True).alias("row_mode"), F.lit(row_type).alias("row_type"),
        F.transform("_rows", lambda r: r["row"]).alias("rows"),
        F.when(F.col("phase") != "live", F.col("watermark_ns")).alias("watermark_ns"),
        F.struct("seq", F.lit(only_completed).alias("only_completed"), F.lit(list(fields)).cast("array<string>").alias("fields")).alias("meta"),
    )
    return numbered_envelopes.select(*stream, "phase", part.alias("part"), "seq", "row_count",
                                     F.to_json(message, {"ignoreNullFields": "false"}).alias("value"))


def parse_envelope(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelope texts to one row per header, with the row type settled and the rows as an array.

    Versions below the oldest known fail the job; newer ones than tested are marked ``untested``.
    """
    e = F.from_json(column, schemas.WIRE_ENVELOPE)
    version = F.coalesce("e.version", F.lit(1))
    too_old = F.raise_error(F.concat(F.lit("envelope version too old: "), version.cast("string")))
    by_schema = F.when(F.col("e.data_schema").startswith("ohlcv_"), schemas.ROW_BAR).otherwise(schemas.ROW_TRADE)
    return raw.select(e.alias("e")).select(
        F.when(version < schemas.MIN_ENVELOPE_VERSION, too_old.cast("int")).otherwise(version).alias("version"),
        (version > schemas.MAX_TESTED_ENVELOPE_VERSION).alias("untested"),
        F.coalesce("e.phase", F.lit("live")).alias("phase"),
        F.col("e.part").alias("part"),
        F.col("e.provider").alias("provider"),
        F.col("e.data_schema").alias("schema"),
        F.col("e.symbol").alias("symbol"),
        F.coalesce(F.nullif(F.col("e.row_type"), F.lit("")), by_schema).alias("row_type"),
        F.col("e.meta.seq").alias("seq"),
        F.col("e.watermark_ns").alias("watermark_ns"),
        F.col("e.rows").alias("rows"),
    )


def bar_rows(envelopes: DataFrame) -> DataFrame:
    """Typed bars of parsed envelopes."""
    r = F.col("r")
    return envelopes.filter(F.col("row_type") == schemas.ROW_BAR).select("provider", "phase", "part", "seq", F.explode("rows").alias("r")).select(
        "provider", "phase", "part", "seq",
        r["Symbol"].alias("symbol"),
        parse_instant(r["Timestamp"]).alias("timestamp"),
        *[to_double(r[c]).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
        r["Exchange"].alias("exchange"),
        to_long(r["BarId"]).alias("bar_id"),
        r["Res"].alias("res"),
        r["Closed"].alias("closed"),
    )


def trade_rows(envelopes: DataFrame) -> DataFrame:
    """Typed trades of parsed envelopes."""
    r = F.col("r")
    return envelopes.filter(F.col("row_type") == schemas.ROW_TRADE).select("provider", "phase", "part", "seq", F.explode("rows").alias("r")).select(
        "provider", "phase", "part", "seq",
        r["Symbol"].alias("symbol"),
        parse_instant(F.coalesce(r["Timestamp"], r["Ts"])).alias("timestamp"),
        to_double(r["Price"]).alias("price"),
        to_double(r["Quantity"]).alias("quantity"),
        r["TradeID"].alias("trade_id"),
        r["Exchange"].alias("exchange"),
        r["IsBuyerMaker"].alias("is_buyer_maker"),
        r["BuyerID"].alias("buyer_id"),
        r["SellerID"].alias("seller_id"),
    )


def with_stream_key(df: DataFrame, exchange: str | None = None) -> DataFrame:
    """Add the name of each row's stream."""
    ex = F.col(exchange) if exchange else None
    return df.withColumn("stream_key", stream_key(F.col("provider"), F.col("schema"), F.col("symbol"), ex))
