"""Raw trade messages to ticks, and trade ticks to table rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import ms_to_ns, ns_to_ntz, to_double, to_long, truthy


def _tick(symbol: Column, ts_ns: Column, seq: Column, payload: Column) -> list[Column]:
    return [
        F.lit(schemas.TRADE_PROVIDER).alias("provider"),
        F.lit(schemas.TRADES).alias("stream"),
        symbol.alias("symbol"),
        ts_ns.alias("ts_ns"),
        seq.alias("seq"),
        payload.alias("payload"),
        F.lit(True).alias("is_final"),
    ]


def _fields(text: Column, **keys: str) -> Column:
    """JSON keys as text fields under other names.

    The messages use keys that differ only in case (``t``, ``T``), which field access cannot tell
    apart; the cast renames fields by position.
    """
    parsed = F.from_json(text, ", ".join(f"`{key}` STRING" for key in keys.values()))
    return parsed.cast("struct<" + ", ".join(f"{name}: string" for name in keys) + ">")


def _flag(text: Column) -> Column:
    return F.coalesce(text.try_cast("boolean"), F.lit(False))


def parse_trade_json(raw: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Live trade messages, plain or wrapped in ``{"stream", "data"}``, to ticks; ``keep`` names columns that stay."""
    body = F.coalesce(F.get_json_object(column, "$.data"), F.col(column))
    m = F.col("m")
    payload = F.struct(
        to_double(m["price"]).alias("Price"),
        to_double(m["quantity"]).alias("Quantity"),
        F.coalesce(to_long(m["buyer"]), F.lit(0)).alias("BuyerID"),
        F.coalesce(to_long(m["seller"]), F.lit(0)).alias("SellerID"),
        _flag(m["maker"]).alias("IsBuyerMaker"),
    )
    fields = _fields(body, symbol="s", id="t", ms="T", price="p", quantity="q", buyer="b", seller="a", maker="m")
    return raw.select(*keep, fields.alias("m")) \
        .select(*keep, *_tick(m["symbol"], ms_to_ns(to_long(m["ms"])), to_long(m["id"]), payload))


def parse_trade_rest(raw: DataFrame, column: str = "value", symbol: str | None = None) -> DataFrame:
    """Trade rows from a request-reply source, with its alternative keys, to ticks.

    A key holding 0 or empty text counts as missing and the next alternative is tried; an id of 0 stays if no other is there.
    """
    m = F.col("m")

    def first_id(*names: str) -> Column:
        return F.coalesce(*[truthy(to_long(m[n]), 0) for n in names])

    def first_text(*names: str) -> Column:
        return F.coalesce(*[truthy(m[n], "") for n in names])

    payload = F.struct(
        F.coalesce(to_double(first_text("price", "price_short")), F.lit(0.0)).alias("Price"),
        F.coalesce(to_double(first_text("quantity", "quantity_short")), F.lit(0.0)).alias("Quantity"),
        F.coalesce(to_long(m["buyer"]), F.lit(0)).alias("BuyerID"),
        F.coalesce(to_long(m["seller"]), F.lit(0)).alias("SellerID"),
        (_flag(m["maker"]) | _flag(m["maker_short"])).alias("IsBuyerMaker"),
    )
    fields = _fields(F.col(column), id="id", id_long="tradeId", id_short="t", ms="time", ms_short="T", ms_long="tradeTime", ms_full="timestamp",
                     price="price", price_short="p", quantity="qty", quantity_short="q", maker="isBuyerMaker", maker_short="m",
                     symbol="symbol", symbol_short="s", buyer="b", seller="a")
    named = F.lit(symbol) if symbol else F.coalesce(first_text("symbol", "symbol_short"), F.lit(""))
    ts_ns = F.coalesce(ms_to_ns(first_id("ms", "ms_short", "ms_long", "ms_full")), F.lit(0))
    return raw.select(fields.alias("m")) \
        .select(*_tick(F.upper(named), ts_ns, F.coalesce(first_id("id", "id_long", "id_short"), to_long(m["id"])), payload))


def flatten_trades(ticks: DataFrame) -> DataFrame:
    """Trade ticks to rows of the trades table."""
    p = F.col("payload")
    at = ns_to_ntz(F.col("ts_ns"))
    return ticks.select(
        F.lit("trade").alias("EventType"),
        at.alias("EventTime"),
        F.col("symbol").alias("Symbol"),
        F.col("seq").alias("TradeID"),
        F.coalesce(p["Price"], F.lit(0.0)).alias("Price"),
        F.coalesce(p["Quantity"], F.lit(0.0)).alias("Quantity"),
        F.coalesce(p["BuyerID"], F.lit(0)).alias("BuyerID"),
        F.coalesce(p["SellerID"], F.lit(0)).alias("SellerID"),
        at.alias("Timestamp"),
        F.coalesce(p["IsBuyerMaker"], F.lit(False)).alias("IsBuyerMaker"),
    )
