"""Wire rows and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import epoch_us, iso_utc
from tickbars.operators import wire
from tickbars.plans.bars import bars_1m, bars_5m
from tickbars.plans.quotes import quotes_table
from tickbars.plans.registry import Tables, query
from tickbars.session import materialized
from tickbars.sinks.tables import rows_to_ndjson

_ISO = """CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ') END"""


@query("shape_bar_row", "bars_5m", f"""
SELECT 'bar' AS Type, 'close' AS Phase, 'binance' AS Provider, Symbol, {_ISO.format(c='Timestamp')} AS Timestamp, BarId, Open, High, Low, Close, Volume,
       '5m' AS Res, lead(Timestamp) OVER (PARTITION BY Symbol ORDER BY Timestamp) IS NOT NULL AS Closed FROM bars_5m""")
def shape_bar_row(t: Tables) -> DataFrame:
    newest = t.view("trades").groupBy("Symbol").agg(F.max("Timestamp").alias("_last"))
    bars = bars_5m(t).join(newest, "Symbol")
    closed = F.col("_last") >= F.col("Timestamp") + F.expr("INTERVAL '5' MINUTE")
    return wire.shape_bar_row(bars, "binance", "ohlcv_5m", "completed", ["BarId", "Open", "High", "Low", "Close", "Volume"], closed)


@query("shape_trade_row", "trades", f"""
SELECT 'trade' AS Type, 'trade' AS Phase, 'binance' AS Provider, Symbol, {_ISO.format(c='Timestamp')} AS Timestamp, TradeID, Price, Quantity,
       BuyerID, SellerID, IsBuyerMaker FROM trades""")
def shape_trade_row(t: Tables) -> DataFrame:
    return wire.shape_trade_row(t.view("trades"), "binance", "trade", ["TradeID", "Price", "Quantity", "BuyerID", "SellerID", "IsBuyerMaker"])


@query("shape_quote_row", "quotes", f"""
SELECT 'quote' AS Type, 'open' AS Phase, 'tradingview' AS Provider, Symbol, {_ISO.format(c='LpTime')} AS Timestamp, Exchange, LastPrice, Bid, Ask,
       Volume, VolDelta FROM quotes""")
def shape_quote_row(t: Tables) -> DataFrame:
    return wire.shape_quote_row(quotes_table(t), "tradingview", "added", ["Exchange", "LastPrice", "Bid", "Ask", "Volume", "VolDelta"])


@query("rows_to_ndjson", "trades", f"""
SELECT '{{"Type":"trade","Phase":"snapshot","Provider":"binance","Symbol":"' || Symbol || '","Timestamp":"' || {_ISO.format(c='Timestamp')}
       || '","TradeID":' || CAST(TradeID AS VARCHAR) || ',"Price":' || CAST(Price AS VARCHAR) || '}}' AS value FROM trades""")
def ndjson(t: Tables) -> DataFrame:
    return rows_to_ndjson(wire.shape_trade_row(t.view("trades"), "binance", "snapshot", ["TradeID", "Price"]))


BOUNDARY_NS = 1_705_708_800_000_000_000
_ROWS = 1000


def _feed(t: Tables) -> DataFrame:
    """Bars before a boundary as snapshot rows, later ones as live rows, and a boundary per stream."""
    us = epoch_us(F.col("Timestamp"))
    snapshot = us * 1000 < BOUNDARY_NS
    rows = bars_1m(t).select(
        F.lit("binance").alias("provider"), F.lit("ohlcv_1m").alias("data_schema"), F.col("Symbol").alias("symbol"),
        F.when(snapshot, "snapshot").otherwise("live").alias("phase"), F.lit("completed").alias("part"),
        F.lit(BOUNDARY_NS).alias("watermark_ns"), us.alias("at"),
        F.struct(iso_utc(F.col("Timestamp")).alias("Timestamp"), "Symbol", "BarId", "Open", "High", "Low", "Close", "Volume").alias("row"))
    boundary = t.view("trades").select(F.col("Symbol").alias("symbol")).distinct().select(
        F.lit("binance").alias("provider"), F.lit("ohlcv_1m").alias("data_schema"), "symbol", F.lit("snapshot_boundary").alias("phase"),
        F.lit(BOUNDARY_NS).alias("watermark_ns"))
    return rows.unionByName(boundary, allowMissingColumns=True)


def envelopes(t: Tables) -> DataFrame:
    return wire.wire_envelope(materialized(_feed(t), "feed"), "at", row_type="bar", only_completed=True, rows_per_envelope=_ROWS)


_NUMBERED = f"""
SELECT symbol, phase, part, chunk, row_number() OVER (PARTITION BY symbol ORDER BY rank, chunk) - 1 AS seq, row_count, first_at FROM (
  SELECT Symbol AS symbol, CASE WHEN early THEN 'snapshot' ELSE 'live' END AS phase, 'completed' AS part, CASE WHEN early THEN 0 ELSE 2 END AS rank,
         (n - 1) // {_ROWS} AS chunk, count(*) AS row_count, strftime(min(Timestamp), '%Y-%m-%dT%H:%M:%SZ') AS first_at
  FROM (SELECT *, row_number() OVER (PARTITION BY Symbol, early ORDER BY Timestamp) AS n
        FROM (SELECT *, epoch_us(Timestamp) * 1000 < {BOUNDARY_NS} AS early FROM bars_1m))
  GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT DISTINCT Symbol, 'snapshot_boundary', CAST(NULL AS VARCHAR), 1, 0, 0, CAST(NULL AS VARCHAR) FROM bars_1m)"""


@query("wire_envelope", "bars_1m", f"""
SELECT 'binance' AS provider, 'ohlcv_1m' AS data_schema, symbol, phase, part, seq, row_count, first_at,
       CASE WHEN phase <> 'live' THEN {BOUNDARY_NS} END AS watermark_ns, 1 AS version FROM ({_NUMBERED})""")
def wire_envelope(t: Tables) -> DataFrame:
    value = F.col("value")
    return envelopes(t).select("provider", "data_schema", "symbol", "phase", "part", "seq", "row_count",
                               F.get_json_object(value, "$.rows[0].Timestamp").alias("first_at"),
                               F.get_json_object(value, "$.watermark_ns").cast("bigint").alias("watermark_ns"),
                               F.get_json_object(value, "$.version").cast("int").alias("version"))


@query("parse_envelope", "bars_1m", f"""
SELECT 'binance' AS provider, CASE WHEN epoch_us(Timestamp) * 1000 < {BOUNDARY_NS} THEN 'snapshot' ELSE 'live' END AS phase, 'completed' AS part,
       Symbol AS symbol, Timestamp AS timestamp, Open AS open, High AS high, Low AS low, Close AS close, Volume AS volume, BarId AS bar_id FROM bars_1m""")
def parse_envelope(t: Tables) -> DataFrame:
    return wire.bar_rows(wire.parse_envelope(envelopes(t))).drop("seq", "exchange", "res", "closed")
