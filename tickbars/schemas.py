"""Column sets, row types and provider names."""

from __future__ import annotations

from pyspark.sql import types as T

# Provider and stream names carried by every tick.
TRADE_PROVIDER = "binance"
QUOTE_PROVIDER = "tradingview"
TRADES = "trades"
QUOTES = "quotes"
BARS = "bars"

# Exposed columns of each table, in order.
TRADE_TABLE_COLS = ("EventType", "EventTime", "Symbol", "TradeID", "Price", "Quantity",
                    "BuyerID", "SellerID", "Timestamp", "IsBuyerMaker")
TRADE_COLS = ("Timestamp", "Symbol", "TradeID", "Price", "Quantity", "BuyerID", "SellerID",
              "IsBuyerMaker")
TRADE_BAR_COLS = ("Timestamp", "Symbol", "BarId", "Open", "High", "Low", "Close", "Volume",
                  "Trades", "Vwap", "BuyerMakerCount")
TRADE_BAR_FILLED_COLS = TRADE_BAR_COLS + ("IsEmpty",)
QUOTE_TABLE_COLS = ("Exchange", "Symbol", "LpTime", "LastPrice", "Bid", "Ask", "Volume", "Change",
                    "ChangePct", "VolDelta")
QUOTE_COLS = ("LpTime", "Symbol", "LastPrice", "Bid", "Ask", "Volume", "Change", "ChangePct",
              "VolDelta")
VENDOR_BAR_COLS = ("Exchange", "Symbol", "Timestamp", "Open", "High", "Low", "Close", "Volume",
                   "IsFinal")
UNIFIED_BAR_COLS = ("Timestamp", "Exchange", "Symbol", "BarId", "Open", "High", "Low", "Close",
                    "Volume", "IsFinal")
UNIFIED_BAR_FILLED_COLS = UNIFIED_BAR_COLS + ("IsEmpty",)
TICK_COLS = ("provider", "stream", "symbol", "ts_ns", "seq", "payload", "is_final")

QUOTE_UPDATE = ("STRUCT<n: STRING, v: STRUCT<lp: STRING, bid: STRING, ask: STRING, volume: STRING, "
                "ch: STRING, chp: STRING, lp_time: STRING>>")

TRADE_PAYLOAD = "Price DOUBLE, Quantity DOUBLE, BuyerID BIGINT, SellerID BIGINT, IsBuyerMaker BOOLEAN"
QUOTE_PAYLOAD = ("exchange STRING, last_price DOUBLE, bid DOUBLE, ask DOUBLE, volume DOUBLE, "
                 "change DOUBLE, change_pct DOUBLE, vol_delta DOUBLE")
BAR_PAYLOAD = ("exchange STRING, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, "
               "close DOUBLE, volume DOUBLE")

FEED_SPEC = ("provider STRING, name STRING, symbols ARRAY<STRING>, streams ARRAY<STRING>, "
             "autostart BOOLEAN, extra MAP<STRING, STRING>")

EVENT_LOG = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("service", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("meta", T.StringType()),
    T.StructField("corr_id", T.StringType()),
    T.StructField("parent_corr_id", T.StringType()),
])

# Wire format.
ENVELOPE_VERSION = 1
MIN_ENVELOPE_VERSION = 1
MAX_TESTED_ENVELOPE_VERSION = 1
PROTOCOL_ID = "tickbars.feed.envelope"
ROW_BAR = "bar"
ROW_TRADE = "trade"
WIRE_ROW = ("STRUCT<Timestamp: STRING, Ts: STRING, LpTime: STRING, Symbol: STRING, Exchange: STRING, "
            "Open: STRING, High: STRING, Low: STRING, Close: STRING, Volume: STRING, BarId: STRING, "
            "Res: STRING, Closed: BOOLEAN, Price: STRING, Quantity: STRING, TradeID: STRING, "
            "BuyerID: STRING, SellerID: STRING, IsBuyerMaker: BOOLEAN>")
WIRE_ENVELOPE = (
    "version INT, protocol STRING, phase STRING, part STRING, provider STRING, data_schema STRING, "
    f"symbol STRING, row_mode BOOLEAN, row_type STRING, rows ARRAY<{WIRE_ROW}>, "
    "watermark_ns BIGINT, meta STRUCT<seq: BIGINT, only_completed: BOOLEAN>"
)
