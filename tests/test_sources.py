"""Parsers on the sample messages and on edge cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickbars.sources import feeds, quotes, trades, vendor

SAMPLES = [
    {"stream": "fooqux@trade", "data": {"e": "trade", "E": 1700000000250, "s": "FOOQUX", "t": 900001, "p": "64.50000000", "q": "0.12500000", "T": 1700000000250, "m": True, "M": True}},
    {"stream": "fooqux@trade", "data": {"e": "trade", "E": 1700000000375, "s": "FOOQUX", "t": 900002, "p": "64.25000000", "q": "2.00000000", "T": 1700000000375, "m": True, "M": True}},
    {"e": "trade", "E": 1700000000500, "s": "BARQUX", "t": 77, "p": "3.75000000", "q": "8.00000000", "T": 1700000000500, "m": True, "M": True},
]


def raw(spark, *messages):
    return spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value STRING")


def test_live_trades(spark):
    rows = trades.parse_trade_json(raw(spark, *SAMPLES)).orderBy("seq").collect()
    assert [(r.symbol, r.seq, r.ts_ns) for r in rows] == [
        ("BARQUX", 77, 1700000000500000000), ("FOOQUX", 900001, 1700000000250000000), ("FOOQUX", 900002, 1700000000375000000)]
    assert rows[1].payload.Price == 64.5 and rows[1].payload.Quantity == 0.125
    assert rows[1].payload.BuyerID == 0 and rows[1].payload.IsBuyerMaker is True and rows[1].is_final is True


def test_live_trade_without_optional_fields(spark):
    r = trades.parse_trade_json(raw(spark, {"s": "X", "t": 1, "p": "1", "q": "2", "T": 5})).first()
    assert (r.payload.IsBuyerMaker, r.payload.SellerID, r.provider, r.stream) == (False, 0, "binance", "trades")


def test_rest_trades_take_the_first_non_empty_key(spark):
    rows = trades.parse_trade_rest(raw(
        spark,
        {"id": 7, "price": "1.5", "qty": "2", "time": 1000, "isBuyerMaker": True},
        {"id": 0, "tradeId": 8, "p": "2.5", "q": "3", "T": 2000, "m": True, "s": "abc"},
        {"t": 9}, {"id": 0, "s": "zero"}), symbol=None).orderBy("seq").collect()
    assert [(r.seq, r.ts_ns, r.symbol) for r in rows] == [(0, 0, "ZERO"), (7, 1_000_000_000, ""), (8, 2_000_000_000, "ABC"), (9, 0, "")]
    assert [(r.payload.Price, r.payload.Quantity, r.payload.IsBuyerMaker) for r in rows[1:]] == [(1.5, 2.0, True), (2.5, 3.0, True), (0.0, 0.0, False)]
    assert trades.parse_trade_rest(raw(spark, {"id": 1, "s": "x"}), symbol="btcusdt").first().symbol == "BTCUSDT"


def test_trade_rows_keep_buyer_and_seller(spark):
    r = trades.flatten_trades(trades.parse_trade_json(raw(spark, {**SAMPLES[2], "b": 11, "a": 12}))).first()
    assert (r.EventType, r.BuyerID, r.SellerID, r.TradeID) == ("trade", 11, 12, 77)
    assert r.Timestamp == r.EventTime == datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_frames(spark):
    texts = ["~m~2~m~{}~m~4~m~~h~1~m~x", "no frames", "~m~3~m~{x}~m~9~m~{\"a\": 1}", "~m~2~m~{}~m~2~m~[]"]
    rows = quotes.explode_frames(raw(spark, *texts).withColumn("n", F.monotonically_increasing_id() * 0)).collect()
    assert sorted(r.value for r in rows) == sorted(["{}", "{\"a\": 1}", "{}", "[]"])
    assert quotes.explode_frames(raw(spark, texts[0])).columns == ["value"]


def test_quote_messages(spark):
    msgs = [
        {"m": "qsd", "p": ["s", {"n": "NYSE:ibm", "v": {"lp": 10.5, "lp_time": 2}}]},
        {"m": "qsd", "p": ["s", [{"n": "x", "v": {"bid": "bad"}}, {"n": "", "v": {"lp": 1}}]]},
        {"m": "other", "p": ["s", {"n": "NYSE:ibm", "v": {"lp": 1}}]},
        {"m": "qsd", "p": ["s"]},
    ]
    rows = sorted(quotes.parse_quote_json(raw(spark, *msgs)).collect(), key=lambda r: r.sub_key)
    assert [(r.sub_key, r.exchange, r.symbol, r.lp, r.bid, r.lp_time_ns) for r in rows] == [
        ("NYSE:ibm", "NYSE", "IBM", 10.5, None, 2_000_000_000), ("x", None, "X", None, None, None)]


def test_clock_changes(spark):
    def bar(at, exchange="BMFBOVESPA"):
        return (exchange, "S", datetime.fromisoformat(at), 1.0, 1.0, 1.0, 1.0, 5.0)

    df = spark.createDataFrame([bar("2018-11-04 00:30"), bar("2018-02-17 23:30"), bar("2018-07-01 12:00"), bar("2018-12-01 12:00"), bar("2018-11-04 00:30", "NYSE"),
                                bar("2018-11-04 01:00"), bar("2018-02-17 22:59"), bar("2018-02-18 00:00")],
                               "exchange STRING, symbol STRING, datetime TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, value DOUBLE")
    rows = vendor.normalize_vendor_bars(df)
    assert rows.columns == ["exchange", "symbol", "datetime", "open", "high", "low", "close", "volume"]
    assert [r.datetime and r.datetime.isoformat(" ", "minutes") for r in rows.collect()] == [
        "2018-11-04 03:00", None, "2018-07-01 15:00", "2018-12-01 14:00", "2018-11-04 00:30", "2018-11-04 03:00", "2018-02-18 00:59", "2018-02-18 03:00"]


def test_bars_final_up_to_a_time(spark):
    df = spark.createDataFrame([("CME", "A", datetime(2024, 1, 1, 0, m), 1.0, 1.0, 1.0, 1.0, 5.0) for m in range(3)],
                               "exchange STRING, symbol STRING, datetime TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE")
    assert [r.is_final for r in vendor.bars_to_ticks(df).collect()] == [True] * 3
    limited = vendor.bars_to_ticks(df, F.lit("2024-01-01 00:02:00").cast("timestamp_ntz")).collect()
    assert [(r.symbol, r.is_final) for r in limited] == [("CME:A", True), ("CME:A", True), ("CME:A", False)]


SPECS = [
    {"provider": " Binance ", "name": "main", "symbols": ["btcusdt", "BTCUSDT"], "streams": ["Trades", "backfill"], "autostart": False, "extra": {"max": 5}},
    {"provider": "vendor", "name": "stocks", "symbols": ["AAPL", "AAPL", "MSFT", "MSFT", "GOOG"], "streams": ["quotes"], "autostart": True},
]


def test_feed_specs_file(spark, tmp_path):
    (tmp_path / "feeds.json").write_text(json.dumps(SPECS, indent=1))
    rows = sorted(feeds.read_feed_specs(spark, str(tmp_path / "feeds.json")).collect(), key=lambda r: r.feeder)
    assert [(r.feeder, r.symbols, r.autostart) for r in rows] == [
        ("binance:backfill:main", ["BTCUSDT"], False), ("binance:trades:main", ["BTCUSDT"], False),
        ("vendor:quotes:stocks", ["AAPL", "MSFT", "GOOG"], True)]


@pytest.mark.parametrize("broken", [{"name": "x", "streams": ["a"]}, {"provider": "x", "streams": ["a"]}, {"provider": "x", "name": "y", "streams": []}])
def test_incomplete_feed_specs(spark, tmp_path, broken):
    (tmp_path / "feeds.json").write_text(json.dumps([SPECS[1], broken]))
    with pytest.raises(Exception, match="without provider, name or streams"):
        feeds.read_feed_specs(spark, str(tmp_path / "feeds.json")).collect()
    specs = spark.createDataFrame([("p", "n", None, None, None, None)], "provider STRING, name STRING, symbols ARRAY<STRING>, streams ARRAY<STRING>, autostart BOOLEAN, extra MAP<STRING, STRING>")
    assert feeds.feed_specs(specs, invalid="drop").count() == 0
