"""Raw messages, rebuilt from the tables, parsed back to ticks and rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import epoch_us, ntz, split_exchange_symbol
from tickbars.operators import incremental, paging
from tickbars.operators.latest import latest_by_key
from tickbars.plans.journal import journal
from tickbars.plans.quotes import quotes_table
from tickbars.plans.registry import Tables, query
from tickbars.session import shared_dir
from tickbars.sinks import tables
from tickbars.sources import feeds, quotes, trades, vendor


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _ms(ts: str) -> Column:
    return F.floor(epoch_us(F.col(ts)) / F.lit(1000)).cast("bigint")


def trade_messages(t: Tables) -> DataFrame:
    """Live trade messages; those of the buyer side come wrapped."""
    plain = _json(F.lit("trade").alias("e"), _ms("EventTime").alias("E"), F.col("Symbol").alias("s"), F.col("TradeID").alias("t"),
                  F.col("Price").cast("string").alias("p"), F.col("Quantity").cast("string").alias("q"), _ms("Timestamp").alias("T"),
                  F.col("BuyerID").alias("b"), F.col("IsBuyerMaker").alias("m"), F.lit(True).alias("M"))
    wrapped = F.concat(F.lit('{"stream":"'), F.lower("Symbol"), F.lit('@trade","data":'), plain, F.lit("}"))
    return t.view("trades").select(F.when(F.col("IsBuyerMaker"), wrapped).otherwise(plain).alias("value"))


TICK = """SELECT 'binance' AS provider, 'trades' AS stream, Symbol AS symbol, (epoch_us(Timestamp) // 1000) * 1000000 AS ts_ns, TradeID AS seq,
       TRUE AS is_final, Price, Quantity, BuyerID, SellerID, IsBuyerMaker FROM trades"""


def _spread(ticks: DataFrame) -> DataFrame:
    return ticks.select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload.*")


@query("parse_trade_json", "trades", TICK)
def parse_trade_json(t: Tables) -> DataFrame:
    return _spread(trades.parse_trade_json(trade_messages(t)))


@query("parse_trade_rest", "trades", TICK.replace("BuyerID, SellerID", "CAST(0 AS BIGINT) AS BuyerID, CAST(0 AS BIGINT) AS SellerID"))
def parse_trade_rest(t: Tables) -> DataFrame:
    """Rows using each of the alternative keys in turn, some with empty first choices."""
    price, qty = F.col("Price").cast("string"), F.col("Quantity").cast("string")
    kind = F.col("TradeID") % 3
    first = _json(F.col("TradeID").alias("id"), price.alias("price"), qty.alias("qty"), _ms("Timestamp").alias("time"),
                  F.col("IsBuyerMaker").alias("isBuyerMaker"), F.lower("Symbol").alias("symbol"))
    second = _json(F.lit(0).alias("id"), F.col("TradeID").alias("tradeId"), F.lit("").alias("price"), price.alias("p"), qty.alias("q"),
                   _ms("Timestamp").alias("T"), F.col("IsBuyerMaker").alias("m"), F.col("Symbol").alias("s"))
    third = _json(F.col("TradeID").alias("t"), price.alias("p"), qty.alias("qty"), _ms("Timestamp").alias("timestamp"),
                  F.lit(False).alias("isBuyerMaker"), F.col("IsBuyerMaker").alias("m"), F.col("Symbol").alias("s"))
    raw = t.view("trades").filter("TradeID <> 0").select(F.when(kind == 0, first).when(kind == 1, second).otherwise(third).alias("value"))
    zero = t.view("trades").filter("TradeID = 0").select(first.alias("value"))
    return _spread(trades.parse_trade_rest(raw.unionAll(zero)))


@query("flatten_trades", "trades", """
SELECT EventType, date_trunc('milliseconds', EventTime) AS EventTime, Symbol, TradeID, Price, Quantity, BuyerID, SellerID,
       date_trunc('milliseconds', Timestamp) AS Timestamp, IsBuyerMaker FROM trades""")
def flatten_trades(t: Tables) -> DataFrame:
    return trades.flatten_trades(trades.parse_trade_json(trade_messages(t)))


def quote_messages(t: Tables) -> DataFrame:
    """Quote messages; updates of one exchange come as lists, of the others as single objects."""
    v = F.struct(F.col("lp"), F.col("bid"), F.col("ask"), F.col("volume"), (epoch_us(F.col("lp_time")) / F.lit(1e6)).alias("lp_time"))
    update = _json(F.concat_ws(":", F.upper("exchange"), F.upper("symbol")).alias("n"), v.alias("v"))
    update = F.when(F.col("exchange") == "cme", F.concat(F.lit("["), update, F.lit("]"))).otherwise(update)
    return t.view("quote_updates").select("arrival", F.concat(F.lit('{"m":"qsd","p":["qs_1",'), update, F.lit("]}")).alias("value"))


_UPDATE = """SELECT arrival, concat(upper(exchange), ':', upper(symbol)) AS sub_key, upper(exchange) AS exchange, upper(symbol) AS symbol,
       lp, bid, ask, volume, CAST((epoch_us(lp_time) / 1e6) * 1e9 AS BIGINT) AS lp_time_ns FROM quote_updates"""
_UPDATE_COLS = ("arrival", "sub_key", "exchange", "symbol", "lp", "bid", "ask", "volume", "lp_time_ns")


@query("parse_quote_json", "quote_updates", _UPDATE)
def parse_quote_json(t: Tables) -> DataFrame:
    """Quote messages among messages of another kind."""
    other = quote_messages(t).withColumn("value", F.lit('{"m":"quote_completed","p":["qs_1","X"]}'))
    return quotes.parse_quote_json(quote_messages(t).unionAll(other)).select(*_UPDATE_COLS)


@query("explode_frames", "quote_updates", _UPDATE)
def explode_frames(t: Tables) -> DataFrame:
    """Framed texts, each with a heartbeat, broken JSON and a torn end around its message."""
    body = F.col("value")
    framed = F.concat(F.lit("~m~4~m~~h~1~m~"), F.length(body).cast("string"), F.lit("~m~"), body, F.lit("~m~3~m~{x}~m~x"))
    return quotes.parse_quote_json(quotes.explode_frames(quote_messages(t).withColumn("value", framed))).select(*_UPDATE_COLS)


@query("split_exchange_symbol", "quote_updates", """
SELECT arrival, CASE WHEN exchange = 'nyse' THEN NULL ELSE upper(exchange) END AS exchange, upper(symbol) AS symbol FROM quote_updates""")
def split_symbols(t: Tables) -> DataFrame:
    raw = F.when(F.col("exchange") == "nyse", F.concat(F.lit(" "), "symbol")).otherwise(F.concat_ws(":", "exchange", "symbol"))
    exchange, symbol = split_exchange_symbol(raw)
    return t.view("quote_updates").select("arrival", exchange.alias("exchange"), symbol.alias("symbol"))


def fetched_bars(t: Tables) -> DataFrame:
    """Vendor bars as a download brings them: local time, lower-case names."""
    return t.view("vendor_bars").select(F.upper("Exchange").alias("exchange"), F.upper("Symbol").alias("symbol"), F.col("Timestamp").alias("datetime"),
                                        F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"),
                                        F.col("Close").alias("close"), F.col("Volume").alias("value"))


_UTC_BARS = """SELECT upper(Exchange) AS exchange, upper(Symbol) AS symbol,
       CASE WHEN Exchange = 'bmfbovespa' THEN Timestamp + INTERVAL '3' HOUR ELSE Timestamp END AS datetime,
       Open AS open, High AS high, Low AS low, Close AS close, Volume AS volume FROM vendor_bars"""


def utc_bars(t: Tables) -> DataFrame:
    return vendor.normalize_vendor_bars(fetched_bars(t))


@query("normalize_vendor_bars", "vendor_bars", _UTC_BARS)
def normalize_vendor_bars(t: Tables) -> DataFrame:
    return utc_bars(t)


@query("bars_to_ticks", "vendor_bars", f"""
SELECT 'tradingview' AS provider, 'bars' AS stream, concat(exchange, ':', symbol) AS symbol, epoch_us(datetime) * 1000 AS ts_ns,
       CAST(NULL AS BIGINT) AS seq, TRUE AS is_final, open, close, volume FROM ({_UTC_BARS})""")
def bars_to_ticks(t: Tables) -> DataFrame:
    return vendor.bars_to_ticks(utc_bars(t)).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload.open", "payload.close", "payload.volume")


@query("flatten_bars", "vendor_bars", f"""
SELECT exchange AS Exchange, symbol AS Symbol, datetime AS Timestamp, open AS Open, high AS High, low AS Low, close AS Close,
       volume AS Volume, TRUE AS IsFinal FROM ({_UTC_BARS})""")
def flatten_bars(t: Tables) -> DataFrame:
    return vendor.flatten_bars(vendor.bars_to_ticks(utc_bars(t)))


def quote_ticks(t: Tables) -> DataFrame:
    rows = quotes_table(t).select(F.col("Exchange").alias("exchange"), F.col("Symbol").alias("symbol"), F.col("LastPrice").alias("lp"),
                                  F.col("Bid").alias("bid"), F.col("Ask").alias("ask"), F.col("Volume").alias("volume"),
                                  F.col("Change").alias("ch"), F.col("ChangePct").alias("chp"), F.col("VolDelta").alias("vol_delta"),
                                  (epoch_us(F.col("LpTime")) * 1000).alias("lp_time_ns"))
    return quotes.quotes_to_ticks(rows)


@query("flatten_quotes", "quotes", """
SELECT Exchange, Symbol, LpTime, LastPrice, Bid, Ask, Volume, CAST(NULL AS DOUBLE) AS Change, CAST(NULL AS DOUBLE) AS ChangePct, VolDelta FROM quotes""")
def flatten_quotes(t: Tables) -> DataFrame:
    return quotes.flatten_quotes(quote_ticks(t))


@query("feed_specs", "configs", """
SELECT CASE WHEN deleted THEN 'binance' ELSE 'vendor' END AS provider, unnest(['trades', 'backfill']) AS stream, name,
       CASE WHEN deleted THEN 'AB,X' || upper(name) ELSE 'ab,AB,x' || name END AS symbols, deleted AS autostart FROM configs""")
def feed_specs(t: Tables) -> DataFrame:
    """Subscription specs as JSON text, with repeated symbols and untidy names."""
    provider = F.when(F.col("deleted"), " Binance").otherwise("VENDOR ")
    symbols = F.array(F.lit("ab"), F.lit("AB"), F.concat(F.lit("x"), "name"), F.lit("AB"))
    text = t.view("configs").select(_json(provider.alias("provider"), F.concat(F.col("name"), F.lit(" ")).alias("name"), symbols.alias("symbols"),
                                          F.array(F.lit("Trades "), F.lit("backfill")).alias("streams"),
                                          F.when(F.col("deleted"), True).alias("autostart")).alias("value"))
    specs = text.select(F.from_json("value", schemas.FEED_SPEC).alias("s")).select("s.*")
    return feeds.feed_specs(specs).select("provider", "stream", "name", F.concat_ws(",", "symbols").alias("symbols"), "autostart")


def mixed_ticks(t: Tables) -> DataFrame:
    """Ticks of every stream in one table, payloads as JSON; those of the journal have no route."""
    cols = ("provider", "stream", "symbol", "ts_ns", "seq", "payload", "is_final")
    parts = [trades.parse_trade_json(trade_messages(t)), quote_ticks(t), vendor.bars_to_ticks(utc_bars(t))]
    mixed = journal(t).select(*cols)
    for part in parts:
        mixed = mixed.unionByName(part.withColumn("payload", F.to_json("payload")).select(*cols))
    return mixed


@query("route_by_stream", "trades quotes vendor_bars ticks", """
SELECT 'trades' AS table_name, Symbol AS symbol, epoch_us(Timestamp) // 1000 AS at_ms, Price AS value, Quantity AS amount FROM trades
UNION ALL SELECT 'quotes', concat(Exchange, ':', Symbol), epoch_us(LpTime) // 1000, LastPrice, VolDelta FROM quotes
UNION ALL SELECT 'bars', concat(upper(Exchange), ':', upper(Symbol)),
  epoch_us(CASE WHEN Exchange = 'bmfbovespa' THEN Timestamp + INTERVAL '3' HOUR ELSE Timestamp END) // 1000, Close, Volume FROM vendor_bars
UNION ALL SELECT 'unrouted', concat('tpch/', stream), NULL, NULL, CAST(count(*) AS DOUBLE) FROM ticks GROUP BY stream""")
def route_by_stream(t: Tables) -> DataFrame:
    """One mixed batch routed to its tables: the rows of each, and a row per pair without a route."""
    root = shared_dir(t.spark, "tables")
    tables.route_by_stream(root, event_log=f"{root}/events")(mixed_ticks(t), 0)

    def rows(name: str, symbol: Column, at: Column, value: Column, amount: Column) -> DataFrame:
        return t.spark.read.parquet(f"{root}/{name}").select(
            F.lit("unrouted" if name == "events" else name).alias("table_name"), symbol.alias("symbol"), at.cast("bigint").alias("at_ms"),
            value.cast("double").alias("value"), amount.cast("double").alias("amount"))

    def ms(column: str) -> Column:
        return F.floor(epoch_us(F.col(column)) / 1000)

    pair, none = F.concat_ws(":", "Exchange", "Symbol"), F.lit(None)
    named = F.concat(F.regexp_extract("message", "provider=(\\S*)", 1), F.lit("/"), F.regexp_extract("message", "stream=(\\S*)", 1))
    return rows("trades", F.col("Symbol"), ms("Timestamp"), F.col("Price"), F.col("Quantity")) \
        .unionByName(rows("quotes", pair, ms("LpTime"), F.col("LastPrice"), F.col("VolDelta"))) \
        .unionByName(rows("bars", pair, ms("Timestamp"), F.col("Close"), F.col("Volume"))) \
        .unionByName(rows("events", named, none, none, F.get_json_object("meta", "$.rows")))


@query("fetch_window", "vendor_bars", f""", b AS ({_UTC_BARS}), a AS (SELECT max(datetime) AS now FROM b),
w AS (SELECT exchange, symbol, max(datetime) AS watermark FROM b WHERE exchange = 'CME' GROUP BY exchange, symbol),
r AS (SELECT DISTINCT b.exchange, b.symbol, coalesce(w.watermark - INTERVAL '5' MINUTE, a.now - INTERVAL '10' DAY) AS window_start, a.now AS window_end
      FROM b CROSS JOIN a LEFT JOIN w ON b.exchange = w.exchange AND b.symbol = w.symbol)
SELECT exchange, symbol, s AS window_start, e AS window_end, greatest((epoch_us(e) - epoch_us(s)) // 60000000, 1) AS n_bars
FROM (SELECT *, window_start + to_minutes(cut) AS s, least(window_start + to_minutes(cut + 5000), window_end) AS e
      FROM (SELECT *, unnest(range(0, greatest((epoch_us(window_end) - epoch_us(window_start)) // 60000000, 1), 5000)) AS cut FROM r))""")
def fetch_window(t: Tables) -> DataFrame:
    bars = utc_bars(t)
    return paging.fetch_window(bars.select("exchange", "symbol").distinct(), _watermarks(bars), _now(bars), ["exchange", "symbol"])


def _now(bars: DataFrame) -> Column:
    return ntz(bars.agg(F.max("datetime")).first()[0])


def _watermarks(bars: DataFrame) -> DataFrame:
    """Symbols of one exchange have been fetched before."""
    return bars.filter("exchange = 'CME'").groupBy("exchange", "symbol").agg(F.max("datetime").alias("watermark"))


_CUTOFFS = f""", b AS ({_UTC_BARS}),
c AS (SELECT exchange, symbol, min(datetime) AS cutoff FROM (
        SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY datetime DESC) AS n FROM b) WHERE n <= 5 GROUP BY exchange, symbol)"""


@query("repaint_overlap", "vendor_bars", f"""{_CUTOFFS}
SELECT b.* FROM b JOIN c ON b.exchange = c.exchange AND b.symbol = c.symbol WHERE b.exchange <> 'CME' OR b.datetime >= c.cutoff""")
def repaint_overlap(t: Tables) -> DataFrame:
    bars = utc_bars(t)
    return paging.repaint_overlap(bars, _watermarks(bars), ["exchange", "symbol"])


@query("incremental_bars", "vendor_bars", f"""{_CUTOFFS}, a AS (SELECT max(datetime) AS now FROM b)
SELECT b.* FROM b CROSS JOIN a JOIN c ON b.exchange = c.exchange AND b.symbol = c.symbol
JOIN (SELECT exchange, symbol, max(datetime) - INTERVAL '8' DAY AS watermark FROM b GROUP BY exchange, symbol) w ON b.exchange = w.exchange AND b.symbol = w.symbol
WHERE (b.exchange <> 'CME' AND b.datetime >= a.now - INTERVAL '10' DAY) OR (b.exchange = 'CME' AND b.datetime >= least(c.cutoff, w.watermark))""")
def incremental_bars(t: Tables) -> DataFrame:
    """A run with watermarks far enough back that the window holds more than the overlap."""
    bars = utc_bars(t)
    behind = _watermarks(bars).withColumn("watermark", F.col("watermark") - F.expr("INTERVAL '8' DAY"))
    return incremental.incremental_bars(bars, behind, _now(bars))



@query("ingest_cycle", "vendor_bars", f""", b AS ({_UTC_BARS}), a AS (SELECT max(datetime) AS now FROM b)
SELECT b.* FROM b CROSS JOIN a WHERE b.datetime >= a.now - INTERVAL '17' DAY""")
def ingest_cycle(t: Tables) -> DataFrame:
    """Two runs a week apart, the second one repeated: what they emitted, in its latest version."""
    out, cursors = shared_dir(t.spark, "emitted"), shared_dir(t.spark, "cursors")
    bars = utc_bars(t)
    now = bars.agg(F.max("datetime")).first()[0]
    for run, back in ((1, 7), (2, 0), (2, 0)):
        as_of = ntz(now - timedelta(days=back))
        fetched = bars.filter(F.col("datetime") <= as_of)
        incremental.ingest_cycle(t.spark, lambda marks, rows=fetched: rows, as_of, out, cursors, run)
    emitted = t.spark.read.parquet(out)
    return latest_by_key(emitted, ["exchange", "symbol", "datetime"], "run").select(*bars.columns)
