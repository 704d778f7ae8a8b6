"""Streams over the given tables, run until they have read everything, and their results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import epoch_us, ntz
from tickbars.operators import bars, feed, stitch
from tickbars.operators.filters import filter_time_range
from tickbars.operators.latest import latest_by_key
from tickbars.plans.bars import ORACLE_STITCHED_5M
from tickbars.plans.feeds import ATTACH_NS, DAY_NS, GAPLESS
from tickbars.plans.quotes import quotes_table, updates
from tickbars.plans.raw import TICK, trade_messages
from tickbars.plans.registry import Tables, query, rounded
from tickbars.session import shared_dir
from tickbars.streaming import bars as live
from tickbars.streaming import feeds, messages, scans, state
from tickbars.streaming.partials import LiveBars
from tickbars.streaming.stats import FeedMonitor

DELAY = "1 minute"
_BAR = "Timestamp, Symbol, BarId, Open, High, Low, Close, Volume, Trades, round(Vwap, 6) AS Vwap, BuyerMakerCount"
_CLOSED = "Timestamp + INTERVAL '{n}' MINUTE <= (SELECT max(Timestamp) - INTERVAL '1' MINUTE FROM trades)"


def trade_stream(t: Tables, path: str | None = None, max_files: int = live.MAX_FILES) -> DataFrame:
    """The events table as a stream of trades, or what was landed of it in another folder."""
    events = live.read_ticks(t.spark, path or t.stream_path("events"), t.table("events").schema, max_files)
    return events.select(
        F.upper("event_type").alias("Symbol"), F.col("event_id").alias("TradeID"), F.col("value").alias("Price"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("Quantity"), F.col("user_id").alias("BuyerID"),
        F.col("ts").alias("Timestamp"), (F.col("event_id") % 2 == 0).alias("IsBuyerMaker"))


def _finished(queries) -> None:
    for q in queries:
        q.awaitTermination()


def _live_bars(t: Tables, trades: DataFrame, period: int = 1) -> DataFrame:
    """Closed bars as a subscriber ends up with them: of each the newest report."""
    out = shared_dir(t.spark, "stream")
    table = LiveBars(f"{out}/bars", DELAY)
    _finished([state.start(trades, table.batch(period, on_closed=state.batch_writer(f"{out}/closed")), f"{out}/checkpoint")])
    return rounded(latest_by_key(t.spark.read.parquet(f"{out}/closed"), ["Symbol", "Timestamp"], "batch_id").drop("batch_id"), "Vwap")


@query("stream_completed_bars", "bars_1m trades", f"SELECT {_BAR} FROM bars_1m WHERE {_CLOSED.format(n=1)}")
def stream_completed_bars(t: Tables) -> DataFrame:
    return _live_bars(t, trade_stream(t))


@query("live_rollup", "bars_5m trades", f"SELECT {_BAR} FROM bars_5m WHERE {_CLOSED.format(n=5)}")
def live_rollup(t: Tables) -> DataFrame:
    return _live_bars(t, trade_stream(t), 5)


@query("stream_open_bars", "bars_1m", f"SELECT {_BAR} FROM bars_1m")
def stream_open_bars(t: Tables) -> DataFrame:
    """Every change of every bar; shown as the last change of each."""
    out = shared_dir(t.spark, "stream")
    table = LiveBars(f"{out}/bars", DELAY)
    _finished([state.start(trade_stream(t), table.batch(1, on_changed=state.batch_writer(f"{out}/data")), f"{out}/checkpoint")])
    changes = t.spark.read.parquet(f"{out}/data").drop("first_batch", "last_batch")
    return rounded(latest_by_key(changes, ["Symbol", "Timestamp"], "batch_id").drop("batch_id"), "Vwap")


@query("forced_completion", "bars_1m", f"SELECT {_BAR} FROM bars_1m")
def forced_completion(t: Tables) -> DataFrame:
    """All bars close: clock rows after the last trade stand for the time that passes without one."""
    beats_dir = shared_dir(t.spark, "beats")
    last = t.table("events").agg(F.max("ts").alias("Timestamp"))
    last.select((F.col("Timestamp") + F.expr("INTERVAL '5' MINUTE")).cast("timestamp").alias("Timestamp")).write.parquet(beats_dir)
    beats = live.read_ticks(t.spark, beats_dir, "Timestamp TIMESTAMP")
    return _live_bars(t, live.with_heartbeats(trade_stream(t), beats))


def _thirds(rows: DataFrame, time_col: str) -> list[DataFrame]:
    """Rows in three parts, one after the other by a time column."""
    low, high = rows.agg(F.min(time_col), F.max(time_col)).first()
    cuts = [ntz(low + (high - low) * i / 3) for i in (1, 2)]
    at = F.col(time_col)
    return [rows.filter(part) for part in (at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1])]


def _streamed(t: Tables, parts: list[DataFrame], out: str, change) -> DataFrame:
    """Parts landed one after the other, in as many files as their tasks, and streamed as a micro-batch each."""
    for part in parts:
        part.write.mode("append").parquet(f"{out}/landed")
        stream = change(live.read_ticks(t.spark, f"{out}/landed", part.schema, max_files=1 << 30))
        _finished([state.start_files(stream, f"{out}/data", f"{out}/checkpoint")])
    return t.spark.read.schema(stream.schema).parquet(f"{out}/data")


def _live_quote_bars(t: Tables) -> DataFrame:
    """Provisional bars from quotes that come in three micro-batches; a clock row after them closes the last bars."""
    out = shared_dir(t.spark, "quotes")
    rows = quotes_table(t).drop("Change", "ChangePct")
    rows.write.parquet(f"{out}/all")
    stored = t.spark.read.schema(rows.schema).parquet(f"{out}/all")
    beat = stored.agg((F.max("LpTime") + F.expr("INTERVAL '5' MINUTE")).alias("LpTime"))
    parts = [*_thirds(stored, "LpTime"), stored.limit(0).unionByName(beat, allowMissingColumns=True)]
    return _streamed(t, parts, out, lambda quotes: live.stream_quote_bars(quotes, 1, DELAY))


def _live_vendor_bars(t: Tables) -> DataFrame:
    """Vendor bars as they come, repaints among them, in three micro-batches."""
    out = shared_dir(t.spark, "vendor")
    bars_so_far = _streamed(t, _thirds(t.view("settled_bars_dup"), "Timestamp"), out, lambda bars: bars)
    return bars_so_far.withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz"))


def _live_stitched(t: Tables) -> DataFrame:
    """What the two streams have landed so far, stitched when it is read: a late vendor bar outranks its stand-in at once."""
    return stitch.stitch_bars(_live_vendor_bars(t), _live_quote_bars(t))


_UNIFIED = "Timestamp, Exchange, Symbol, BarId, Open, High, Low, Close, Volume, IsFinal"


@query("stream_quote_bars", "quote_bars", f"SELECT {_UNIFIED} FROM quote_bars")
def stream_quote_bars(t: Tables) -> DataFrame:
    return _live_quote_bars(t)


@query("stream_stitched_1m", "stitched", f"SELECT {_UNIFIED} FROM stitched")
def stream_stitched_1m(t: Tables) -> DataFrame:
    return _live_stitched(t)


@query("stream_stitched_5m", "stitched", ORACLE_STITCHED_5M)
def stream_stitched_5m(t: Tables) -> DataFrame:
    return bars.rollup_unified_bars(_live_stitched(t), 5)


def _in_batches(t: Tables, parts: list[str], batch: state.BatchFn, checkpoint: str) -> None:
    """Feed the events to a stream in so many micro-batches: those for which each condition holds, one after another.

    The stream is started anew for each, and takes all files it finds at once.
    """
    path = shared_dir(t.spark, "landed")
    for part in parts:
        t.table("events").filter(part).write.mode("append").parquet(path)
        _finished([state.start(trade_stream(t, path, max_files=1 << 30), batch, checkpoint)])


@query("late_rows", "bars_1m", f"SELECT {_BAR} FROM bars_1m")
def late_rows(t: Tables) -> DataFrame:
    """A tenth of the trades comes after all others, and the bars they belong to take them in."""
    out = shared_dir(t.spark, "late")
    table = LiveBars(f"{out}/bars", DELAY, fold_every=2)
    parts = ["event_id % 10 <> 0 AND event_id % 3 = 0", "event_id % 10 <> 0 AND event_id % 3 <> 0", "event_id % 20 = 0", "event_id % 20 = 10"]
    _in_batches(t, parts, table.batch(), f"{out}/checkpoint")
    return rounded(table.bars(t.spark), "Vwap")


_CHANGES = """
, batches AS (SELECT unnest([0, 1, 2]) AS batch),
so_far AS (
  SELECT b.batch, Symbol, date_trunc('minute', Timestamp) AS Timestamp, arg_min(Price, (Timestamp, TradeID)) AS Open, max(Price) AS High, min(Price) AS Low,
         arg_max(Price, (Timestamp, TradeID)) AS Close, sum(Quantity) AS Volume, count(*) AS Trades, CAST(sum(CAST(IsBuyerMaker AS INT)) AS BIGINT) AS BuyerMakerCount,
         sum(Price * Quantity) AS pq, min(TradeID % 3) AS first_batch, max(TradeID % 3) AS last_batch
  FROM trades t JOIN batches b ON t.TradeID % 3 <= b.batch GROUP BY b.batch, Symbol, date_trunc('minute', Timestamp)),
shown AS (SELECT *, max(Timestamp) OVER (PARTITION BY batch, Symbol) AS newest, CAST(hour(Timestamp) * 60 + minute(Timestamp) AS BIGINT) AS BarId,
                 CASE WHEN Volume <> 0 THEN pq / Volume END AS Vwap FROM so_far),
done AS (SELECT *, row_number() OVER (PARTITION BY Symbol, Timestamp ORDER BY batch) AS rn FROM shown WHERE Timestamp < newest),
changes AS (
  SELECT *, CASE WHEN first_batch = batch THEN 'added' ELSE 'updated' END AS part FROM shown WHERE last_batch = batch
  UNION ALL SELECT * EXCLUDE (rn), 'completed' AS part FROM done WHERE rn = 1)
"""


def _change_feed(t: Tables) -> DataFrame:
    """The events in three micro-batches, each over the whole time, so that later ones change bars of earlier ones."""
    out = shared_dir(t.spark, "stream")
    table = LiveBars(f"{out}/bars", DELAY, fold_every=2)
    _in_batches(t, [f"event_id % 3 = {k}" for k in range(3)], table.batch(1, on_changed=feeds.bar_changes(f"{out}/data", f"{out}/state")), f"{out}/checkpoint")
    return t.spark.read.parquet(f"{out}/data")


@query("bar_change_feed", "trades", f"{_CHANGES} SELECT batch AS batch_id, part, {_BAR} FROM changes")
def bar_change_feed(t: Tables) -> DataFrame:
    return rounded(_change_feed(t), "Vwap")


@query("feed_stats", "trades", f"""{_CHANGES},
counted AS (SELECT Symbol, batch, count(*) FILTER (WHERE part = 'added') AS added, count(*) FILTER (WHERE part = 'updated') AS updated,
                   count(*) FILTER (WHERE part = 'completed') AS completed FROM changes GROUP BY Symbol, batch)
SELECT 'binance' AS provider, 'ohlcv_1m' AS schema, Symbol AS symbol, arg_max(added, batch) AS last_added_rows, arg_max(updated, batch) AS last_updated_rows,
       arg_max(completed, batch) AS last_completed_rows, CAST(sum(added) AS BIGINT) AS total_added_rows, CAST(sum(updated) AS BIGINT) AS total_updated_rows,
       CAST(sum(completed) AS BIGINT) AS total_completed_rows FROM counted GROUP BY Symbol""")
def feed_stats(t: Tables) -> DataFrame:
    changes = _change_feed(t).select(F.lit("binance").alias("provider"), F.lit("ohlcv_1m").alias("schema"), F.col("Symbol").alias("symbol"), "part", "batch_id")
    return feed.feed_stats(changes)


@query("live_feed_stats", "trades", f"""{_CHANGES}
SELECT 'binance' AS provider, 'ohlcv_1m' AS schema, Symbol AS symbol, count(*) FILTER (WHERE part = 'added') AS total_added_rows,
       count(*) FILTER (WHERE part = 'updated') AS total_updated_rows, count(*) FILTER (WHERE part = 'completed') AS total_completed_rows,
       CAST(1 AS BIGINT) AS subscriber_count, (SELECT count(DISTINCT Symbol) FROM changes) AS total_handles FROM changes GROUP BY Symbol""")
def live_feed_stats(t: Tables) -> DataFrame:
    """A subscription to each symbol of the change feed, over several micro-batches, and what the monitor saw of them."""
    out = shared_dir(t.spark, "stats")
    changes = _change_feed(t).drop("batch_id")
    changes.repartition(3, "Symbol", "Timestamp").write.parquet(f"{out}/changes")
    symbols = [r[0] for r in changes.select("Symbol").distinct().collect()]  # one per subscription
    monitor = FeedMonitor(t.spark, f"{out}/stats")

    def subscription(symbol: str):
        feed_rows = live.read_ticks(t.spark, f"{out}/changes", changes.schema, max_files=1)
        return monitor.subscribe(feed_rows, "binance", "ohlcv_1m", symbol, state.batch_writer(f"{out}/{symbol}"), f"{out}/checkpoints/{symbol}")

    running = [subscription(s) for s in symbols]
    _finished(running)
    monitor.close(running)
    return monitor.latest().select("provider", "schema", "symbol", "total_added_rows", "total_updated_rows", "total_completed_rows", "subscriber_count", "total_handles")


def _message_stream(t: Tables) -> str:
    """Live trade messages, and bad lines among them, landed as text one after the other and read as a stream."""
    out = shared_dir(t.spark, "messages")
    good = trade_messages(t)
    bad = t.view("trades").filter("TradeID % 50 = 0").select(F.explode(F.array(
        F.concat(F.lit('{"e":"trade","t":'), F.col("TradeID").cast("string")),
        F.concat(F.lit('{"e":"other","t":'), F.col("TradeID").cast("string"), F.lit("}")),
        F.concat(F.lit('{"e":"trade","s":"'), F.col("Symbol"), F.lit('","T":1}')))).alias("value"))
    for part in (bad, good):
        part.write.mode("append").text(f"{out}/lines")
        raw = messages.read_messages(t.spark, f"{out}/lines", max_files=3)
        _finished([state.start(messages.parsed(raw), messages.message_writer(f"{out}/ticks"), f"{out}/checkpoint")])
    return f"{out}/ticks"


@query("stream_parse_trades", "trades", TICK)
def stream_parse_trades(t: Tables) -> DataFrame:
    return messages.accepted(t.spark, _message_stream(t)).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload.*")


@query("stream_trade_rejects", "trades", """
SELECT concat('{"e":"trade","t":', CAST(TradeID AS VARCHAR)) AS value, 'not JSON' AS reason FROM trades WHERE TradeID % 50 = 0
UNION ALL SELECT concat('{"e":"other","t":', CAST(TradeID AS VARCHAR), '}'), 'no symbol' FROM trades WHERE TradeID % 50 = 0
UNION ALL SELECT concat('{"e":"trade","s":"', Symbol, '","T":1}'), 'no id' FROM trades WHERE TradeID % 50 = 0""")
def stream_trade_rejects(t: Tables) -> DataFrame:
    return messages.rejected(t.spark, _message_stream(t)).drop("batch_id")


@query("stream_seq_gaps", "gaps_arrival", "SELECT symbol, start_id, end_id, discovered_at_ns FROM gaps_arrival")
def stream_seq_gaps(t: Tables) -> DataFrame:
    out = shared_dir(t.spark, "stream")
    us = epoch_us(F.col("Timestamp"))
    ticks = trade_stream(t).select(F.concat(F.lit("U"), F.col("BuyerID").cast("string")).alias("symbol"), F.col("TradeID").alias("seq"),
                                   us.alias("arrival"), (us * 1000).alias("ts_ns"))
    _finished([state.start(ticks, scans.gap_monitor(f"{out}/data", f"{out}/state"), f"{out}/checkpoint")])
    return t.spark.read.parquet(f"{out}/data").drop("batch_id")


@query("stream_quote_state", "quote_state", """
SELECT sub_key, arrival, lp, bid, ask, volume, vol_delta FROM quote_state WHERE lp IS NOT NULL OR bid IS NOT NULL OR ask IS NOT NULL OR vol_delta > 0""")
def stream_quote_state(t: Tables) -> DataFrame:
    """Quote updates landed as files, then read as a stream."""
    out = shared_dir(t.spark, "stream")
    rows = updates(t).drop("lp_time")
    rows.write.parquet(f"{out}/updates")
    stream = live.read_ticks(t.spark, f"{out}/updates", rows.schema)
    _finished([state.start(stream, scans.quote_scan(f"{out}/data", f"{out}/state"), f"{out}/checkpoint")])
    return t.spark.read.parquet(f"{out}/data").select("sub_key", "arrival", "lp", "bid", "ask", "volume", "vol_delta")


@query("subscribe_foreach", "bars_1m trades", f"""
SELECT Timestamp, Symbol, Close FROM bars_1m WHERE Symbol = 'CLICK' AND {_CLOSED.format(n=1)}""")
def subscribe_foreach(t: Tables) -> DataFrame:
    out = shared_dir(t.spark, "stream")
    table, spec = LiveBars(f"{out}/bars", DELAY), feed.feed_spec("binance", "ohlcv_1m")
    _finished([feeds.subscribe_foreach(trade_stream(t), spec, "CLICK", state.batch_writer(f"{out}/data"), f"{out}/checkpoint",
                                       fields=["timestamp", "symbol", "close"], through=lambda bars_to: table.batch(1, on_closed=bars_to))])
    return latest_by_key(t.spark.read.parquet(f"{out}/data"), ["Symbol", "Timestamp"], "batch_id").drop("batch_id")


@query("independent_consumers", "trades", """
SELECT 'journal' AS consumer, Symbol, count(*) AS row_count, CAST(sum(TradeID) AS BIGINT) AS id_sum FROM trades GROUP BY Symbol
UNION ALL SELECT 'tables', Symbol, count(*), CAST(sum(TradeID) AS BIGINT) FROM trades GROUP BY Symbol""")
def independent_consumers(t: Tables) -> DataFrame:
    out = shared_dir(t.spark, "stream")
    names = ("journal", "tables")
    _finished(feeds.independent_consumers(lambda: trade_stream(t), {n: state.batch_writer(f"{out}/{n}") for n in names}, f"{out}/checkpoints").values())

    def counted(name: str) -> DataFrame:
        return t.spark.read.parquet(f"{out}/{name}").groupBy("Symbol").agg(F.count(F.lit(1)).alias("row_count"), F.sum("TradeID").alias("id_sum")) \
            .withColumn("consumer", F.lit(name))
    return counted("journal").unionByName(counted("tables"))


@query("attach_gapless", "bars_1m trades", GAPLESS.format(closed=f"SELECT * FROM today WHERE {_CLOSED.format(n=1)}") + "SELECT * FROM feed")
def attach_gapless(t: Tables) -> DataFrame:
    """The snapshot of a day so far, then its stream of closed bars from there."""
    out = shared_dir(t.spark, "stream")
    cols = ["phase", "part", "Symbol", "Timestamp", "Close", "Volume", "watermark_ns"]
    snapshot = bars.trade_bars(filter_time_range(t.view("trades"), "Timestamp", DAY_NS, ATTACH_NS - 1000))
    today = trade_stream(t).filter(F.col("Timestamp") >= F.timestamp_micros(F.lit(DAY_NS // 1000)))
    table = LiveBars(f"{out}/bars", DELAY)

    def emit(rows: DataFrame, batch_id: int) -> None:
        known = rows if "watermark_ns" in rows.columns else rows.withColumn("watermark_ns", F.lit(None).cast("bigint"))
        known.select(*cols).write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    _finished([feeds.attach_gapless(snapshot, today, feed.feed_spec("binance", "ohlcv_1m"), emit, f"{out}/checkpoint", include_open_bar=False,
                                    through=lambda bars_to: table.batch(1, on_closed=bars_to))])
    return latest_by_key(t.spark.read.parquet(f"{out}/data"), ["phase", "Symbol", "Timestamp"], "batch_id").select(*cols)
