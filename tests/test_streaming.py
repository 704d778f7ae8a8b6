"""Streams fed file by file, with late and out-of-order rows, retries and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickbars.operators import bars as batch_bars
from tickbars.operators import feed, gaps, quotes
from tickbars.schemas import TRADE_BAR_COLS
from tickbars.streaming import bars, feeds, scans, state
from tickbars.streaming import messages
from tickbars.streaming.partials import LiveBars
from tickbars.streaming.stats import FeedMonitor

T0 = datetime(2024, 1, 1, 10)
SCHEMA = "Symbol STRING, TradeID BIGINT, Timestamp TIMESTAMP_NTZ, Price DOUBLE, Quantity DOUBLE, IsBuyerMaker BOOLEAN"


def trade(symbol, i, second):
    return (symbol, i, T0 + timedelta(seconds=second), float(i), 1.0, i % 2 == 0)


def land(spark, path, rows, schema=SCHEMA):
    """One more file in the folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=SCHEMA):
    return bars.read_ticks(spark, path, schema, max_files=1)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def dirs(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "checkpoint")


def test_closed_bars_come_once_and_in_full(spark, dirs):
    source, out, _, checkpoint = dirs
    rows = [trade("AB"[i % 2], i, i * 7) for i in range(60)]
    for part in (rows[:20], rows[20:40], rows[40:]):
        land(spark, source, part)
        finish(state.start_files(bars.stream_bars(stream(spark, source), 1, "0 seconds"), out, checkpoint))
    got = spark.read.parquet(out)
    last = T0 + timedelta(seconds=59 * 7)
    want = batch_bars.trade_bars(spark.createDataFrame(rows, SCHEMA)).filter(F.col("Timestamp") + F.expr("INTERVAL '1' MINUTE") <= F.lit(last).cast("timestamp_ntz"))
    assert want.exceptAll(got).count() == 0 and got.count() == want.count() > 5


def test_rows_later_than_the_delay_are_dropped(spark, dirs):
    source, out, _, checkpoint = dirs
    for part in ([trade("A", 1, 0)], [trade("A", 2, 600)], [trade("A", 3, 5)], [trade("A", 4, 1200)]):
        land(spark, source, part)
        finish(state.start_files(bars.stream_bars(stream(spark, source), 1, "1 minute"), out, checkpoint))
    assert [(r.Timestamp, r.Trades) for r in spark.read.parquet(out).orderBy("Timestamp").collect()] == [(T0, 1), (T0 + timedelta(minutes=10), 1)]


def test_heartbeats_close_the_bars_of_a_silent_feed(spark, dirs):
    source, out, beats, checkpoint = dirs
    land(spark, source, [trade("A", 1, 0), trade("B", 2, 3)])
    land(spark, beats, [(T0 + timedelta(minutes=9),)], "Timestamp TIMESTAMP_NTZ")
    clock = bars.read_ticks(spark, beats, "Timestamp TIMESTAMP_NTZ")
    finish(state.start_files(bars.closed_by_clock(stream(spark, source), clock, 1, "1 minute"), out, checkpoint))
    assert sorted((r.Symbol, r.Trades) for r in spark.read.parquet(out).collect()) == [("A", 1), ("B", 1)]


def _changes(spark, out):
    rows = spark.read.parquet(out).orderBy("batch_id").collect()
    return [(r.batch_id, r.part, r.Symbol, int((r.Timestamp - T0).total_seconds() // 60), r.Trades) for r in rows]


def test_change_feed(spark, dirs):
    source, out, kept, checkpoint = dirs
    parts = ([trade("A", 1, 0), trade("B", 2, 0)], [trade("A", 3, 30)], [trade("A", 4, 130), trade("A", 5, 70)], [trade("A", 6, 20)], [trade("B", 7, 300)])
    for part in parts:
        land(spark, source, part)
        finish(state.start(bars.stream_changed_bars(stream(spark, source), 1, "1 hour"), feeds.bar_changes(out, kept), checkpoint, "update"))
    got = [c[1:] for c in _changes(spark, out)]
    assert sorted(got) == sorted([
        ("added", "A", 0, 1), ("added", "B", 0, 1), ("updated", "A", 0, 2),
        ("added", "A", 2, 1), ("added", "A", 1, 1), ("completed", "A", 0, 2), ("completed", "A", 1, 1),
        ("updated", "A", 0, 3), ("added", "B", 5, 1), ("completed", "B", 0, 1)])


def test_every_bar_is_completed_once_however_rows_arrive(spark, dirs):
    source, out, kept, checkpoint = dirs
    rnd = random.Random(2)
    rows = [trade(rnd.choice("ABC"), i, i * 11) for i in range(120)]
    for k in range(4):
        part = rows[k * 30:(k + 1) * 30]
        rnd.shuffle(part)
        land(spark, source, part)
    finish(state.start(bars.stream_changed_bars(stream(spark, source), 1, "1 day"), feeds.bar_changes(out, kept), checkpoint, "update"))
    changes = _changes(spark, out)
    want = batch_bars.trade_bars(spark.createDataFrame(rows, SCHEMA))
    added = [c[2:4] for c in changes if c[1] == "added"]
    completed = [c[2:4] for c in changes if c[1] == "completed"]
    assert len(added) == len(set(added)) == want.count()
    assert len(completed) == len(set(completed)) == batch_bars.completed_bars(want).count()


def test_gap_monitor_over_batches(spark, dirs):
    source, out, kept, checkpoint = dirs
    rnd = random.Random(4)
    rows = [(rnd.choice("AAB"), rnd.randrange(1, 500), i, i * 1000) for i in range(90)]
    schema = "symbol STRING, seq BIGINT, arrival BIGINT, ts_ns BIGINT"
    for k in range(3):
        land(spark, source, rows[k * 30:(k + 1) * 30], schema)
        finish(state.start(stream(spark, source, schema), scans.gap_monitor(out, kept), checkpoint))
    got = spark.read.parquet(out).drop("batch_id")
    want = gaps.seq_gaps_arrival(spark.createDataFrame(rows, schema), "symbol", "seq", "arrival", F.col("ts_ns"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quote_state_over_batches(spark, dirs):
    source, out, kept, checkpoint = dirs
    rnd = random.Random(6)

    def some(v):
        return float(v) if rnd.random() < .4 else None
    rows = [(rnd.choice("AAB"), i, some(i), some(i), some(i), some(rnd.randrange(40))) for i in range(90)]
    schema = "sub_key STRING, arrival BIGINT, lp DOUBLE, bid DOUBLE, ask DOUBLE, volume DOUBLE"
    for k in range(3):
        land(spark, source, rows[k * 30:(k + 1) * 30], schema)
        finish(state.start(stream(spark, source, schema), scans.quote_scan(out, kept), checkpoint))
    want = quotes.material_quotes(quotes.quote_state(spark.createDataFrame(rows, schema)))
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_retried_batch_leaves_the_same_result(spark, dirs):
    _, out, kept, _ = dirs
    schema = "symbol STRING, seq BIGINT, arrival BIGINT, ts_ns BIGINT"
    monitor = scans.gap_monitor(out, kept)
    batches = [[("A", 1, 1, 1), ("A", 4, 2, 2)], [("A", 9, 3, 3)]]
    for batch_id, rows in enumerate(batches):
        for _ in range(2):
            monitor(spark.createDataFrame(rows, schema), batch_id)
    assert sorted((r.start_id, r.end_id) for r in spark.read.parquet(out).collect()) == [(2, 3), (5, 8)]


def test_subscription(spark, dirs):
    source, _, _, checkpoint = dirs
    got = []
    land(spark, source, [trade("AB"[i % 2], i, i) for i in range(10)])
    spec = feed.feed_spec("binance", "trades")
    finish(feeds.subscribe_foreach(stream(spark, source), spec, "A", lambda df, b: got.extend(df.collect()), checkpoint, fields=["price", "TradeID"]))
    assert sorted(r.TradeID for r in got) == [0, 2, 4, 6, 8] and got[0].asDict().keys() == {"Price", "TradeID"}
    with pytest.raises(ValueError):
        feeds.subscribe_foreach(stream(spark, source), spec, ["A"], print, checkpoint)
    with pytest.raises(ValueError):
        feeds.subscribe_foreach(stream(spark, source), spec, "A", print, checkpoint, fields=["nothing"])


def test_attach_and_restart(spark, dirs):
    source, out, _, checkpoint = dirs
    rows = [trade("A", i, i * 30) for i in range(20)]
    land(spark, source, rows[:10])
    snapshot = batch_bars.trade_bars(spark.createDataFrame(rows[:10], SCHEMA))
    spec = feed.feed_spec("binance", "ohlcv_1m")
    seen = []

    def emit(df, batch_id):
        seen.extend((r.phase, r.Timestamp and int((r.Timestamp - T0).total_seconds() // 60)) for r in df.collect())

    def attach():
        finish(feeds.attach_gapless(snapshot, bars.stream_bars(stream(spark, source), 1, "0 seconds"), spec, emit, checkpoint, include_open_bar=False))

    attach()
    land(spark, source, rows[10:])
    attach()
    assert [m for phase, m in seen if phase == "snapshot"] == [0, 1, 2, 3]
    assert [phase for phase, _ in seen].count("snapshot_boundary") == 1
    assert sorted(m for phase, m in seen if phase == "live") == [4, 5, 6, 7, 8]


def test_consumers_have_cursors_of_their_own(spark, dirs):
    source, _, _, checkpoint = dirs
    got = {"one": 0, "two": 0}

    def count(name, fails=()):
        def run(df, batch_id):
            if batch_id in fails:
                raise RuntimeError("down")
            got[name] += df.count()
        return run

    land(spark, source, [trade("A", 1, 0)])
    land(spark, source, [trade("A", 2, 0)])
    running = feeds.independent_consumers(lambda: stream(spark, source), {"one": count("one"), "two": count("two", fails=(1,))}, checkpoint)
    running["one"].awaitTermination()
    with pytest.raises(Exception, match="down"):
        running["two"].awaitTermination()
    assert got == {"one": 2, "two": 1}
    finish(feeds.independent_consumers(lambda: stream(spark, source), {"two": count("two")}, checkpoint)["two"])
    assert got == {"one": 2, "two": 2}


def test_bars_of_a_silent_symbol_reach_its_subscriber(spark, dirs):
    source, _, _, checkpoint = dirs
    got = []
    land(spark, source, [trade("A", 1, 0), trade("B", 2, 20 * 60)])
    completed = bars.stream_bars(stream(spark, source), 1, "1 minute")
    spec = feed.feed_spec("binance", "ohlcv_1m")
    finish(feeds.subscribe_foreach(completed, spec, "A", lambda df, b: got.extend(df.collect()), checkpoint))
    assert [(r.Symbol, r.Trades) for r in got] == [("A", 1)]


def _events(spark, files, path):
    """The smallest event table as trades, dealt by hash over so many files."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.upper("event_type").alias("Symbol"), F.col("event_id").alias("TradeID"), F.col("ts").cast("timestamp_ntz").alias("Timestamp"),
        F.col("value").alias("Price"), F.lit(1.0).alias("Quantity"), (F.col("event_id") % 2 == 0).alias("IsBuyerMaker"))
    rows.repartition(files, F.xxhash64("TradeID")).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _values(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*TRADE_BAR_COLS).collect())


@pytest.mark.parametrize("files", [1, 60, 257])
def test_no_trade_is_lost_in_any_order_or_number_of_files(spark, dirs, files):
    source, out, kept, checkpoint = dirs
    rows = _events(spark, files, source)
    table = LiveBars(kept, "1 minute", fold_every=2)
    run = table.batch(5, on_changed=state.batch_writer(f"{out}/changed"), on_closed=state.batch_writer(f"{out}/closed"))
    finish(state.start(bars.read_ticks(spark, source, SCHEMA), run, checkpoint))
    fives = batch_bars.trade_bars(rows, 5)
    assert _values(table.bars(spark)) == _values(batch_bars.trade_bars(rows))
    assert _values(table.bars(spark, 5)) == _values(fives)
    newest = rows.agg(F.max("Timestamp")).first()[0]
    closed = fives.filter(F.col("Timestamp") + F.expr("INTERVAL '5' MINUTE") <= F.lit(newest - timedelta(minutes=1)).cast("timestamp_ntz"))
    for name, want in (("changed", fives), ("closed", closed)):
        seen = spark.read.parquet(f"{out}/{name}")
        last = seen.groupBy("Symbol", "Timestamp").agg(F.max("batch_id").alias("batch_id"))
        assert _values(seen.join(last, ["Symbol", "Timestamp", "batch_id"])) == _values(want)


def test_late_trades_change_closed_bars_and_are_reported_again(spark, dirs):
    source, out, kept, checkpoint = dirs
    table = LiveBars(kept, "1 minute", fold_every=2)
    for part in ([trade("A", 5, 10)], [trade("A", 9, 600)], [trade("B", 2, 5), trade("A", 3, 20)], [trade("A", 1, 0), trade("A", 10, 1200)]):
        land(spark, source, part)
        finish(state.start(stream(spark, source), table.batch(1, on_closed=state.batch_writer(out)), checkpoint))
    got = [(r.batch_id, r.Symbol, int((r.Timestamp - T0).total_seconds() // 60), r.Open, r.Close, r.Trades) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [(1, "A", 0, 5.0, 5.0, 1), (2, "A", 0, 5.0, 3.0, 2), (2, "B", 0, 2.0, 2.0, 1), (3, "A", 0, 1.0, 3.0, 3), (3, "A", 10, 9.0, 9.0, 1)]


def test_batches_run_again_and_folds_leave_the_same_bars(spark, dirs):
    _, out, kept, _ = dirs
    rnd = random.Random(3)
    rows = [trade(rnd.choice("AB"), i, rnd.randrange(4 * 86400)) for i in range(48)]
    table, seen = LiveBars(kept, "0 seconds", fold_every=2), []
    for k in range(6):
        for _ in range(1 + k % 2):
            table.batch(1, on_changed=state.batch_writer(f"{out}/changed"), on_closed=state.batch_writer(f"{out}/closed"))(
                spark.createDataFrame(rows[k * 8:(k + 1) * 8], SCHEMA), k)
        so_far = batch_bars.trade_bars(spark.createDataFrame(rows[:(k + 1) * 8], SCHEMA))
        assert _values(table.bars(spark)) == _values(so_far)
        seen.append(spark.read.parquet(f"{out}/changed").filter(F.col("batch_id") == k).filter("first_batch = last_batch").count())
    assert sum(seen) == batch_bars.trade_bars(spark.createDataFrame(rows, SCHEMA)).count()  # each bar is added once
    left = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{kept}/deltas").select("path").collect()]
    assert {int(p.split("batch_id=")[1].split("/")[0]) for p in left} == {2, 3, 4, 5}  # older ones are folded and gone


def test_clock_rows_close_bars_of_the_table(spark, dirs):
    source, out, kept, checkpoint = dirs
    land(spark, source, [trade("A", 1, 0), trade("B", 2, 3)])
    land(spark, f"{source}-beats", [(T0 + timedelta(minutes=9),)], "Timestamp TIMESTAMP_NTZ")
    ticks = bars.with_heartbeats(stream(spark, source), bars.read_ticks(spark, f"{source}-beats", "Timestamp TIMESTAMP_NTZ"))
    table = LiveBars(kept)
    finish(state.start(ticks, table.batch(1, on_closed=state.batch_writer(out)), checkpoint))
    assert sorted((r.Symbol, r.Trades) for r in spark.read.parquet(out).collect()) == [("A", 1), ("B", 1)]
    assert sorted(r.Symbol for r in table.bars(spark).collect()) == ["A", "B"]


def test_a_failed_snapshot_is_attached_again(spark, dirs):
    source, _, kept, checkpoint = dirs
    rows = [trade("A", i, i * 30) for i in range(20)]
    land(spark, source, rows[:10])
    spec, seen, fails = feed.feed_spec("binance", "ohlcv_1m"), [], [True]

    def emit(df, batch_id):
        if batch_id == -1 and fails:
            fails.clear()
            raise RuntimeError("down")
        seen.extend((r.phase, r.Timestamp and int((r.Timestamp - T0).total_seconds() // 60)) for r in df.collect())

    def attach():
        snapshot = batch_bars.trade_bars(spark.createDataFrame(rows[:10], SCHEMA))
        table = LiveBars(kept, "0 seconds")
        finish(feeds.attach_gapless(snapshot, stream(spark, source), spec, emit, checkpoint, include_open_bar=False,
                                    through=lambda f: table.batch(1, on_closed=f)))

    with pytest.raises(RuntimeError):
        attach()
    assert seen == []
    attach()
    land(spark, source, rows[10:])
    attach()
    assert [m for phase, m in seen if phase == "snapshot"] == [0, 1, 2, 3]
    assert [phase for phase, _ in seen].count("snapshot_boundary") == 1
    assert sorted(m for phase, m in seen if phase == "live") == [4, 5, 6, 7, 8]


def test_messages_as_a_stream(spark, dirs):
    source, out, _, checkpoint = dirs
    good = '{"e":"trade","s":"A","t":%d,"p":"1.5","q":"2","T":%d,"b":1,"m":true}'
    steps = [[good % (1, 1000), "", "{", good % (2, 2000)], ['{"stream":"a@trade","data":%s}' % (good % (3, 3000)), '{"t":4,"T":1}', '{"s":"A","T":1}', '{"s":"A","t":5}', "no"]]
    for lines in steps:
        spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.mode("append").text(source)
        finish(state.start(messages.parsed(messages.read_messages(spark, source)), messages.message_writer(out), checkpoint))
    ticks = messages.accepted(spark, out)
    assert sorted((r.seq, r.ts_ns, r.payload.Price, r.batch_id) for r in ticks.collect()) == [(1, 10**9, 1.5, 0), (2, 2 * 10**9, 1.5, 0), (3, 3 * 10**9, 1.5, 1)]
    bad = sorted((r.batch_id, r.value, r.reason) for r in messages.rejected(spark, out).collect())
    assert bad == sorted([(0, "", "not JSON"), (0, "{", "not JSON"), (1, '{"t":4,"T":1}', "no symbol"), (1, '{"s":"A","T":1}', "no id"), (1, '{"s":"A","t":5}', "no time"), (1, "no", "not JSON")])


def test_monitor_keeps_what_subscriptions_report(spark, dirs):
    source, out, _, checkpoint = dirs
    schema = "Symbol STRING, part STRING"
    for rows in ([("A", "added"), ("B", "added"), ("A", "added")], [("A", "updated"), ("A", "completed"), ("B", "updated")], [("A", "added")]):
        land(spark, source, rows, schema)
    monitor, got = FeedMonitor(spark, f"{out}/stats"), []
    running = [monitor.subscribe(stream(spark, source, schema), "p", "s", x, lambda df, b: got.extend(r.part for r in df.collect()), f"{checkpoint}/{x}") for x in "AB"]
    for q in running:
        finish(q)
    monitor.close(running)
    keys = [f"{k}_{p}_rows" for k in ("last", "total") for p in ("added", "updated", "completed")]
    assert {r.symbol: [r[k] for k in keys] + [r.subscriber_count, r.total_handles] for r in monitor.latest().collect()} == {
        "A": [1, 0, 0, 3, 1, 1, 1, 2], "B": [0, 0, 0, 1, 1, 0, 1, 2]}
    assert monitor.history().count() == 6 and len(got) == 7
