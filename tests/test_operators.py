"""Operators on small hand-made tables, with slices small enough that every scan crosses their borders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickbars.operators import bars, batches, bins, catalog, eventlog, feed, filters, gaps, incremental, latest, ordered, paging, quotes, stitch, wire

T0 = datetime(2024, 1, 1, 10)


def at(minute, second=0):
    return T0 + timedelta(minutes=minute, seconds=second)


def trades(spark, rows):
    """(symbol, id, time, price, quantity, maker) rows."""
    return spark.createDataFrame(rows, "Symbol STRING, TradeID BIGINT, Timestamp TIMESTAMP_NTZ, Price DOUBLE, Quantity DOUBLE, IsBuyerMaker BOOLEAN")


def random_trades(spark, n=400, seed=1):
    rnd = random.Random(seed)
    return trades(spark, [(rnd.choice("AAAB"), i, at(rnd.randrange(60), rnd.randrange(60)), rnd.randrange(1, 99) / 4, float(rnd.randrange(4)), rnd.random() < .5) for i in range(n)])


def test_bar_values(spark):
    rows = [("A", 2, at(0, 5), 11.0, 1.0, True), ("A", 1, at(0, 5), 10.0, 2.0, False), ("A", 3, at(0, 50), 9.0, 1.0, True), ("A", 4, at(1), 7.0, 0.0, True)]
    first, second = bars.trade_bars(trades(spark, rows)).orderBy("Timestamp").collect()
    assert (first.Open, first.High, first.Low, first.Close, first.Volume, first.Trades, first.BuyerMakerCount, first.BarId) == (10.0, 11.0, 9.0, 9.0, 4.0, 3, 2, 600)
    assert first.Vwap == (11 + 20 + 9) / 4
    assert (second.Volume, second.Vwap, second.BarId) == (0.0, None, 601)


@pytest.mark.parametrize("period", [5, 15, 60])
def test_rolled_up_bars_equal_direct_bars(spark, period):
    t = random_trades(spark)

    def rows(df):
        return sorted(tuple(r) for r in df.withColumn("Vwap", F.round("Vwap", 6)).collect())
    assert rows(bars.rollup_trade_bars(bars.trade_bars(t), period)) == rows(bars.trade_bars(t, period))


def test_completed_bars_leave_the_newest_open(spark):
    b = bars.trade_bars(trades(spark, [("A", 1, at(0), 1.0, 1.0, True), ("A", 2, at(3), 1.0, 1.0, True), ("B", 3, at(1), 1.0, 1.0, True)]))
    assert [(r.Symbol, r.Timestamp) for r in bars.completed_bars(b).collect()] == [("A", at(0))]


def test_filled_bars(spark):
    t = trades(spark, [("A", 1, at(-700), 1.0, 1.0, True), ("B", 2, at(0), 1.0, 2.0, True), ("C", 3, at(2), 1.0, 3.0, True)])
    rows = sorted((r.Symbol, r.Timestamp, r.IsEmpty) for r in feed.fill_trade_bars(t, F.lit(at(2, 30)), 1).collect())
    assert rows == [("B", at(1), True), ("B", at(2), True), ("C", at(1), True), ("C", at(2), False)]


def test_filled_bars_reach_back_over_midnight(spark):
    midnight = datetime(2024, 1, 2)
    t = trades(spark, [("A", 1, midnight - timedelta(seconds=30), 1.0, 1.0, True), ("A", 2, midnight + timedelta(seconds=3), 1.0, 1.0, True),
                       ("B", 3, midnight - timedelta(seconds=30), 1.0, 1.0, True)])
    rows = sorted((r.Symbol, r.Timestamp, r.IsEmpty) for r in feed.fill_trade_bars(t, F.lit(midnight + timedelta(seconds=9)), 1).collect())
    assert rows == [("A", midnight - timedelta(minutes=1), False), ("A", midnight, False)]


def test_history_spine_crosses_days(spark):
    t = trades(spark, [("A", 1, datetime(2024, 1, 1, 23, 57), 1.0, 1.0, True), ("A", 2, datetime(2024, 1, 3, 0, 2), 1.0, 1.0, True)])
    filled = bins.fill_history(bars.trade_bars(t), 1)
    assert filled.count() == 3 + 1440 + 3 and filled.filter("NOT IsEmpty").count() == 2
    assert bins.empty_bars(filled).columns == ["Symbol", "Timestamp", "IsEmpty"]


@pytest.mark.parametrize("arguments", [(0, 2), (1, 0)])
def test_bins_need_positive_arguments(spark, arguments):
    with pytest.raises(ValueError):
        bins.bins_recent(spark, F.lit(T0), *arguments)


def test_bins_recent(spark):
    assert [r[0] for r in bins.bins_recent(spark, F.lit(at(7, 5)), 5, 3).orderBy("Timestamp").collect()] == [at(-5), at(0), at(5)]


def _ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol STRING, arrival BIGINT, seq BIGINT")


def _arrival(df, **kw):
    out = gaps.seq_gaps_arrival(df, "symbol", "seq", "arrival", F.col("arrival"), **kw)
    return sorted((r.symbol, r.start_id, r.end_id) for r in out.collect())


def test_gap_monitor_scenarios(spark):
    assert _arrival(_ticks(spark, [("A", 1, 1), ("A", 1, 2), ("A", 2, 3), ("A", 2, 4)])) == []
    assert _arrival(_ticks(spark, [("A", 10, 1), ("A", 11, 4)])) == [("A", 2, 3)]


@pytest.mark.parametrize("width", [1, 2, 1000])
def test_late_id_closes_a_gap_of_the_set_only(spark, width):
    df = _ticks(spark, [("A", 1, 1), ("A", 2, 4), ("A", 3, 2)])
    assert _arrival(df, width=width) == [("A", 2, 3)]
    assert [(r.start_id, r.end_id) for r in gaps.seq_gaps_sorted(df, "symbol", "seq", width=width).collect()] == [(3, 3)]


def test_gaps_with_lookback_and_stored_cursor(spark):
    df = _ticks(spark, [("A", 1, 50), ("B", 2, 5)])
    assert _arrival(df, lookback_ids=10) == [("A", 40, 49)]
    seen = spark.createDataFrame([("A", 47), ("B", 9)], "symbol STRING, max_seen BIGINT")
    assert _arrival(df, seen_before=seen) == [("A", 48, 49)]
    assert sorted(tuple(r) for r in gaps.highest_seen(df, "symbol", "seq", seen).collect()) == [("A", 50), ("B", 9)]


@pytest.mark.parametrize("width", [1, 7, 64, None])
def test_gap_scans_match_a_loop(spark, width):
    rnd = random.Random(5)
    rows = [(rnd.choice("AAB"), i, rnd.randrange(1, 600)) for i in range(300)]
    want, high = [], {}
    for symbol, _, seq in rows:
        if symbol in high and seq > high[symbol] + 1:
            want.append((symbol, high[symbol] + 1, seq - 1))
        high[symbol] = max(high.get(symbol, seq), seq)
    df = _ticks(spark, rows)
    assert _arrival(df, width=width, rows_per_slice=10) == sorted(want)

    of_set = []
    for symbol in "AB":
        ids = sorted({s for k, _, s in rows if k == symbol})
        of_set += [(symbol, a + 1, b - 1) for a, b in zip(ids, ids[1:]) if b - a > 1]
    got = gaps.seq_gaps_sorted(df, "symbol", "seq", width=width, rows_per_slice=10)
    assert sorted((r.symbol, r.start_id, r.end_id) for r in got.collect()) == of_set

    merged = []
    for symbol, start, end in of_set:
        if merged and merged[-1][0] == symbol and start <= merged[-1][2] + 1 + 2:
            merged[-1] = (symbol, merged[-1][1], end)
        else:
            merged.append((symbol, start, end))
    assert sorted((r.symbol, r.start_id, r.end_id) for r in gaps.merge_gaps(got, 2, width=width, rows_per_slice=10).collect()) == merged


def test_tasks_and_refill(spark):
    g = spark.createDataFrame([("A", 1, 12001), ("B", 5, 5)], "symbol STRING, start_id BIGINT, end_id BIGINT")
    tasks = gaps.plan_backfill_tasks(g, 5000)
    assert sorted((r.symbol, r.start_id, r.end_id) for r in tasks.collect()) == [("A", 1, 5000), ("A", 5001, 10000), ("A", 10001, 12001), ("B", 5, 5)]
    assert tasks.select("task_id").distinct().count() == 4 and tasks.filter("status = 'pending' AND try_count = 0").count() == 4
    again = {r.task_id for r in gaps.plan_backfill_tasks(g, 5000).collect()}
    assert again == {r.task_id for r in tasks.collect()}
    rows = spark.createDataFrame([("A", 1), ("A", 1), ("A", 5000), ("A", 5001), ("A", 12002), ("B", 4)], "symbol STRING, seq BIGINT")
    filled = {(r.symbol, r.start_id): r.rows for r in gaps.fill_gap_rows(rows, tasks).collect()}
    assert filled == {("A", 1): 2, ("A", 5001): 1, ("A", 10001): 0, ("B", 5): 0}
    assert gaps.rows_in_tasks(rows, tasks, bucket=7).count() == 3


def test_coverage_by_masks_equals_counting(spark):
    rnd = random.Random(11)
    spans = [("A", -130, -65), ("A", -64, -1), ("A", 0, 63), ("A", 64, 64), ("A", 127, 128), ("A", 100, 700), ("B", 0, 1), (None, 0, 9)]
    tasks = spark.createDataFrame([(f"t{i}", *x) for i, x in enumerate(spans)], "task_id STRING, symbol STRING, start_id BIGINT, end_id BIGINT")
    ids = [(rnd.choice(["A", "A", "A", "B", None]), rnd.randrange(-140, 720)) for _ in range(900)] + [("A", None), ("A", -130), ("A", 63), ("A", 64), ("A", 128)]
    rows = spark.createDataFrame(ids + ids[:100], "symbol STRING, seq BIGINT")
    want = {f"t{i}": len({q for k, q in ids if k == s and s is not None and q is not None and a <= q <= b}) for i, (s, a, b) in enumerate(spans)}
    assert {r.task_id: r.rows for r in gaps.fill_gap_rows(rows, tasks).collect()} == want
    assert {r.task_id: r.rows for r in gaps.fill_gap_rows(None, tasks, masks=gaps.id_masks(rows)).collect()} == want
    assert {r.task_id: r.rows for r in gaps.fill_gap_rows(rows.limit(0), tasks).collect()} == dict.fromkeys(want, 0)
    found = {r.task_id: r["count"] for r in gaps.rows_in_tasks(rows, tasks, bucket=50).groupBy("task_id").count().collect()}
    assert found == {k: n for k, n in want.items() if n}


def test_one_long_gap_is_cut_in_blocks(spark):
    g = spark.createDataFrame([("A", 1, 250_000)], "symbol STRING, start_id BIGINT, end_id BIGINT")
    tasks = gaps.plan_backfill_tasks(g, 10)
    assert tasks.count() == 25_000 and tasks.agg(F.sum(F.col("end_id") - F.col("start_id") + 1)).first()[0] == 250_000


def _updates(spark, rows):
    return spark.createDataFrame(rows, "sub_key STRING, arrival BIGINT, lp DOUBLE, bid DOUBLE, ask DOUBLE, volume DOUBLE, lp_time_ns BIGINT")


def test_volume_increments(spark):
    rows = [("K", i, None, None, None, v, None) for i, v in enumerate([100.0, 130.0, 120.0, 150.0])]
    out = quotes.quote_state(_updates(spark, rows)).orderBy("arrival").collect()
    assert [r.vol_delta for r in out] == [0.0, 30.0, 0.0, 30.0]


@pytest.mark.parametrize("width", [1, 7, None])
def test_quote_state_matches_a_loop(spark, width):
    rnd = random.Random(9)

    def some(v):
        return v if rnd.random() < .4 else None
    rows = [(rnd.choice("AAB"), i, some(float(i)), some(i + .5), some(i + .25), some(float(rnd.randrange(50))), some(i * 10)) for i in range(200)]
    want, state = {}, {}
    for key, i, *values in rows:
        old = state.get(key, [None] * 5)
        new = [v if v is not None else o for v, o in zip(values, old)]
        delta = None if new[3] is None else (0.0 if old[3] is None else max(new[3] - old[3], 0.0))
        state[key], want[i] = new, (*new, delta)
    df = _updates(spark, rows)
    got = quotes.quote_state(df, width=width, rows_per_slice=10)
    assert {r.arrival: (r.lp, r.bid, r.ask, r.volume, r.lp_time_ns, r.vol_delta) for r in got.collect()} == want

    head, tail = df.filter("arrival < 90"), df.filter("arrival >= 90")
    resumed = quotes.quote_state(tail, stored=quotes.last_state(head), width=width, rows_per_slice=10)
    assert {r.arrival: (r.lp, r.bid, r.ask, r.volume, r.lp_time_ns, r.vol_delta) for r in resumed.collect()} == {i: w for i, w in want.items() if i >= 90}
    both = quotes.last_state(tail, stored=quotes.last_state(head)).collect()
    assert {r.sub_key: [r.lp, r.bid, r.ask, r.volume, r.lp_time_ns] for r in both} == state


def test_material_quotes_and_arrival_time(spark):
    rows = [("K", 1, None, None, None, 5.0, None), ("K", 2, None, None, None, 9.0, None), ("K", 3, 1.0, None, None, None, 77)]
    merged = quotes.quote_state(_updates(spark, rows), arrival_ns=F.col("arrival") * 1000)
    assert [(r.arrival, r.lp_time_ns) for r in quotes.material_quotes(merged).orderBy("arrival").collect()] == [(2, 2000), (3, 77)]


@pytest.mark.parametrize("width", [1, 50, None])
def test_row_numbers_over_slices(spark, width):
    df = spark.createDataFrame([("A" if i % 3 else "B", (i * 37) % 101, i) for i in range(200)], "k STRING, t BIGINT, i BIGINT")
    got = ordered.numbered(df, ["k"], "t", "i", width=width, rows_per_slice=10).collect()
    for key in "AB":
        mine = sorted((r.t, r.i, r.row_no) for r in got if r.k == key)
        assert [r[2] for r in mine] == list(range(1, len(mine) + 1))


def _journal(spark, rows):
    return spark.createDataFrame(rows, "provider STRING, stream STRING, symbol STRING, ts_ns BIGINT, seq BIGINT, is_final BOOLEAN, batch_id BIGINT, payload STRING")


def test_final_rows_are_never_downgraded(spark):
    df = _journal(spark, [("p", "s", "A", 1, 5, False, 1, "x"), ("p", "s", "A", 2, 5, True, 2, "y"), ("p", "s", "A", 3, 5, False, 3, "z"), ("p", "s", "A", 9, None, False, 3, "w")])
    assert sorted((r.nat_key, r.payload) for r in latest.canonical_upsert(df).collect()) == [(5, "y"), (9, "w")]


def test_one_pass_rank_equals_batch_by_batch_upserts(spark):
    rnd = random.Random(3)
    rows = [("p", "s", rnd.choice("AB"), rnd.randrange(50), rnd.choice([None, 1, 2, 3]), rnd.random() < .3, b, f"{b}-{i}") for b in range(6) for i in range(12)]
    df = _journal(spark, rows)
    cols = [*df.columns, "nat_key"]
    stored = latest.canonical_upsert(df.filter("batch_id = 0"), ["payload"]).select(*cols)
    for b in range(1, 6):
        batch = latest.with_natural_key(df.filter(F.col("batch_id") == b))
        best = latest.canonical_upsert(batch, ["payload"]).select(*cols)
        updated = latest.update_matching_keys(stored, best)
        stored = spark.createDataFrame(updated.unionByName(latest.insert_new_keys(stored, best)).collect(), updated.schema)
    whole = latest.canonical_upsert(df, ["payload"]).select(*cols)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_dedupe_keeps_the_last(spark):
    b = spark.createDataFrame([("cme", "a", T0, 1.0, 1), ("CME", "A", T0, 2.0, 2)], "Exchange STRING, Symbol STRING, Timestamp TIMESTAMP_NTZ, Close DOUBLE, arrival BIGINT")
    assert [(r.Exchange, r.Close) for r in latest.dedupe_bars(b).collect()] == [("CME", 2.0)]
    t = trades(spark, [("A", 1, at(0), 1.0, 1.0, True), ("A", 1, at(1), 2.0, 1.0, True), ("B", 1, at(0), 3.0, 1.0, True)])
    assert sorted(r.Price for r in latest.dedupe_trades(t).collect()) == [2.0, 3.0]


def test_deleted_configs_are_hidden(spark):
    c = spark.createDataFrame([("p", "a", False, 1), ("p", "a", True, 2), ("p", "b", True, 1), ("p", "b", False, 2)], "provider STRING, name STRING, deleted BOOLEAN, seqcol BIGINT")
    assert [r.name for r in latest.live_configs(c).collect()] == ["b"]


def _unified(spark, rows):
    df = spark.createDataFrame(rows, "Exchange STRING, Symbol STRING, Timestamp TIMESTAMP_NTZ, Close DOUBLE, IsFinal BOOLEAN, arrival BIGINT")
    return df.withColumns({c: F.col("Close") for c in ("Open", "High", "Low", "Volume")})


def test_stitching(spark):
    vendor = _unified(spark, [("CME", "A", at(m), 1.0, True, m) for m in range(6)])
    provisional = _unified(spark, [("CME", "A", at(m), 2.0, False, 0) for m in range(4, 8)] + [("CME", "B", at(1), 3.0, False, 0)])
    rows = sorted((r.Symbol, r.Timestamp, r.Close, r.IsFinal) for r in stitch.stitch_bars(vendor, provisional).collect())
    assert rows == [("A", at(m), 1.0, True) for m in range(6)] + [("A", at(6), 2.0, False), ("A", at(7), 2.0, False), ("B", at(1), 3.0, False)]


def test_five_minute_bar_is_final_when_all_parts_are(spark):
    df = _unified(spark, [("CME", "A", at(m), float(m), m < 7, 0) for m in range(10)]).withColumn("BarId", F.lit(0))
    assert [(r.Open, r.Close, r.IsFinal, r.BarId) for r in bars.rollup_unified_bars(df, 5).orderBy("Timestamp").collect()] == [(0.0, 4.0, True, 120), (5.0, 9.0, False, 121)]


def test_watermarks(spark):
    def mark(rows, bar=True):
        return {r.Symbol: r.watermark_ns for r in feed.gapless_watermark(_unified(spark, rows), ["Symbol"], bars=bar).collect()}

    def ns(minute):
        return int((at(minute) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000
    rows = [("CME", "A", at(m), 1.0, m < 3, 0) for m in range(4)]
    assert mark(rows) == {"A": ns(2)} and mark(rows[:3]) == {"A": ns(2)} and mark(rows[3:]) == {"A": ns(3)} and mark(rows, bar=False) == {"A": ns(3)}


def test_gapless_feed_has_every_row_once(spark):
    everything = bars.trade_bars(random_trades(spark))
    snapshot = everything.filter(F.col("Timestamp") < F.lit(at(30)))
    marks = feed.gapless_watermark(snapshot, ["Symbol"])
    out = feed.gapless_feed(snapshot, everything, marks, ["Symbol"], include_open_bar=False)
    rows = out.filter("phase <> 'snapshot_boundary'")
    assert rows.count() == everything.count() == rows.select("Symbol", "Timestamp").distinct().count()
    assert out.filter("phase = 'snapshot_boundary'").count() == 2
    again = feed.gapless_feed(snapshot, everything, marks, ["Symbol"])
    assert again.count() == out.count() + 2


def test_filters(spark):
    t = random_trades(spark, 50)
    assert filters.filter_symbol(t, []).count() == 0 and filters.filter_symbol(t, "A").count() + filters.filter_symbol(t, ["B"]).count() == 50
    assert filters.filter_exchange(t, "x") is t
    assert filters.project_fields(t, ["nothing"]) is None and filters.project_fields(t, None) is t
    assert filters.project_fields(t, ["price", "SYMBOL"]).columns == ["Symbol", "Price"]
    assert filters.project_fields(t, ["price", "Quantity"], ("Timestamp", "Symbol"), case_sensitive=True).columns == ["Symbol", "Timestamp", "Quantity"]


def test_time_bounds(spark):
    t = trades(spark, [("A", i, T0 + timedelta(milliseconds=500 * i), 1.0, 1.0, True) for i in range(6)])
    ns = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000
    assert filters.filter_time_range(t, "Timestamp", ns + 500_000_000, ns + 1_500_000_000).count() == 3
    assert filters.filter_time_range(t, "Timestamp", ns + 500_000_000, ns + 1_500_000_000, "second").count() == 3
    assert filters.filter_time_range(t, "Timestamp", ns + 500_000_001).count() == 4
    assert filters.filter_time_range(t, "Timestamp", ns + 900_000_000, None, "second").count() == 6


def test_pages_cover_everything_once(spark):
    rows = spark.createDataFrame([(i // 3, f"k{i}") for i in range(10)], "ts_ns BIGINT, key STRING")
    seen, cursor = [], (0, None)
    while True:
        page = paging.keyset_page(rows, cursor[0], "key", cursor[1], page_rows=4).collect()
        if not page:
            break
        seen += [r.key for r in page]
        cursor = (page[-1].ts_ns, page[-1].key)
    assert seen == [f"k{i}" for i in range(10)]


def test_fetch_windows(spark):
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol STRING")
    marks = spark.createDataFrame([("A", at(-60)), ("B", at(10))], "symbol STRING, watermark TIMESTAMP_NTZ")
    out = sorted((r.symbol, r.window_start, r.n_bars) for r in paging.fetch_window(symbols, marks, F.lit(T0)).collect())
    start = T0 - timedelta(days=10)
    assert out == [("A", at(-65), 65), ("B", at(5), 1), *[("C", start + timedelta(minutes=m), n) for m, n in ((0, 5000), (5000, 5000), (10000, 4400))]]


def test_repaint_windows_and_watermarks(spark):
    rows = [(s, at(m)) for s in "ABC" for m in range(3 if s == "C" else 8)]
    df = spark.createDataFrame(rows, "symbol STRING, datetime TIMESTAMP_NTZ")
    marks = spark.createDataFrame([("A", at(1)), ("C", at(1))], "symbol STRING, watermark TIMESTAMP_NTZ")
    out = paging.repaint_overlap(df, marks, ["symbol"])
    assert {r.symbol: r["count"] for r in out.groupBy("symbol").count().collect()} == {"A": 5, "B": 8, "C": 3}
    assert {r.symbol: r.watermark for r in incremental.advance_watermarks(marks, out, ["symbol"]).collect()} == {"A": at(7), "B": at(7), "C": at(2)}


def test_late_trades_touch_their_days_only(spark):
    t = random_trades(spark)
    late = t.filter("TradeID % 11 = 0 AND Symbol = 'A'")
    stored = bars.trade_bars(t.exceptAll(late))
    fixed = incremental.reaggregate_late(stored, t, late)
    assert fixed.exceptAll(bars.trade_bars(t)).count() == 0 and fixed.count() == bars.trade_bars(t).count()


def test_envelopes_split_and_return(spark):
    df = _journal(spark, [("p", "s", "A", i % 7, i, True, i // 25, f"{i}") for i in range(60)])
    packed = batches.envelope_pack(df, "seq", rows_per_envelope=10)
    assert sorted((r.batch_id, r.part_no, r.row_count) for r in packed.collect()) == [(0, 0, 10), (0, 1, 10), (0, 2, 5), (1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10)]
    for r in packed.collect():
        assert [x.ts_ns for x in r.rows] == sorted(x.ts_ns for x in r.rows)
    back = batches.envelope_unpack(packed)
    assert back.exceptAll(df.select(*back.columns)).count() == 0 and back.count() == 60


def test_retention_and_cursors(spark):
    df = spark.range(1, 201).select(F.col("id").alias("batch_id"))
    assert batches.retain_batches(df, 150).agg(F.min("batch_id")).first()[0] == 51 and batches.pruned_count(df, 150).first()[0] == 50
    assert batches.retain_batches(df, 90).count() == 200 and batches.pruned_count(df, 90).first()[0] == 0
    marks = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("b", 9, 1)], "scope STRING, last_offset BIGINT, seqcol BIGINT")
    assert sorted(tuple(r) for r in batches.named_watermarks(marks).collect()) == [("a", 3), ("b", 9)]
    assert batches.watermark_of(marks, "none").first()[0] == 0 and batches.watermark_of(marks, "a").first()[0] == 3


def _feed_rows(spark, n):
    rows = [("p", "ohlcv_1m", "A", "snapshot" if i < n // 2 else "live", "completed", 99, i, (f"2024-01-01T10:{i:02d}:00Z", "A", float(i))) for i in range(n)]
    rows.append(("p", "ohlcv_1m", "A", "snapshot_boundary", None, 99, None, None))
    return spark.createDataFrame(rows, "provider STRING, data_schema STRING, symbol STRING, phase STRING, part STRING, watermark_ns BIGINT, at BIGINT, row STRUCT<Timestamp: STRING, Symbol: STRING, Close: DOUBLE>")


@pytest.mark.parametrize("size", [1, 4, 100])
def test_wire_round_trip(spark, size):
    out = wire.wire_envelope(_feed_rows(spark, 20), "at", row_type="bar", rows_per_envelope=size)
    sequence = sorted((r.seq, r.phase, r.row_count) for r in out.collect())
    assert [s[0] for s in sequence] == list(range(len(sequence)))
    phases = [s[1] for s in sequence]
    assert phases == sorted(phases, key=["snapshot", "snapshot_boundary", "live"].index) and sum(s[2] for s in sequence) == 20
    parsed = wire.parse_envelope(out)
    rows = wire.bar_rows(parsed).collect()
    assert sorted((r.timestamp, r.close) for r in rows) == [(at(i), float(i)) for i in range(20)]
    assert {(r.phase, r.watermark_ns) for r in parsed.collect()} == {("snapshot", 99), ("snapshot_boundary", 99), ("live", None)}


def test_envelopes_of_other_senders(spark):
    texts = ['{"data_schema": "trades", "provider": "p", "rows": [{"Symbol": "A", "Ts": 1700000000, "Price": "1.5", "TradeID": 7}], "meta": {"seq": 3}}',
             '{"version": 2, "data_schema": "ohlcv_5m", "rows": [{"Symbol": "A", "Timestamp": "2024-01-01T10:00:00Z", "Open": "x", "Close": 2, "Closed": true}]}']
    raw = spark.createDataFrame([(t,) for t in texts], "value STRING")
    parsed = wire.parse_envelope(raw)
    assert sorted((r.row_type, r.phase, r.untested, r.seq) for r in parsed.collect()) == [("bar", "live", True, None), ("trade", "live", False, 3)]
    t = wire.trade_rows(parsed).first()
    assert (t.price, t.trade_id, t.timestamp) == (1.5, "7", datetime(2023, 11, 14, 22, 13, 20))
    b = wire.bar_rows(parsed).first()
    assert (b.open, b.close, b.closed) == (None, 2.0, True)
    with pytest.raises(Exception, match="version too old"):
        wire.parse_envelope(spark.createDataFrame([('{"version": 0}',)], "value STRING")).collect()


def test_shapes(spark):
    b = bars.trade_bars(trades(spark, [("A", 1, at(0), 1.0, 1.0, True)]))
    r = wire.shape_bar_row(b, "p", "ohlcv_1m", "snapshot").first()
    assert (r.Type, r.Phase, r.Timestamp, r.Exchange, r.BarId, r.Res, r.Closed) == ("bar", "snapshot", "2024-01-01T10:00:00Z", None, 600, "1m", True)
    assert wire.shape_bar_row(b, "p", "x", "added", ["Close"]).columns == ["Type", "Phase", "Provider", "Symbol", "Timestamp", "Close", "Res", "Closed"]


def test_heartbeats(spark):
    rows = [("s", "n", "r", "starting", at(0), at(0), None, "{\"a\":1}", 1), ("s", "n", "r", "running", at(0), at(2), None, None, 2), ("s", "m", "r", "error", at(5), at(0), "bad", None, 1)]
    df = spark.createDataFrame(rows, "service STRING, name STRING, role STRING, state STRING, started_at TIMESTAMP_NTZ, last_heartbeat TIMESTAMP_NTZ, last_error STRING, meta STRING, seqcol BIGINT")
    out = {r.name: (r.state, r.uptime_s, r.last_error, r.meta) for r in eventlog.heartbeats(df).collect()}
    assert out == {"n": ("running", 120, "", "{\"a\":1}"), "m": ("error", 0, "bad", "{}")}


def test_snapshot_arguments(spark):
    sources = {"trades": random_trades(spark, 20).withColumns({"BuyerID": F.lit(1), "SellerID": F.lit(2)})}
    with pytest.raises(ValueError):
        feed.snapshot_range(sources, "binance", "nothing", "A")
    with pytest.raises(ValueError):
        feed.snapshot_range(sources, "binance", "trades", ["A"])
    assert feed.list_feeds("binance") == [("binance", "trades"), ("binance", "ohlcv_1m"), ("binance", "ohlcv_5m")]
    assert feed.snapshot_range(sources, "binance", "trades", "A", fields=["Price"]).columns == ["Timestamp", "Symbol", "Price"]


def test_public_tables(spark):
    def empty(*cols):
        return spark.createDataFrame([], ", ".join(cols))

    log = empty("service STRING", "name STRING", "role STRING", "state STRING", "started_at TIMESTAMP_NTZ", "last_heartbeat TIMESTAMP_NTZ", "last_error STRING", "meta STRING", "seqcol BIGINT")
    t = random_trades(spark, 30).withColumns({"EventType": F.lit("trade"), "EventTime": F.col("Timestamp"), "BuyerID": F.lit(1), "SellerID": F.lit(2)})
    quotes_table = t.select(F.lit("CME").alias("Exchange"), "Symbol", F.col("Timestamp").alias("LpTime"), F.col("Price").alias("LastPrice"), F.col("Price").alias("Bid"),
                            F.col("Price").alias("Ask"), F.col("Quantity").alias("Volume"), F.lit(None).cast("double").alias("Change"),
                            F.lit(None).cast("double").alias("ChangePct"), F.col("Quantity").alias("VolDelta"), F.col("TradeID").alias("arrival"))
    vendor = _unified(spark, [("cme", "a", at(m), 1.0, True, m) for m in range(6)])
    sources = {"trades": t, "quotes": quotes_table, "bars": vendor, "heartbeats": log,
               "eventlog": empty("ts TIMESTAMP", *[f"{c} STRING" for c in ("service", "name", "role", "level", "code", "message", "meta", "corr_id", "parent_corr_id")]),
               "status": empty("provider STRING", "feeder STRING", "alive BOOLEAN", "seqcol BIGINT"), "configs": empty("provider STRING", "name STRING", "deleted BOOLEAN", "seqcol BIGINT"),
               "changes": empty("provider STRING", "schema STRING", "symbol STRING", "part STRING", "batch_id BIGINT")}
    sizes = {name: catalog.table(name, sources, F.lit(at(59, 59))).count() for name in catalog.TABLES}
    assert sizes["binance_trades"] == 30 and sizes["bins_1m_recent"] == 2 and sizes["binance_ohlcv_5m_filled"] == 4 and sizes["tv_bars_deduped"] == 6
    assert sizes["tv_bars_1m"] >= 6 and sizes["status"] == sizes["fanout_stats"] == 0
    assert tuple(catalog.table("binance_ohlcv_1m_filled", sources, F.lit(at(1))).columns)[-1] == "IsEmpty"
    with pytest.raises(ValueError):
        catalog.table("nothing", sources)


@pytest.mark.parametrize("width", [1, None])
def test_updates_of_one_message_keep_their_order(spark, width):
    rows = [("K", 1, 0, 1.0, 10.0), ("K", 1, 1, None, 30.0), ("K", 1, 2, 3.0, 20.0), ("K", 2, 0, None, 50.0)]
    df = spark.createDataFrame(rows, "sub_key STRING, arrival BIGINT, pos INT, lp DOUBLE, volume DOUBLE").repartition(4)
    out = quotes.quote_state(df, ties=["pos"], width=width).orderBy("arrival", "pos").collect()
    assert [(r.lp, r.vol_delta) for r in out] == [(1.0, 0.0), (1.0, 20.0), (3.0, 0.0), (3.0, 30.0)]
    assert tuple(quotes.last_state(df, ties=["pos"]).first()) == ("K", 3.0, 50.0)


def test_a_burst_is_cut_like_any_other_time(spark):
    df = spark.range(3000).select(F.lit("A").alias("symbol"), (F.col("id") * 2).alias("seq"), F.when(F.col("id") < 2900, F.col("id")).otherwise(10 ** 12 + F.col("id")).alias("arrival"))
    sliced = ordered.with_slices(df, "arrival", rows_per_slice=100)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 400
    assert len(_arrival(df, rows_per_slice=100)) == 2999


def test_clock_is_a_stream(spark):
    from tickbars.streaming.bars import clock
    assert clock(spark).isStreaming and clock(spark).columns == ["Timestamp"]


@pytest.mark.parametrize("rows_per_slice", [1, 2, 10, 1_000_000])
def test_null_keys_and_null_order_over_slices(spark, rows_per_slice):
    """The same rows however the scan is cut, with null keys, null order values and ties."""
    ids = [1, 2, 5, 6, 9, 10, 14]
    ticks = spark.createDataFrame([(k, i, i * 10) for k in (None, "A") for i in ids], "symbol STRING, seq BIGINT, arrival BIGINT")
    gaps_found = [(3, 4), (7, 8), (11, 13)]
    for found in (gaps.seq_gaps_sorted(ticks, "symbol", "seq", rows_per_slice=rows_per_slice),
                  gaps.seq_gaps_arrival(ticks, "symbol", "seq", "arrival", F.col("arrival"), rows_per_slice=rows_per_slice)):
        assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == sorted([(k, a, b) for k in (None, "A") for a, b in gaps_found], key=str)
    marked = spark.createDataFrame([(k, t, i) for k in (None, "A") for i, t in enumerate([None, None, 3, 3, 3, 7, 20])], "k STRING, t BIGINT, i BIGINT")
    got = ordered.numbered(marked, ["k"], "t", "i", rows_per_slice=rows_per_slice).collect()
    assert sorted(((r.k, r.i, r.row_no) for r in got), key=str) == sorted([(k, i, i + 1) for k in (None, "A") for i in range(7)], key=str)
    merged = gaps.merge_gaps(spark.createDataFrame([(k, a, b) for k in (None, "A") for a, b in [(1, 5), (4, 9), (11, 12), (13, 20)]], "symbol STRING, start_id BIGINT, end_id BIGINT"), rows_per_slice=rows_per_slice)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([(k, a, b) for k in (None, "A") for a, b in [(1, 9), (11, 20)]], key=str)
    updates = spark.createDataFrame([(k, i, v, v) for k in (None, "A") for i, v in enumerate([1.0, None, 4.0, None])], "sub_key STRING, arrival BIGINT, lp DOUBLE, volume DOUBLE")
    out = quotes.quote_state(updates, fields=("lp", "volume"), rows_per_slice=rows_per_slice).collect()
    assert sorted(((r.sub_key, r.arrival, r.lp, r.vol_delta) for r in out), key=str) == sorted(
        [(k, i, v, d) for k in (None, "A") for i, (v, d) in enumerate([(1.0, 0.0), (1.0, 0.0), (4.0, 3.0), (4.0, 0.0)])], key=str)


def test_a_long_range_is_fetched_in_several_windows(spark):
    symbols = spark.createDataFrame([("A",)], "symbol STRING")
    marks = spark.createDataFrame([], "symbol STRING, watermark TIMESTAMP_NTZ")
    out = paging.fetch_window(symbols, marks, F.lit(T0), days_back=10, max_bars=5000).orderBy("window_start").collect()
    assert [r.n_bars for r in out] == [5000, 5000, 4400] and out[-1].window_end == T0
    assert all(a.window_end == b.window_start for a, b in zip(out, out[1:]))


def test_blocks_count_as_tasks_do_and_stay_few(spark):
    """Ids per task by blocks equal a plain count, over slice borders, and a long gap is few rows until it is spread out."""
    rng = random.Random(4)
    spans = [("A", 3, 3), ("A", 10, 74), ("A", 80, 420), ("B", 1, 9), (None, 5, 20), ("C", 0, 1_000_000)]
    ids = [(rng.choice(["A", "B", "C", None]), rng.choice([None, *range(430)])) for _ in range(900)]
    rows = spark.createDataFrame(ids + ids[:50], "symbol string, seq long")
    blocks = gaps.gap_blocks(spark.createDataFrame(spans, "symbol string, start_id long, end_id long"), 10, tasks_per_block=20_000)
    assert blocks.count() == 11
    found = gaps.fill_blocks(rows, blocks, 10, rows_per_slice=40)
    assert found.count() == 11
    got = {(r.symbol, r.start_id, r.end_id): r.found for r in gaps.block_task(found, "found", 10).collect()}
    want = {(s, a, min(a + 9, end)): len({i for k, i in ids if s and k == s and i is not None and a <= i <= min(a + 9, end)})
            for s, start, end in spans for a in range(start, end + 1, 10)}
    assert got == want


def test_blocks_remember_what_is_done(spark):
    blocks = spark.createDataFrame([("A", 1, 25)], "symbol string, start_id long, end_id long")
    filled = lambda *found: spark.createDataFrame([("A", 1, 25, list(found))], "symbol string, start_id long, end_id long, found array<int>")
    once = gaps.block_outcomes(gaps.pending_blocks(blocks, 10), filled(10, 4, 0), 1, 10)
    twice = gaps.block_outcomes(once, filled(10, 10, 0), 2, 10)
    assert [tuple(x) for x in once.first().tasks] == [(1, 0), (1, 6), (1, 5)]
    assert [tuple(x) for x in twice.first().tasks] == [(1, 0), (2, 0), (2, 5)]


def test_outcomes_of_blocks_do_not_pass_the_driver(spark):
    """Rows that hold what came need no join; others meet it by shuffle, for files of arrays are far smaller than their rows."""
    found = spark.createDataFrame([("A", 1, 25, [10, 4, 0])], "symbol string, start_id long, end_id long, found array<int>")
    joined = gaps.block_outcomes(gaps.pending_blocks(found.drop("found"), 10), found, 1, 10)
    own = gaps.block_outcomes(gaps.pending_blocks(found, 10), None, 1, 10)
    assert [tuple(x) for x in own.first().tasks] == [tuple(x) for x in joined.first().tasks] == [(1, 0), (1, 6), (1, 5)]
    assert own.first().found == [10, 4, 0]
    for df in (joined, own):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
