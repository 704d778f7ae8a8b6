"""Sinks: routing, journal, canonical table, layout, text."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickbars.operators import eventlog, latest
from tickbars.sinks import tables
from tickbars.streaming import state

TICK = "provider STRING, stream STRING, symbol STRING, ts_ns BIGINT, seq BIGINT, is_final BOOLEAN, payload STRING"


def ticks(spark):
    return spark.createDataFrame([
        ("binance", "trades", "A", 1_000_000, 1, True, '{"Price": 1.5, "Quantity": 2.0, "BuyerID": 3, "SellerID": 4, "IsBuyerMaker": true}'),
        ("binance", "trades", "A", 2_000_000, 2, True, "not json"),
        ("tradingview", "quotes", "B", 3_000_000, None, False, '{"exchange": "CME", "last_price": 9.0, "vol_delta": 1.0}'),
        ("tradingview", "bars", "CME:B", 4_000_000, None, True, '{"exchange": "CME", "symbol": "B", "open": 1.0, "close": 2.0}'),
        ("other", "x", "C", 5_000_000, None, True, "{}"),
        ("other", "x", "C", 6_000_000, None, True, "{}"),
    ], TICK)


def test_routing_is_repeatable(spark, tmp_path):
    write = tables.route_by_stream(str(tmp_path), event_log=str(tmp_path / "log"))
    for _ in range(2):
        write(ticks(spark), 0)
    trades = spark.read.parquet(str(tmp_path / "trades")).orderBy("TradeID").collect()
    assert [(r.Price, r.BuyerID, r.IsBuyerMaker) for r in trades] == [(1.5, 3, True), (0.0, 0, False)]
    assert [(r.Exchange, r.Symbol, r.LastPrice) for r in spark.read.parquet(str(tmp_path / "quotes")).collect()] == [("CME", "B", 9.0)]
    assert [(r.Symbol, r.Close, r.IsFinal) for r in spark.read.parquet(str(tmp_path / "bars")).collect()] == [("B", 2.0, True)]
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert [(r.level, r.code, json.loads(r.meta)) for r in log] == [("WARN", "NO_WRITER", {"rows": 2})]


def test_journal_append_is_repeatable(spark, tmp_path):
    write = tables.journal_append(str(tmp_path))
    for batch_id in (0, 1, 1):
        write(ticks(spark), batch_id)
    assert spark.read.parquet(str(tmp_path)).groupBy("batch_id").count().count() == 2
    assert spark.read.parquet(str(tmp_path)).count() == 12


def test_canonical_table_equals_one_pass(spark, tmp_path):
    rnd = random.Random(8)
    rows = [("p", rnd.choice("st"), rnd.choice("AB"), rnd.randrange(60) * 10 ** 12, rnd.choice([None, 1, 2, 30]), rnd.random() < .3, f"{b}-{i}", b)
            for b in range(4) for i in range(15)]
    df = spark.createDataFrame(rows, TICK + ", batch_id BIGINT")
    root = str(tmp_path / "canonical")
    merge = tables.canonical_merge(root, ["payload"], ids_per_block=10)
    for b in (0, 1, 2, 2, 3):
        merge(df.filter(F.col("batch_id") == b), b)
    got = spark.read.parquet(root).select("provider", "stream", "symbol", "nat_key", "payload")
    want = latest.canonical_upsert(df, ["payload"]).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_layout_and_compaction(spark, tmp_path, monkeypatch):
    root = tmp_path / "raw"
    df = spark.range(240).select(F.lit("p").alias("provider"), F.lit("s").alias("stream"), (F.col("id") * 3_600_000_000_000).alias("ts_ns"))
    for part in (df, df.filter("ts_ns < 120 * 3600000000000")):
        tables.write_ticks(part, str(root))
    rows = sorted(r.ts_ns for r in spark.read.parquet(str(root)).collect())

    def files():
        return {p.parent.name: sorted(f.name for f in p.parent.glob("*.parquet")) for p in root.rglob("*.parquet")}

    before = files()
    assert len(before) == 10 and {len(f) for f in before.values()} == {1, 2}
    assert {r.folder.rsplit("/", 1)[1] for r in tables.crowded_folders(spark, str(root)).collect()} == {d for d, f in before.items() if len(f) == 2}
    put_back, calls = tables.remove, []

    def down(spark, path):
        calls.append(path)
        raise RuntimeError("down")

    monkeypatch.setattr(tables, "remove", down)
    with pytest.raises(RuntimeError):  # after the rows went back, before the staging folder went
        tables.compact_partitions(spark, str(root), folders_at_once=2)
    monkeypatch.setattr(tables, "remove", put_back)
    assert tables.compact_partitions(spark, str(root), folders_at_once=2) == 3
    after = files()
    assert {len(f) for f in after.values()} == {1} and not (tmp_path / "raw-compacted").exists()
    assert all(after[d] == f for d, f in before.items() if len(f) == 1)  # well-sized folders are left alone
    assert sorted(r.ts_ns for r in spark.read.parquet(str(root)).collect()) == rows
    assert tables.compact_partitions(spark, str(root)) == 0
    assert tables.hot_dir("r", "p", "s") == "r/p_s" and tables.hot_dir("r", "p", "s", "nested") == "r/p/s"


def test_canonical_deltas_equal_upserts(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, "p"]), rnd.choice("st"), rnd.choice("AB"), rnd.randrange(60) * 10 ** 12, rnd.choice([None, 1, 2, 30]), rnd.random() < .3, f"{b}-{i}", b)
            for b in range(6) for i in range(15)]
    df = spark.createDataFrame(rows, TICK + ", batch_id BIGINT")
    root = tmp_path / "canonical"
    merge = tables.canonical_deltas(str(root), ["payload"], fold_every=2, ids_per_block=10)
    for b in (0, 1, 2, 2, 3, 4, 4, 5):
        merge(df.filter(F.col("batch_id") == b), b)
        if b in (1, 3, 5):
            got = tables.canonical_rows(spark, str(root), ["payload"]).select("provider", "stream", "symbol", "nat_key", "payload")
            want = latest.canonical_upsert(df.filter(F.col("batch_id") <= b), ["payload"]).select(*got.columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert sorted(p.name for p in (root / "deltas").iterdir() if p.is_dir()) == ["delta=4", "delta=5"]


def test_ndjson_and_replay(spark, tmp_path):
    tables.write_ndjson(ticks(spark).select("symbol", "seq"), str(tmp_path / "text"))
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert {"symbol": "B", "seq": None} in docs and len(docs) == 6
    replayed = tables.replay_journal(ticks(spark), 3_000_000, providers={"tradingview", "other"}, streams=None)
    assert tuple(tables.replay_summary(replayed).first()) == (4, 6_000_000)
    assert tuple(tables.replay_summary(replayed.filter("false")).first()) == (0, 0)


def test_event_log(spark, tmp_path):
    rows = eventlog.event_rows(ticks(spark), service=F.lit("s"), name=F.col("symbol"), role=F.lit("r"), level=F.lit("ERROR"), code=F.lit("C"),
                               message=F.lit("m"), ts=F.lit(datetime(2024, 1, 1)), meta=[F.col("seq")])
    eventlog.append_events(rows, str(tmp_path / "log"))
    eventlog.append_events(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 12 and {r.meta for r in log.filter("name = 'A'").collect()} == {'{"seq":1}', '{"seq":2}'}
    assert eventlog.latest_error_per_instance(log).count() == 4


def test_state_versions(spark, tmp_path):
    kept = state.Versions(str(tmp_path / "v"))
    assert kept.before(spark, 0) is None
    for batch_id in range(4):
        kept.write(spark.range(batch_id + 1), batch_id)
    assert kept.before(spark, 4).count() == 4 and kept.before(spark, 3).count() == 3
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if p.is_dir()) == ["v=2", "v=3"]


def test_canonical_table_keeps_rows_without_a_provider(spark, tmp_path):
    root = str(tmp_path / "canonical")
    merge = tables.canonical_merge(root)
    rows = [(p, s, "A", 10 ** 9 * i, i, True, "{}") for i in (1, 2) for p in (None, "p") for s in (None, "x")]
    for i in (1, 2):
        merge(spark.createDataFrame([r for r in rows if r[4] == i], TICK), i)
    got = spark.read.parquet(root).select("provider", "stream", "seq").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], r[1], r[4]) for r in rows], key=str)


def test_old_batches_are_deleted(spark, tmp_path):
    root = str(tmp_path / "journal")
    for b in range(5):
        tables.journal_append(root)(ticks(spark), b)
    assert tables.prune_batches(spark, root, 4, 10) == 0
    assert tables.prune_batches(spark, root, 4, 2) == 18 and sorted(p.name for p in (tmp_path / "journal").glob("batch*")) == ["batch_id=3", "batch_id=4"]


def test_repeated_writes_replace_their_rows(spark, tmp_path):
    for write_id in (1, 2, 2):
        tables.write_ticks(ticks(spark), str(tmp_path / "t"), write_id=write_id)
        eventlog.append_events(tables.unrouted(ticks(spark)), str(tmp_path / "e"), write_id=write_id)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12 and spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_nothing_is_pruned_that_a_consumer_has_not_read(spark, tmp_path):
    root, cursors = str(tmp_path / "journal"), str(tmp_path / "cursors")
    tables.write_journal(spark.createDataFrame([(b, b * 10 + i) for b in range(1, 9) for i in range(2)], "batch_id INT, seq BIGINT"), root)
    seen = {"fast": [], "slow": []}

    def read(consumer, low, high, batch_id, fails=False):
        def handle(rows, _):
            if fails:
                raise RuntimeError("down")
            seen[consumer].extend(r.seq for r in rows.collect())
        tables.cursor_writer(handle, consumer, cursors)(spark.read.parquet(root).filter(F.col("batch_id").between(low, high)), batch_id)

    def left():
        return sorted(r.batch_id for r in spark.read.parquet(root).select("batch_id").distinct().collect())

    def prune(safety=1):
        return tables.prune_by_cursors(spark, root, spark.read.parquet(cursors), ["fast", "slow"], safety)

    read("fast", 1, 7, 0)
    assert prune() == 0 and left() == list(range(1, 9))  # one consumer has no cursor yet
    read("slow", 1, 2, 0)
    with pytest.raises(RuntimeError):
        read("slow", 3, 6, 1, fails=True)  # not handled: the cursor stays
    assert prune() == 2 and left() == [2, 3, 4, 5, 6, 7, 8]
    for _ in range(2):
        read("slow", 3, 6, 1)
    read("slow", 9, 9, 2)  # an empty batch moves nothing
    assert prune() == 8 and left() == [6, 7, 8]
    assert set(seen["slow"]) == {b * 10 + i for b in range(1, 7) for i in range(2)}


def test_staged_blocks_are_not_shuffled_again(spark, tmp_path, monkeypatch):
    rows = spark.range(40).selectExpr("'p' AS provider", "'s' AS stream", "'A' AS symbol", "id AS seq", "id AS ts_ns", "true AS is_final", "1L AS batch_id")
    frame, dealt = type(rows), []
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *columns: dealt.append(name) or hint(self, name, *columns))
    tables.canonical_merge(str(tmp_path / "table"), ids_per_block=10)(rows, 0)
    assert dealt == ["rebalance"]
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert sorted((r.seq, r.block) for r in stored.collect()) == [(i, f"s{i // 10}") for i in range(40)]
