"""Snapshots, gapless feeds, statistics and dispatch, in batch form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import ntz
from tickbars.operators import bars, catalog, feed, incremental
from tickbars.operators.filters import filter_time_range
from tickbars.plans.bars import bars_1m, stitched_1m
from tickbars.plans.quotes import quotes_table
from tickbars.plans.registry import Tables, query, rounded

_BAR = "Timestamp, Symbol, BarId, Open, High, Low, Close, Volume, Trades, round(Vwap, 6) AS Vwap, BuyerMakerCount"
START_NS, END_NS = 1_704_844_800_000_000_000, 1_705_449_600_000_000_000
_RANGE = "Timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00'"


def sources(t: Tables) -> dict[str, DataFrame]:
    return {schemas.TRADES: t.view("trades"), schemas.QUOTES: quotes_table(t), schemas.BARS: t.view("settled_bars_dup")}


@query("snapshot_range", "bars_5m", f"SELECT {_BAR}, FALSE AS IsEmpty FROM bars_5m WHERE Symbol = 'CLICK' AND {_RANGE} ORDER BY Timestamp")
def snapshot_range(t: Tables) -> DataFrame:
    return rounded(feed.snapshot_range(sources(t), "binance", "ohlcv_5m", "CLICK", start_ns=START_NS, end_ns=END_NS), "Vwap")


@query("snapshot_closed", "bars_1m", """
SELECT Timestamp, Symbol, Close, Volume FROM (SELECT *, lead(Timestamp) OVER (ORDER BY Timestamp) AS later FROM bars_1m WHERE Symbol = 'VIEW')
WHERE later IS NOT NULL ORDER BY Timestamp""")
def snapshot_closed(t: Tables) -> DataFrame:
    return feed.snapshot_range(sources(t), "binance", "ohlcv_1m", "VIEW", fields=["Close", "Volume"], include_open_bar=False)


@query("snapshot_stitched", "stitched", f"""
SELECT Timestamp, Exchange, Symbol, BarId, Open, High, Low, Close, Volume, IsFinal FROM stitched
WHERE Symbol = 'CLICK' AND Exchange = 'CME' AND {_RANGE.replace('17', '25')} ORDER BY Timestamp""")
def snapshot_stitched(t: Tables) -> DataFrame:
    return feed.snapshot_range(sources(t), "tradingview", "ohlcv_1m", "CLICK", exchange="cme", start_ns=START_NS, end_ns=END_NS + 8 * 86_400_000_000_000)


@query("public_ohlcv_5m", "bars_5m", f"SELECT {_BAR} FROM bars_5m")
def public_ohlcv_5m(t: Tables) -> DataFrame:
    return rounded(catalog.table("binance_ohlcv_5m", sources(t), t.as_of()), "Vwap")


@query("public_tv_bars_1m", "stitched", "SELECT Timestamp, Exchange, Symbol, BarId, Open, High, Low, Close, Volume, IsFinal FROM stitched")
def public_tv_bars_1m(t: Tables) -> DataFrame:
    return catalog.table("tv_bars_1m", sources(t), t.as_of())


@query("public_configs", "configs", """
SELECT provider, name, symbols, autostart, deleted, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, name ORDER BY seqcol DESC) AS rn FROM configs) WHERE rn = 1 AND NOT deleted""")
def public_configs(t: Tables) -> DataFrame:
    return catalog.table("configs", {"configs": t.view("configs")}, t.as_of())


@query("snapshot_quotes", "quotes", """
SELECT LpTime, Symbol, LastPrice, Bid FROM quotes WHERE Symbol = 'ERROR' ORDER BY LpTime""")
def snapshot_quotes(t: Tables) -> DataFrame:
    return feed.snapshot_range(sources(t), "tradingview", "quotes", "ERROR", fields=["LastPrice", "Bid"])


@query("gapless_watermark", "stitched bars_1m", """
SELECT 'stitched' AS feed, Exchange AS exchange, Symbol AS symbol,
       epoch_us(CASE WHEN arg_max(IsFinal, Timestamp) OR count(*) < 2 THEN max(Timestamp) ELSE max(Timestamp) FILTER (WHERE rn = 2) END) * 1000 AS watermark_ns
FROM (SELECT *, row_number() OVER (PARTITION BY Exchange, Symbol ORDER BY Timestamp DESC) AS rn FROM stitched) GROUP BY Exchange, Symbol
UNION ALL
SELECT 'trades', NULL, Symbol, epoch_us(coalesce(max(Timestamp) FILTER (WHERE rn = 2), max(Timestamp))) * 1000
FROM (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Timestamp DESC) AS rn FROM bars_1m) GROUP BY Symbol""")
def gapless_watermark(t: Tables) -> DataFrame:
    stitched = feed.gapless_watermark(stitched_1m(t), ["Exchange", "Symbol"]).select(F.lit("stitched").alias("feed"), F.col("Exchange").alias("exchange"), F.col("Symbol").alias("symbol"), "watermark_ns")
    trades = feed.gapless_watermark(bars_1m(t), ["Symbol"]).select(F.lit("trades").alias("feed"), F.lit(None).cast("string").alias("exchange"), F.col("Symbol").alias("symbol"), "watermark_ns")
    return stitched.unionByName(trades)


ATTACH_NS = 1_705_752_000_000_000_000
DAY_NS = 1_705_708_800_000_000_000


def gapless(t: Tables) -> DataFrame:
    """Attached at noon: bars of the day so far, a boundary, then all completed bars since."""
    trades = t.view("trades")
    snapshot = bars.trade_bars(filter_time_range(trades, "Timestamp", DAY_NS, ATTACH_NS - 1000))
    marks = feed.gapless_watermark(snapshot, ["Symbol"])
    later = bars.trade_bars(filter_time_range(trades, "Timestamp", DAY_NS))
    newest = bars.newest_bar_time(trades, "Timestamp", 1, ["Symbol"])
    return feed.gapless_feed(snapshot, bars.completed_bars(later, ["Symbol"], newest), marks, ["Symbol"], include_open_bar=False)


_LATER = "SELECT * FROM (SELECT *, lead(Timestamp) OVER (PARTITION BY Symbol ORDER BY Timestamp) AS later FROM today) WHERE later IS NOT NULL"
GAPLESS = f"""
, today AS (SELECT * FROM bars_1m WHERE epoch_us(Timestamp) * 1000 >= {DAY_NS}),
marks AS (SELECT Symbol, coalesce(max(Timestamp) FILTER (WHERE rn = 2), max(Timestamp)) AS mark
  FROM (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Timestamp DESC) AS rn FROM today WHERE epoch_us(Timestamp) * 1000 < {ATTACH_NS}) GROUP BY Symbol),
closed AS ({{closed}}),
feed AS (
SELECT 'snapshot' AS phase, 'completed' AS part, t.Symbol, t.Timestamp, t.Close, t.Volume, epoch_us(m.mark) * 1000 AS watermark_ns
FROM today t JOIN marks m ON t.Symbol = m.Symbol WHERE t.Timestamp <= m.mark
UNION ALL SELECT 'snapshot_boundary', NULL, Symbol, NULL, NULL, NULL, epoch_us(mark) * 1000 FROM marks
UNION ALL SELECT 'live', 'completed', c.Symbol, c.Timestamp, c.Close, c.Volume, NULL
FROM closed c LEFT JOIN marks m ON c.Symbol = m.Symbol WHERE m.mark IS NULL OR c.Timestamp > m.mark)
"""


@query("gapless_feed", "bars_1m", GAPLESS.format(closed=_LATER) + "SELECT * FROM feed")
def gapless_feed(t: Tables) -> DataFrame:
    return gapless(t).select("phase", "part", "Symbol", "Timestamp", "Close", "Volume", "watermark_ns")


@query("dispatch_by_phase", "bars_1m", GAPLESS.format(closed=_LATER) + """
SELECT CASE phase WHEN 'snapshot_boundary' THEN 'boundary' WHEN 'live' THEN 'bar' ELSE phase END AS branch, Symbol, count(*) AS row_count FROM feed GROUP BY ALL""")
def dispatch_by_phase(t: Tables) -> DataFrame:
    counted: list[DataFrame] = []

    def handler(name: str):
        return lambda rows: counted.append(rows.groupBy("Symbol").agg(F.count(F.lit(1)).alias("row_count")).withColumn("branch", F.lit(name)))

    feed.dispatch_by_phase(gapless(t), {n: handler(n) for n in ("snapshot", "boundary", "bar")}, F.lit("bar"))
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    return rows


LATE_FROM = datetime(2024, 1, 28)


@query("reaggregate_late", "bars_1m", f"SELECT {_BAR} FROM bars_1m")
def reaggregate_late(t: Tables) -> DataFrame:
    """Bars without the buyer side of the last days, corrected once those trades come in."""
    trades = t.view("trades")
    is_late = (F.col("Timestamp") >= ntz(LATE_FROM)) & F.col("IsBuyerMaker")
    stored = bars.trade_bars(trades.filter(~is_late))
    return rounded(incremental.reaggregate_late(stored, trades, trades.filter(is_late)), "Vwap")
