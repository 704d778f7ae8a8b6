"""Bars, roll-ups, gap filling, stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import time_bucket
from tickbars.operators import bars, bins, feed, filters, latest, stitch
from tickbars.plans.quotes import quotes_table
from tickbars.plans.registry import Tables, query, rounded

_BAR = "Timestamp, Symbol, BarId, Open, High, Low, Close, Volume, Trades, round(Vwap, 6) AS Vwap, BuyerMakerCount"
_UNIFIED = "Timestamp, Exchange, Symbol, BarId, Open, High, Low, Close, Volume, IsFinal"


def bars_1m(t: Tables) -> DataFrame:
    return bars.trade_bars(t.view("trades"))


def bars_5m(t: Tables) -> DataFrame:
    return bars.trade_bars(t.view("trades"), 5)


def quote_bars_1m(t: Tables) -> DataFrame:
    return bars.quote_bars(quotes_table(t))


def stitched_1m(t: Tables) -> DataFrame:
    return stitch.stitch_bars(t.view("settled_bars_dup"), quote_bars_1m(t))


@query("ohlcv_1m", "bars_1m", f"SELECT {_BAR} FROM bars_1m")
def ohlcv_1m(t: Tables) -> DataFrame:
    return rounded(bars_1m(t), "Vwap")


@query("ohlcv_5m", "bars_5m", f"SELECT {_BAR} FROM bars_5m")
def ohlcv_5m(t: Tables) -> DataFrame:
    return rounded(bars_5m(t), "Vwap")


@query("rollup_bars", "bars_5m", f"SELECT {_BAR} FROM bars_5m")
def rollup_bars(t: Tables) -> DataFrame:
    """Longer bars from stored one-minute bars; equal to bars straight from the trades."""
    return rounded(bars.rollup_trade_bars(bars_1m(t), 5), "Vwap")


@query("bars_from_quotes", "quote_bars", f"SELECT {_UNIFIED} FROM quote_bars")
def bars_from_quotes(t: Tables) -> DataFrame:
    return quote_bars_1m(t)


@query("stitch_bars", "stitched", f"SELECT {_UNIFIED} FROM stitched")
def stitch_bars(t: Tables) -> DataFrame:
    return stitched_1m(t)


ORACLE_STITCHED_5M = """
SELECT b AS Timestamp, Exchange, Symbol, (hour(b) * 60 + minute(b)) // 5 AS BarId,
       arg_min_null(Open, Timestamp) AS Open, max(High) AS High, min(Low) AS Low, arg_max_null(Close, Timestamp) AS Close,
       sum(Volume) AS Volume, bool_and(IsFinal) AS IsFinal
FROM (SELECT *, time_bucket(INTERVAL '5' MINUTE, Timestamp) AS b FROM stitched)
GROUP BY b, Exchange, Symbol"""


@query("stitched_5m", "stitched", ORACLE_STITCHED_5M)
def stitched_5m(t: Tables) -> DataFrame:
    return bars.rollup_unified_bars(stitched_1m(t), 5)


@query("last_bar_per_symbol", "last_bars", "SELECT Exchange, Symbol, LastBarTs FROM last_bars")
def last_bar_per_symbol(t: Tables) -> DataFrame:
    return latest.last_bar_time(latest.upper_keys(t.view("vendor_bars_dup")))


@query("dedupe_bars", "deduped_bars", "SELECT Exchange, Symbol, Timestamp, Open, High, Low, Close, Volume, IsFinal, arrival FROM deduped_bars")
def dedupe_bars(t: Tables) -> DataFrame:
    return latest.dedupe_bars(t.view("vendor_bars_dup"))


@query("lookup_last_bar", "quote_bars last_bars", """
SELECT q.Exchange, q.Symbol, q.Timestamp, q.Close, l.LastBarTs
FROM quote_bars q LEFT JOIN last_bars l ON q.Exchange = l.Exchange AND q.Symbol = l.Symbol""")
def lookup_last_bar(t: Tables) -> DataFrame:
    return bins.natural_join(quote_bars_1m(t), last_bar_per_symbol(t), ["Exchange", "Symbol"], ["LastBarTs"]) \
        .select("Exchange", "Symbol", "Timestamp", "Close", "LastBarTs")


@query("merge_union", "deduped_bars quote_bars", """
SELECT Exchange, Symbol, Timestamp, Close, IsFinal FROM deduped_bars
UNION ALL SELECT Exchange, Symbol, Timestamp, Close, IsFinal FROM quote_bars""")
def merge_union(t: Tables) -> DataFrame:
    cols = ("Exchange", "Symbol", "Timestamp", "Close", "IsFinal")
    return dedupe_bars(t).select(*cols).unionByName(quote_bars_1m(t).select(*cols))


@query("completed_bars", "bars_1m trades", f"""
SELECT {_BAR} FROM (SELECT *, lead(Timestamp) OVER (PARTITION BY Symbol ORDER BY Timestamp) AS later FROM bars_1m)
WHERE later IS NOT NULL""")
def completed_bars(t: Tables) -> DataFrame:
    newest = bars.newest_bar_time(t.view("trades"), "Timestamp", 1, ["Symbol"])
    return rounded(bars.completed_bars(bars_1m(t), ["Symbol"], newest), "Vwap")


_RECENT_BINS = """
SELECT unnest(generate_series(a - INTERVAL '{back}' MINUTE, a, INTERVAL '{n}' MINUTE)) AS Timestamp
FROM (SELECT time_bucket(INTERVAL '{n}' MINUTE, max(Timestamp)) AS a FROM trades)"""


@query("bins_recent", "trades", _RECENT_BINS.format(n=5, back=55))
def bins_recent(t: Tables) -> DataFrame:
    return bins.bins_recent(t.spark, t.as_of(), 5, 12)


@query("bins_range", "bars_1m", """
SELECT Symbol, unnest(generate_series(lo, hi, INTERVAL '1' MINUTE)) AS Timestamp
FROM (SELECT Symbol, min(Timestamp) AS lo, max(Timestamp) AS hi FROM bars_1m GROUP BY Symbol)""")
def bins_range(t: Tables) -> DataFrame:
    bounds = t.view("trades").groupBy("Symbol").agg(F.min("Timestamp").alias("lo"), F.max("Timestamp").alias("hi"))
    spans = bounds.select("Symbol", time_bucket(F.col("lo"), 1).alias("first_bin"), time_bucket(F.col("hi"), 1).alias("last_bin"))
    return bins.bins_range(spans, 1)


_ACTIVE = "SELECT DISTINCT {keys} FROM {bars} WHERE Timestamp >= (SELECT date_trunc('day', max(Timestamp)) FROM trades)"


@query("select_distinct", "bars_1m trades", _ACTIVE.format(keys="Symbol", bars="bars_1m"))
def select_distinct(t: Tables) -> DataFrame:
    return bins.active_keys(t.view("trades"), t.as_of(), ["Symbol"])


@query("grid_symbols_bins", "bars_1m trades", f"""
SELECT s.Symbol, b.Timestamp FROM ({_ACTIVE.format(keys="Symbol", bars="bars_1m")}) s CROSS JOIN ({_RECENT_BINS.format(n=1, back=9)}) b""")
def grid_symbols_bins(t: Tables) -> DataFrame:
    return bins.symbol_grid(select_distinct(t), t.as_of(), 1, 10)


def _filled(bars_cte: str, n: int, keys: tuple[str, ...], values: str) -> str:
    on = " AND ".join(f"g.{k} = s.{k}" for k in (*keys, "Timestamp"))
    grid = f"SELECT * FROM ({_ACTIVE.format(keys=', '.join(keys), bars=bars_cte)}) CROSS JOIN ({_RECENT_BINS.format(n=n, back=n)})"
    names = ", ".join(f"g.{k}" for k in ("Timestamp", *keys))
    return f"SELECT {names}, {values}, s.Volume IS NULL AS IsEmpty FROM ({grid}) g LEFT JOIN {bars_cte} s ON {on}"


_TRADE_VALUES = "BarId, Open, High, Low, Close, Volume, Trades, round(Vwap, 6) AS Vwap, BuyerMakerCount"
_UNIFIED_VALUES = "BarId, Open, High, Low, Close, Volume, IsFinal"


@query("fill_bars_1m", "bars_1m trades", _filled("bars_1m", 1, ("Symbol",), _TRADE_VALUES))
def fill_bars_1m(t: Tables) -> DataFrame:
    return rounded(feed.fill_trade_bars(t.view("trades"), t.as_of(), 1), "Vwap")


@query("fill_bars_5m", "bars_5m trades", _filled("bars_5m", 5, ("Symbol",), _TRADE_VALUES))
def fill_bars_5m(t: Tables) -> DataFrame:
    return rounded(feed.fill_trade_bars(t.view("trades"), t.as_of(), 5), "Vwap")


@query("fill_quote_bars_1m", "quote_bars trades", _filled("quote_bars", 1, ("Exchange", "Symbol"), _UNIFIED_VALUES))
def fill_quote_bars_1m(t: Tables) -> DataFrame:
    return feed.fill_quote_bars(quotes_table(t), t.as_of())


_HISTORY = """
SELECT g.Symbol, g.Timestamp, s.Close, s.Volume, s.Volume IS NULL AS IsEmpty
FROM (SELECT Symbol, unnest(generate_series(lo, hi, INTERVAL '1' MINUTE)) AS Timestamp
      FROM (SELECT Symbol, min(Timestamp) AS lo, max(Timestamp) AS hi FROM bars_1m GROUP BY Symbol)) g
LEFT JOIN bars_1m s ON g.Symbol = s.Symbol AND g.Timestamp = s.Timestamp"""


def _history(t: Tables) -> DataFrame:
    ones = bars_1m(t)
    return bins.natural_join(bins_range(t), ones, ["Symbol", "Timestamp"]).withColumn("IsEmpty", F.col("Volume").isNull())


@query("natural_join", "bars_1m", _HISTORY)
def natural_join(t: Tables) -> DataFrame:
    return _history(t).select("Symbol", "Timestamp", "Close", "Volume", "IsEmpty")


@query("empty_bars", "bars_1m", f"SELECT Symbol, Timestamp, IsEmpty FROM ({_HISTORY}) WHERE IsEmpty")
def empty_bars(t: Tables) -> DataFrame:
    return bins.empty_bars(_history(t))


@query("drop_placeholders", "bars_1m", f"SELECT * EXCLUDE (IsEmpty) FROM ({_HISTORY}) WHERE NOT IsEmpty")
def drop_placeholders(t: Tables) -> DataFrame:
    return filters.drop_placeholders(natural_join(t)).drop("IsEmpty")


@query("union_distinct", "trades", f"""
SELECT DISTINCT Timestamp FROM ({_RECENT_BINS.format(n=5, back=55)}
UNION ALL SELECT time_bucket(INTERVAL '5' MINUTE, Timestamp) FROM trades)""")
def union_distinct(t: Tables) -> DataFrame:
    ticking = t.view("trades").select(time_bucket(F.col("Timestamp"), 5).alias("Timestamp"))
    return bins.union_bins(bins_recent(t), ticking)


@query("derived_columns", "trades", """
SELECT TradeID, Symbol, Price * Quantity AS PriceQty, CASE WHEN IsBuyerMaker THEN 1 ELSE 0 END AS BuyerMaker,
       (Quantity = 0) AS NoVolume, Timestamp FROM trades""")
def derived_columns(t: Tables) -> DataFrame:
    return t.view("trades").withColumns({
        "PriceQty": F.col("Price") * F.col("Quantity"),
        "BuyerMaker": F.when(F.col("IsBuyerMaker"), 1).otherwise(0),
        "NoVolume": F.col("Quantity") == 0,
    }).select("TradeID", "Symbol", "PriceQty", "BuyerMaker", "NoVolume", "Timestamp")


@query("dedupe_trades", "trades_dup", """
SELECT Symbol, TradeID, Timestamp, Price, Quantity, arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY Symbol, TradeID ORDER BY Timestamp DESC, arrival DESC) AS rn FROM trades_dup)
WHERE rn = 1""")
def dedupe_trades(t: Tables) -> DataFrame:
    return latest.dedupe_trades(t.view("trades_dup"), "arrival").select("Symbol", "TradeID", "Timestamp", "Price", "Quantity", "arrival")
