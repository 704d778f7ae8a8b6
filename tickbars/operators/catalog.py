"""Public tables by name, each built from source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.operators import bars, bins, eventlog, feed, latest
from tickbars.operators.feed import Sources, stitched_1m

# Source tables a builder may need, by name: trades, quotes, bars (vendor), eventlog, heartbeats,
# status, configs, changes (a labelled change feed). Logs carry their arrival number in ``seqcol``.
Builder = Callable[[Sources, Column], DataFrame]


def _trades(s: Sources) -> DataFrame:
    return s[schemas.TRADES].select(*schemas.TRADE_TABLE_COLS)


# The names tables are asked for by.
TABLES: dict[str, Builder] = {
    "status": lambda s, now: latest.latest_by_key(s["status"], ["provider", "feeder"], "seqcol").drop("seqcol"),
    "configs": lambda s, now: latest.live_configs(s["configs"]).drop("seqcol"),
    "threads": lambda s, now: eventlog.heartbeats(s["heartbeats"]),
    "eventlog": lambda s, now: s["eventlog"].select(*schemas.EVENT_LOG.names),
    "binance_trades": lambda s, now: _trades(s),
    "binance_ohlcv_1m": lambda s, now: bars.trade_bars(s[schemas.TRADES], 1),
    "binance_ohlcv_1m_filled": lambda s, now: feed.fill_trade_bars(s[schemas.TRADES], now, 1),
    "binance_ohlcv_5m": lambda s, now: bars.trade_bars(s[schemas.TRADES], 5),
    "binance_ohlcv_5m_filled": lambda s, now: feed.fill_trade_bars(s[schemas.TRADES], now, 5),
    "tv_quotes": lambda s, now: s[schemas.QUOTES].select(*schemas.QUOTE_TABLE_COLS),
    "tv_bars": lambda s, now: latest.upper_keys(s[schemas.BARS]).select(*schemas.VENDOR_BAR_COLS),
    "tv_bars_deduped": lambda s, now: latest.dedupe_bars(s[schemas.BARS]).select(*schemas.VENDOR_BAR_COLS),
    "tv_bars_1m_from_quotes": lambda s, now: bars.quote_bars(s[schemas.QUOTES]),
    "tv_bars_1m_filled": lambda s, now: feed.fill_quote_bars(s[schemas.QUOTES], now),
    "tv_bars_1m": lambda s, now: stitched_1m(s),
    "tv_bars_5m": lambda s, now: bars.rollup_unified_bars(stitched_1m(s), 5),
    "bins_1m_recent": lambda s, now: bins.bins_recent(next(iter(s.values())).sparkSession, now, 1),
    "bins_5m_recent": lambda s, now: bins.bins_recent(next(iter(s.values())).sparkSession, now, 5),
    "fanout_stats": lambda s, now: feed.feed_stats(s["changes"]),
}


def table(name: str, sources: Sources, as_of: Column | None = None) -> DataFrame:
    """A public table; ``as_of`` stands for the clock and defaults to it."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return TABLES[name](sources, F.current_timestamp() if as_of is None else as_of)
