"""Feeds: the registry of what can be asked for, range snapshots, snapshot-then-live feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import instant_to_ns
from tickbars.operators.bars import completed_bars, newest_bar_time, quote_bars, rollup_unified_bars, trade_bars
from tickbars.operators.bins import fill_bars, spine_start
from tickbars.operators.filters import drop_placeholders, filter_exchange, filter_symbol, filter_time_range, project_fields
from tickbars.operators.stitch import stitch_bars

Sources = Mapping[str, DataFrame]
BOUNDARY = "snapshot_boundary"


@dataclass(frozen=True)
class FeedSpec:
    """One feed: how to build it from source tables, and its columns."""

    provider: str
    schema: str
    build: Callable[[Sources], DataFrame]
    source: str
    source_time: str
    time_col: str
    symbol_col: str
    cols: tuple[str, ...]
    bin_minutes: int | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return ("Exchange", self.symbol_col) if "Exchange" in self.cols else (self.symbol_col,)

    @property
    def row_type(self) -> str:
        return schemas.ROW_BAR if self.bin_minutes else schemas.ROW_TRADE


def _sparse(minutes: int) -> Callable[[Sources], DataFrame]:
    """Trade bars as the filled table shows them once placeholders are hidden."""
    def build(sources: Sources) -> DataFrame:
        return trade_bars(sources[schemas.TRADES], minutes).withColumn("IsEmpty", F.lit(False))
    return build


def stitched_1m(sources: Sources) -> DataFrame:
    return stitch_bars(sources[schemas.BARS], quote_bars(sources[schemas.QUOTES]))


def _spec(provider: str, schema: str, build, source: str, source_time: str, time_col: str, cols: tuple[str, ...], minutes: int | None = None) -> FeedSpec:
    return FeedSpec(provider, schema, build, source, source_time, time_col, "Symbol", cols, minutes)


FEEDS: dict[tuple[str, str], FeedSpec] = {(s.provider, s.schema): s for s in (
    _spec(schemas.TRADE_PROVIDER, "trades", lambda s: s[schemas.TRADES], schemas.TRADES, "Timestamp", "Timestamp", schemas.TRADE_COLS),
    _spec(schemas.TRADE_PROVIDER, "ohlcv_1m", _sparse(1), schemas.TRADES, "Timestamp", "Timestamp", schemas.TRADE_BAR_FILLED_COLS, 1),
    _spec(schemas.TRADE_PROVIDER, "ohlcv_5m", _sparse(5), schemas.TRADES, "Timestamp", "Timestamp", schemas.TRADE_BAR_FILLED_COLS, 5),
    _spec(schemas.QUOTE_PROVIDER, "quotes", lambda s: s[schemas.QUOTES], schemas.QUOTES, "LpTime", "LpTime", schemas.QUOTE_COLS),
    _spec(schemas.QUOTE_PROVIDER, "ohlcv_1m", stitched_1m, schemas.QUOTES, "LpTime", "Timestamp", schemas.UNIFIED_BAR_COLS, 1),
    _spec(schemas.QUOTE_PROVIDER, "ohlcv_5m", lambda s: rollup_unified_bars(stitched_1m(s), 5), schemas.QUOTES, "LpTime", "Timestamp", schemas.UNIFIED_BAR_COLS, 5),
)}


def feed_spec(provider: str, schema: str) -> FeedSpec:
    try:
        return FEEDS[(provider, schema)]
    except KeyError:
        raise ValueError(f"unknown provider/schema: {provider}/{schema}") from None


def list_feeds(provider: str | None = None) -> list[tuple[str, str]]:
    return [key for key in FEEDS if provider is None or key[0] == provider]


def fill_trade_bars(trades: DataFrame, as_of: Column, period_minutes: int, bars_back: int = 2) -> DataFrame:
    """Recent trade bars with placeholders, from the trades of the needed time only.

    The bound falls on a bin border, and is put on the trades so that the scan skips older ones.
    """
    recent = trades.filter(F.col("Timestamp") >= spine_start(as_of, period_minutes, bars_back))
    return fill_bars(trade_bars(recent, period_minutes), as_of, period_minutes, bars_back=bars_back)


def fill_quote_bars(quotes: DataFrame, as_of: Column, bars_back: int = 2) -> DataFrame:
    recent = quotes.filter(F.col("LpTime") >= spine_start(as_of, 1, bars_back))
    return fill_bars(quote_bars(recent), as_of, 1, ("Exchange", "Symbol"), bars_back)


def _within_bars(spec: FeedSpec, sources: Sources, start_ns: int | None, end_ns: int | None) -> Sources:
    """Sources without the ticks that no bar of the range needs."""
    if not spec.bin_minutes:
        return sources
    period = spec.bin_minutes * 60_000_000_000
    start = None if start_ns is None else start_ns // period * period
    end = None if end_ns is None else end_ns // period * period + period - 1000
    return {**sources, spec.source: filter_time_range(sources[spec.source], spec.source_time, start, end)}


def snapshot_range(sources: Sources, provider: str, data_schema: str, symbol: str, *, exchange: str | None = None,
                   start_ns: int | None = None, end_ns: int | None = None, fields: Iterable[str] | None = None,
                   include_open_bar: bool = True, bound_resolution: str = "exact", ordered: bool = True) -> DataFrame:
    """Rows of one feed and symbol in ``[start_ns, end_ns]``, in time order.

    ``fields`` are matched case-sensitively; time and symbol always stay. Placeholder rows never show.
    """
    if not isinstance(symbol, str):
        raise ValueError("only one symbol per snapshot")
    spec = feed_spec(provider, data_schema)

    def of_symbol(df: DataFrame) -> DataFrame:
        rows = filter_symbol(df, symbol, spec.symbol_col)
        return filter_exchange(rows, exchange) if "Exchange" in spec.cols else rows

    rows = of_symbol(spec.build(_within_bars(spec, sources, start_ns, end_ns)))
    rows = filter_time_range(drop_placeholders(rows), spec.time_col, start_ns, end_ns, bound_resolution)
    if spec.bin_minutes and not include_open_bar:
        if spec.source == schemas.TRADES:  # every trade makes a bar
            newest = newest_bar_time(of_symbol(sources[spec.source]), spec.source_time, spec.bin_minutes, spec.keys)
        else:
            newest = of_symbol(spec.build(sources)).groupBy(*spec.keys).agg(F.max(spec.time_col).alias("_newest"))
        rows = completed_bars(rows, spec.keys, newest)
    if ordered:
        rows = rows.orderBy(spec.time_col)
    return project_fields(rows.select(*spec.cols), fields, (spec.time_col, spec.symbol_col), case_sensitive=True)


def gapless_watermark(snapshot: DataFrame, keys: Sequence[str], time_col: str = "Timestamp", bars: bool = True) -> DataFrame:
    """Resume point per stream: the time of the last row.

    For bars whose last row is not final it is the row before, if there is one, so that the open bar
    is sent again. The two newest rows per key survive the group limit before the shuffle.
    """
    final = F.coalesce("IsFinal", F.lit(False)) if "IsFinal" in snapshot.columns else F.lit(False)
    w = Window.partitionBy(*keys).orderBy(F.col(time_col).desc())
    newest = snapshot.select(*keys, time_col, final.alias("_final")).withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    ends = newest.groupBy(*keys).agg(
        F.max(time_col).alias("_last"), F.max_by(time_col, "_n").alias("_previous"), F.max_by("_final", -F.col("_n")).alias("_final"))
    at = F.when(F.lit(bars) & ~F.col("_final"), F.col("_previous")).otherwise(F.col("_last"))
    return ends.select(*keys, instant_to_ns(at).alias("watermark_ns"))


def gapless_feed(snapshot: DataFrame, later: DataFrame, watermarks: DataFrame, keys: Sequence[str], time_col: str = "Timestamp", *,
                 include_open_bar: bool = True) -> DataFrame:
    """Snapshot rows, one boundary row per stream, then the rows after the watermark as live rows.

    Both sides compare event times with one watermark, so nothing is missed or sent twice; only a
    bar still open in the snapshot comes again, completed, in the live part. Without
    ``include_open_bar`` the snapshot stops at the watermark.
    """
    at = instant_to_ns(F.col(time_col))
    snap = snapshot.join(watermarks, list(keys))
    if not include_open_bar:
        snap = snap.filter(at <= F.col("watermark_ns"))
    live = later.join(watermarks, list(keys), "left").filter(F.col("watermark_ns").isNull() | (at > F.col("watermark_ns")))

    def labelled(df: DataFrame, phase: str, part: str | None) -> DataFrame:
        return df.withColumns({"phase": F.lit(phase), "part": F.lit(part).cast("string")})

    boundary = labelled(watermarks, BOUNDARY, None)
    return labelled(snap, "snapshot", "completed").unionByName(boundary, allowMissingColumns=True) \
        .unionByName(labelled(live, "live", "completed").withColumn("watermark_ns", F.lit(None).cast("bigint")), allowMissingColumns=True)


def dispatch_by_phase(feed: DataFrame, handlers: Mapping[str, Callable[[DataFrame], None]], row_type: Column | None = None) -> None:
    """Split a feed into snapshot, boundary, bar and trade rows and hand each to its handler.

    For use inside ``foreachBatch``; branches without a handler are not evaluated.
    """
    for name, rows in branches(feed, row_type).items():
        if name in handlers:
            handlers[name](rows)


def branch_of(row_type: Column | None = None) -> Column:
    kind = F.col("row_type") if row_type is None else row_type
    return F.when(F.col("phase") == "snapshot", "snapshot").when(F.col("phase") == BOUNDARY, "boundary").otherwise(kind)


def branches(feed: DataFrame, row_type: Column | None = None) -> dict[str, DataFrame]:
    branch = branch_of(row_type)
    return {name: feed.filter(branch == name) for name in ("snapshot", "boundary", schemas.ROW_BAR, schemas.ROW_TRADE)}


def feed_stats(changes: DataFrame, batch: str = "batch_id", keys: Sequence[str] = ("provider", "schema", "symbol")) -> DataFrame:
    """Rows per stream and part: those of its last batch, and totals."""
    parts = ("added", "updated", "completed")
    per_batch = changes.groupBy(*keys, batch).agg(*[F.sum(F.when(F.col("part") == p, 1).otherwise(0)).alias(p) for p in parts])
    return per_batch.groupBy(*keys).agg(
        *[F.max_by(p, batch).alias(f"last_{p}_rows") for p in parts],
        *[F.sum(p).alias(f"total_{p}_rows") for p in parts],
    )
