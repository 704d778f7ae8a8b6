"""Ordered reads: pages, first batches, recent rows, fetch windows, repaint windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.operators.filters import filter_provider_stream


def multi_key_sort(df: DataFrame, ascending: Sequence[str] = (), descending: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() for c in ascending], *[F.col(c).desc() for c in descending])


def keyset_page(rows: DataFrame, since: int, tiebreak: str, after=None, *, time_col: str = "ts_ns", page_rows: int = 20_000,
                providers: Sequence[str] | None = None, streams: Sequence[str] | None = None) -> DataFrame:
    """The ``page_rows`` rows after the cursor (time, tiebreak), in order.

    ``time_col`` is the event time or the update time. Without ``after`` the page starts behind all
    rows at ``since`` itself only if a tiebreak was given; else it includes them.
    """
    t, k = F.col(time_col), F.col(tiebreak)
    later = (t >= since) if after is None else ((t > since) | ((t == since) & (k > F.lit(after))))
    return filter_provider_stream(rows, providers, streams).filter(later).orderBy(t.asc(), k.asc()).limit(page_rows)


def next_batches(batches: DataFrame, start: int, n: int, column: str = "batch_id") -> DataFrame:
    """The first ``n`` stored batches from an id on."""
    return batches.filter(F.col(column) >= start).orderBy(column).limit(n)


def load_recent(rows: DataFrame, since_ns: int, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows since an instant, in time order."""
    picked = rows.filter(F.col("ts_ns") >= since_ns).orderBy("ts_ns")
    return picked.select(*columns) if columns else picked


def newest_first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order])


def window_start(as_of: Column, days_back: int, overlap_minutes: int) -> Column:
    """Start of the range to fetch, for rows with a ``watermark`` column."""
    return F.coalesce(F.col("watermark") - F.expr(f"INTERVAL '{int(overlap_minutes)}' MINUTE"), as_of - F.expr(f"INTERVAL '{int(days_back)}' DAY"))


def fetch_window(symbols: DataFrame, watermarks: DataFrame, as_of: Column, keys: Sequence[str] = ("symbol",), *,
                 days_back: int = 10, overlap_minutes: int = 5, max_bars: int = 5000) -> DataFrame:
    """The time ranges to fetch per symbol, with the number of one-minute bars in each.

    Without a watermark they go back ``days_back`` days, else to the watermark less the overlap. A range of more
    than ``max_bars`` bars is cut into several that cover it all.
    """
    ranges = symbols.join(watermarks.select(*keys, "watermark"), list(keys), "left") \
        .withColumn("window_start", window_start(as_of, days_back, overlap_minutes)).withColumn("window_end", as_of)
    def minutes(a: str, b: str) -> Column:
        micros = F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))
        return F.greatest(F.floor(micros / F.lit(60_000_000)), F.lit(1)).cast("bigint")

    def later(n: Column) -> Column:
        return F.col("window_start") + F.make_dt_interval(mins=n.cast("int"))

    cuts = F.sequence(F.lit(0).cast("bigint"), minutes("window_start", "window_end") - 1, F.lit(max_bars).cast("bigint"))
    parts = ranges.withColumn("_from", F.explode(cuts)).withColumns({
        "window_start": later(F.col("_from")), "window_end": F.least(later(F.col("_from") + max_bars), F.col("window_end"))})
    return parts.select(*keys, "window_start", "window_end", minutes("window_start", "window_end").alias("n_bars"))


def repaint_overlap(bars: DataFrame, watermarks: DataFrame, keys: Sequence[str], time_col: str = "datetime", overlap: int = 5) -> DataFrame:
    """Rows to emit from a fetch: all on a key's first run, later those from the N-th newest on.

    The cutoff comes from the N newest rows of a key; the group limit in front of the shuffle keeps
    N rows per key and input task.
    """
    known = bars.join(watermarks.select(*keys).distinct().withColumn("_known", F.lit(True)), list(keys), "left")
    return newest_of_known(known, F.col("_known").isNotNull(), keys, time_col, overlap).select(*bars.columns)


def newest_of_known(bars: DataFrame, known: Column, keys: Sequence[str], time_col: str, overlap: int, since: str | None = None) -> DataFrame:
    """All rows of keys not known yet; of the others those from the N-th newest on, or from the earlier time in ``since``."""
    w = Window.partitionBy(*keys).orderBy(F.col(time_col).desc())
    newest = bars.filter(known).select(*keys, time_col).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= overlap)
    cutoff = newest.groupBy(*keys).agg(F.min(time_col).alias("_cutoff"))
    first = F.least(F.col("_cutoff"), F.col(since)) if since else F.col("_cutoff")
    return bars.join(cutoff, list(keys), "left").filter(F.col("_cutoff").isNull() | (F.col(time_col) >= first))
