"""Row filters and column projection of feeds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.functions import us_to_ntz


def filter_symbol(df: DataFrame, symbol: str | Iterable[str], symbol_col: str = "Symbol") -> DataFrame:
    """Rows of one symbol, or of any of several; none for an empty list."""
    if isinstance(symbol, str):
        return df.filter(F.col(symbol_col) == symbol)
    wanted = list(symbol)
    return df.filter(F.col(symbol_col).isin(wanted) if wanted else F.lit(False))


def filter_exchange(df: DataFrame, exchange: str | None, column: str = "Exchange") -> DataFrame:
    """Rows of an exchange, if one is asked for and the table has the column."""
    if not exchange or column not in df.columns:
        return df
    return df.filter(F.col(column) == exchange.upper())


def filter_time_range(df: DataFrame, time_col: str = "Timestamp", start_ns: int | None = None, end_ns: int | None = None,
                      bound_resolution: str = "exact") -> DataFrame:
    """Rows in ``[start_ns, end_ns]``, each bound optional.

    ``bound_resolution="second"`` cuts the bounds to whole seconds first. Bounds are literals of the
    column's own type, so they reach the scan.
    """
    def bound(ns: int, round_up: bool) -> Column:
        if bound_resolution == "second":
            us = ns // 1_000_000_000 * 1_000_000
        else:
            us = -(-ns // 1000) if round_up else ns // 1000
        return us_to_ntz(F.lit(us))

    if start_ns is not None:
        df = df.filter(F.col(time_col) >= bound(start_ns, True))
    if end_ns is not None:
        df = df.filter(F.col(time_col) <= bound(end_ns, False))
    return df


def drop_placeholders(df: DataFrame) -> DataFrame:
    """Hide bins without a bar, in tables that have them."""
    return df.filter(~F.col("IsEmpty")) if "IsEmpty" in df.columns else df


def project_fields(df: DataFrame, fields: Iterable[str] | None, always: Sequence[str] = (),
                   case_sensitive: bool = False) -> DataFrame | None:
    """Keep the requested columns and the ``always`` ones, in table order.

    No request keeps everything; a request that names no column gives None.
    """
    wanted = set(fields or ())
    if not wanted:
        return df
    if not case_sensitive:
        wanted = {f.lower() for f in wanted}
    keep = [c for c in df.columns if c in always or (c if case_sensitive else c.lower()) in wanted]
    return df.select(*keep) if keep else None


def filter_provider_stream(df: DataFrame, providers: Iterable[str] | None = None, streams: Iterable[str] | None = None) -> DataFrame:
    """Rows of the given providers and streams; an empty set asks for all."""
    for column, wanted in (("provider", providers), ("stream", streams)):
        values = sorted(wanted or ())
        if values:
            df = df.filter(F.col(column).isin(values))
    return df


def recent_events(events: DataFrame, minutes: int = 10, level: str | None = "ERROR", as_of: Column | None = None,
                  time_col: str = "ts") -> DataFrame:
    """Event rows of the last minutes, of one level if given."""
    now = F.current_timestamp() if as_of is None else as_of
    rows = events.filter(F.col(time_col) >= now - F.expr(f"INTERVAL '{int(minutes)}' MINUTE"))
    return rows.filter(F.col("level") == level) if level else rows
