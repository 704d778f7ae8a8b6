"""One bar series out of authoritative and provisional bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import bar_id
from tickbars.operators.bins import natural_join
from tickbars.operators.latest import dedupe_bars, last_bar_time, upper_keys

_KEY = ("Exchange", "Symbol", "Timestamp")
_VALUES = ("Open", "High", "Low", "Close", "Volume", "IsFinal")


def after_last_bar(provisional: DataFrame, last: DataFrame) -> DataFrame:
    """Provisional bars later than the newest authoritative bar of their key, or of keys without any."""
    looked_up = natural_join(provisional, last, ["Exchange", "Symbol"], ["LastBarTs"])
    return looked_up.filter(F.col("LastBarTs").isNull() | (F.col("Timestamp") > F.col("LastBarTs"))) \
        .select(*provisional.columns)


def stitch_bars(vendor_bars: DataFrame, provisional: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Vendor bars, the last arrival of each, then the quote bars after them.

    A provisional bar stays only behind the newest authoritative bar of its symbol, so the two sides
    share no key and an authoritative bar always outranks a provisional one without another ranking.
    """
    kept = after_last_bar(provisional, last_bar_time(upper_keys(vendor_bars)))
    union = dedupe_bars(vendor_bars, arrival).select(*_KEY, *_VALUES).unionByName(kept.select(*_KEY, *_VALUES))
    return union.withColumn("BarId", bar_id(F.col("Timestamp"), 1)).select(*schemas.UNIFIED_BAR_COLS)
