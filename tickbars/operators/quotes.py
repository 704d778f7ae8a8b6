"""Quote updates: last known values, volume increments, material updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.operators.ordered import ROWS_PER_SLICE, carried, in_slice, with_slices

FIELDS = ("lp", "bid", "ask", "volume", "ch", "chp", "lp_time_ns")


def known_subscriptions(updates: DataFrame, subscribed: DataFrame, key: str = "sub_key") -> DataFrame:
    """Updates whose key is subscribed."""
    return updates.join(subscribed.select(key), key, "left_semi")


def _last_known(name: str, arrival: str, ties: Sequence[str]) -> Column:
    order = F.struct(arrival, *ties) if ties else F.col(arrival)
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order))


def quote_state(updates: DataFrame, key: str = "sub_key", arrival: str = "arrival", *, ties: Sequence[str] = (),
                fields: tuple[str, ...] | None = None, stored: DataFrame | None = None,
                arrival_ns: Column | None = None, width: int | None = None,
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Partial updates merged with the last known value of each field, plus the volume increment.

    The increment is 0 on the first known volume and when the volume falls (a reset). ``stored``
    holds the last known fields per key from earlier runs. An update before any known time takes
    ``arrival_ns``, when given. ``arrival`` is a whole-number column; where it is not unique within a
    key, ``ties`` settle the order (``pos`` for updates of one message).
    """
    fields = tuple(f for f in FIELDS if f in updates.columns) if fields is None else fields
    sliced = with_slices(updates, arrival, width=width, rows_per_slice=rows_per_slice)
    joined = carried(sliced, [key], {f"_s_{f}": _last_known(f, arrival, ties) for f in fields},
                     {f"_c_{f}": F.last(f"_s_{f}", ignorenulls=True) for f in fields})
    carry = {f: F.col(f"_c_{f}") for f in fields}
    drops = list(carry.values())
    if stored is not None:
        earlier = stored.select(F.col(key).alias("_p_key"), *[F.col(f).alias(f"_p_{f}") for f in fields])
        joined = joined.join(earlier, F.col(key).eqNullSafe(F.col("_p_key")), "left").drop("_p_key")
        carry = {f: F.coalesce(carry[f], F.col(f"_p_{f}")) for f in fields}
        drops += [F.col(f"_p_{f}") for f in fields]

    upto = in_slice([key], arrival, *ties).rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_slice([key], arrival, *ties).rowsBetween(Window.unboundedPreceding, -1)
    merged = {f: F.coalesce(F.last(f, ignorenulls=True).over(upto), carry[f]) for f in fields}
    volume_before = F.coalesce(F.last("volume", ignorenulls=True).over(earlier), carry["volume"])
    increment = F.when(merged["volume"].isNotNull(),
                       F.when(volume_before.isNull(), 0.0).otherwise(F.greatest(merged["volume"] - volume_before, F.lit(0.0))))
    if "lp_time_ns" in merged and arrival_ns is not None:
        merged["lp_time_ns"] = F.coalesce(merged["lp_time_ns"], arrival_ns)
    return joined.withColumns({**merged, "vol_delta": increment}).drop("_slice", *drops)


def last_state(updates: DataFrame, key: str = "sub_key", arrival: str = "arrival",
               fields: tuple[str, ...] | None = None, stored: DataFrame | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Last known fields per key: the state a later run of ``quote_state`` starts from."""
    fields = tuple(f for f in FIELDS if f in updates.columns) if fields is None else fields
    now = updates.groupBy(key).agg(*[_last_known(f, arrival, ties).alias(f) for f in fields])
    if stored is None:
        return now
    both = now.select(key, F.lit(1).alias("_new"), *fields).unionByName(stored.select(key, F.lit(0).alias("_new"), *fields))
    return both.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_new"))).alias(f) for f in fields])


def material_quotes(quotes: DataFrame) -> DataFrame:
    """Updates that carry something: a known last price, bid or ask, or traded volume."""
    return quotes.filter(F.col("lp").isNotNull() | F.col("bid").isNotNull() | F.col("ask").isNotNull()
                         | (F.coalesce("vol_delta", F.lit(0.0)) > 0))
