"""Ordered scans per key that stay parallel when one key holds most of the rows.

A window over a whole key runs in one task. Here the scan order is cut into slices of about equal row
counts; windows run inside (key, slice), and a small table of one row per (key, slice) carries the
state over slice borders. Borders depend on the data alone, so a lost task finds the same slices when
it is re-run. Null keys are keys like any other, and rows without an order value come first.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
ROWS_PER_SLICE = 1_000_000
# A slice with so many times its share of rows is cut again.
CROWDED = 4
_FIRST = -(2**63)


def with_slices(df: DataFrame, order: str, *, width: int | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add the slice of the whole-number column ``order``, named by its first value.

    A declared ``width`` gives slices of that span and reads nothing. Otherwise the width follows from the
    smallest and largest value and the number of rows, and slices that come out crowded are cut into narrower
    ones, again and again where a burst needs it: two passes over the order column for evenly spread data. There
    may be any number of slices; only the rows of one order value stay together.
    """
    at = F.col(order)
    if width is not None:
        return df.withColumn(SLICE, F.coalesce(at - F.pmod(at, F.lit(int(width))), F.lit(_FIRST)).cast("bigint"))
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    width = max(1, min(2**62, (high - low + 1) * rows_per_slice // n)) if n else 1
    placed = with_slices(df, order, width=width).withColumn("_width", F.lit(width).cast("bigint"))
    while n and width > 1:
        crowded = placed.filter(at.isNotNull() & (F.col("_width") > 1)).groupBy(SLICE, "_width").agg(F.count(F.lit(1)).alias("_rows")) \
            .filter(F.col("_rows") > CROWDED * rows_per_slice) \
            .select(F.col(SLICE).alias("_from"), F.greatest(F.lit(1), F.floor(F.col("_width") / F.col("_rows") * rows_per_slice)).cast("bigint").alias("_narrow"))
        if crowded.isEmpty():
            break
        placed = placed.join(crowded, F.col(SLICE) == F.col("_from"), "left").withColumns({
            SLICE: F.when(F.col("_narrow").isNotNull() & at.isNotNull(), at - F.pmod(at - F.col(SLICE), F.col("_narrow"))).otherwise(F.col(SLICE)),
            "_width": F.coalesce("_narrow", "_width")}).drop("_from", "_narrow")
    return placed.drop("_width")


def in_slice(keys: Sequence[str], *order: Column | str) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def carried(df: DataFrame, keys: Sequence[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Join to every row what the earlier slices of its key leave behind; null where there are none.

    ``summary`` are aggregates of one slice; ``carry`` are functions over those, evaluated over all
    earlier slices. The carried side has one row per key and slice; whether it is broadcast is left to
    the engine, which checks its size.
    """
    per_slice = df.groupBy(*keys, SLICE).agg(*[agg.alias(name) for name, agg in summary.items()])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    by = [*keys, SLICE]
    state = per_slice.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], *[fn.over(earlier).alias(name) for name, fn in carry.items()])
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)])
    return df.join(state, same, "left").drop(*[f"_by{i}" for i in range(len(by))])


def numbered(df: DataFrame, keys: Sequence[str], order: str, *ties: Column | str, name: str = "row_no",
             width: int | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Row number from 1 within each key, in the order of the whole-number column and the ties."""
    sliced = with_slices(df, order, width=width, rows_per_slice=rows_per_slice)
    joined = carried(sliced, keys, {"_n": F.count(F.lit(1))}, {"_before": F.sum("_n")})
    inside = F.row_number().over(in_slice(keys, order, *ties))
    return joined.withColumn(name, (F.coalesce("_before", F.lit(0)) + inside).cast("bigint")).drop("_before", SLICE)
