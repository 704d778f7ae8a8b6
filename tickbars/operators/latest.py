"""Best or latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.functions import natural_key

NATURAL_KEY = ("provider", "stream", "symbol", "nat_key")


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row of each key in the given order.

    Written as ``row_number() = 1`` so that the planner puts a group limit before the shuffle: each
    input task sends at most one row per key, however many copies of a key there are.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_by_key(df: DataFrame, keys: Sequence[str], seq: str, *ties: str) -> DataFrame:
    """Latest row of each key by an arrival column."""
    return best_per_key(df, keys, F.col(seq).desc(), *[F.col(c).desc() for c in ties])


def live_configs(configs: DataFrame, seq: str = "seqcol") -> DataFrame:
    """Latest config of each (provider, name); a deleted one hides the name altogether."""
    return latest_by_key(configs, ["provider", "name"], seq).filter(~F.col("deleted"))


def dedupe_trades(trades: DataFrame, *ties: str) -> DataFrame:
    """One row per (Symbol, TradeID), the one with the latest Timestamp.

    On a stream, ``dropDuplicatesWithinWatermark`` applies instead, which keeps the first.
    """
    if trades.isStreaming:
        return trades.dropDuplicatesWithinWatermark(["Symbol", "TradeID"])
    return best_per_key(trades, ["Symbol", "TradeID"], F.col("Timestamp").desc(), *[F.col(c).desc() for c in ties])


def upper_keys(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"Exchange": F.upper("Exchange"), "Symbol": F.upper("Symbol")})


def dedupe_bars(bars: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Last arrival per (Exchange, Symbol, Timestamp) after upper-casing: repaints replace bars."""
    return latest_by_key(upper_keys(bars), ["Exchange", "Symbol", "Timestamp"], arrival)


def last_bar_time(bars: DataFrame) -> DataFrame:
    """Newest bar time per (Exchange, Symbol)."""
    return bars.groupBy("Exchange", "Symbol").agg(F.max("Timestamp").alias("LastBarTs"))


def with_natural_key(ticks: DataFrame) -> DataFrame:
    if "nat_key" in ticks.columns:
        return ticks
    return ticks.withColumn("nat_key", natural_key(F.col("seq"), F.col("ts_ns")))


def canonical_order(ties: Sequence[str] = ()) -> list[Column]:
    """Final rows first, then the later batch, sequence and instant, then the given columns.

    Ranked this way over the whole history, a key ends with the row that batch-by-batch upserts
    would leave: a final row never gives way to a provisional one.
    """
    names = ("is_final", "batch_id", "seq", "ts_ns", *ties)
    return [F.col(c).desc_nulls_last() for c in names]


def canonical_upsert(ticks: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """One best row per natural key over a whole journal."""
    return best_per_key(with_natural_key(ticks), NATURAL_KEY, *canonical_order(ties))


def upsert_into(stored: DataFrame, batch: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Stored canonical rows after a batch of ticks: same rule, incremental form."""
    return canonical_upsert(stored.unionByName(with_natural_key(batch).select(*stored.columns)), ties)


def insert_new_keys(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """Incoming rows whose key is not stored."""
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def update_matching_keys(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """Stored rows, each replaced by the incoming row of its key where that one wins.

    Incoming wins when it is final, or when the stored row is not and incoming is not older. Both
    sides have one row per key.
    """
    fields = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, F.struct(*fields).alias("_new"))
    both_without_seq = F.col("_new.seq").isNull() & F.col("seq").isNull()
    newer = (F.coalesce("_new.seq", F.lit(-1)) >= F.coalesce("seq", F.lit(-1))) \
        & (~both_without_seq | (F.col("_new.ts_ns") >= F.col("ts_ns")))
    wins = F.col("_new").isNotNull() & (F.col("_new.is_final") | (~F.col("is_final") & newer))
    joined = stored.join(new, list(keys), "left").withColumn("_wins", F.coalesce(wins, F.lit(False)))
    return joined.select(*keys, *[F.when(F.col("_wins"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields]) \
        .select(*stored.columns)
