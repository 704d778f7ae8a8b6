"""Numbered batches of ticks: packing, statistics, retention, cursors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.operators.latest import best_per_key
from tickbars.operators.ordered import numbered

ROWS_PER_ENVELOPE = 5000
PRUNE_SAFETY_BATCHES = 100
_ROW_COLS = ("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload")


def envelope_pack(ticks: DataFrame, *ties: str, rows_per_envelope: int = ROWS_PER_ENVELOPE) -> DataFrame:
    """Ticks to stored rows, each holding an array of ticks in time order.

    A batch of more than ``rows_per_envelope`` ticks becomes several rows (``part_no``): an array
    must fit in one row however large the batch is.
    """
    placed = numbered(ticks, ["batch_id"], "ts_ns", *ties)
    row = F.struct("row_no", *_ROW_COLS)
    part = F.floor((F.col("row_no") - 1) / F.lit(rows_per_envelope)).cast("bigint")
    packed = placed.groupBy("batch_id", part.alias("part_no")).agg(
        F.max("ts_ns").alias("produced_at_ns"),
        F.min("row_no").alias("first_row"),
        F.count(F.lit(1)).alias("row_count"),
        F.sort_array(F.collect_list(row)).alias("rows"),
    )
    return packed.withColumns({"first_off": F.lit(None).cast("bigint"), "last_off": F.lit(None).cast("bigint")}) \
        .select("batch_id", "part_no", "produced_at_ns", "first_off", "last_off", "row_count", "rows")


def envelope_unpack(envelopes: DataFrame) -> DataFrame:
    """Stored rows back to ticks."""
    return envelopes.select("batch_id", F.explode("rows").alias("r")).select("batch_id", *[F.col(f"r.{c}") for c in _ROW_COLS])


def batch_stats(ticks: DataFrame) -> DataFrame:
    """Rows and time range per batch."""
    return ticks.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts_ns").alias("first_ts_ns"),
        F.max("ts_ns").alias("last_ts_ns"),
    )


def max_batch_id(ticks: DataFrame) -> DataFrame:
    return ticks.agg(F.coalesce(F.max("batch_id"), F.lit(0)).alias("max_batch_id"))


def distinct_batches_from(ticks: DataFrame, start: int, n: int) -> DataFrame:
    """Ticks of the first ``n`` batches from an id on, with the batch's last instant."""
    first = ticks.filter(F.col("batch_id") >= start).groupBy("batch_id").agg(F.max("ts_ns").alias("produced_at_ns")) \
        .orderBy("batch_id").limit(n)
    return ticks.join(first, "batch_id")


def retain_batches(batches: DataFrame, last_committed: int, safety: int = PRUNE_SAFETY_BATCHES) -> DataFrame:
    """Batches that stay after pruning all up to ``last_committed - safety``."""
    cutoff = last_committed - safety
    return batches if cutoff <= 0 else batches.filter(F.col("batch_id") > cutoff)


def pruned_count(batches: DataFrame, last_committed: int, safety: int = PRUNE_SAFETY_BATCHES) -> DataFrame:
    """Number of stored rows that pruning removes."""
    cutoff = last_committed - safety
    return batches.filter(F.lit(cutoff > 0) & (F.col("batch_id") <= cutoff)).agg(F.count(F.lit(1)).alias("deleted"))


def set_watermarks(positions: DataFrame, path: str, seq: int) -> None:
    """Move named cursors (columns scope, last_offset), all in one job: one more row of the history of each, in a folder
    of its own so that a retry replaces it."""
    positions.select("scope", F.col("last_offset").cast("bigint").alias("last_offset"), F.lit(seq).cast("bigint").alias("seqcol")) \
        .repartition("scope").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", "seqcol").parquet(path)


def set_watermark(spark: SparkSession, path: str, scope: str, last_offset: int, seq: int) -> None:
    """Move one named cursor."""
    set_watermarks(spark.createDataFrame([(scope, last_offset)], "scope STRING, last_offset BIGINT"), path, seq)


def named_watermarks(history: DataFrame, seq: str = "seqcol") -> DataFrame:
    """Current value of each named cursor: the last one written."""
    return best_per_key(history, ["scope"], F.col(seq).desc()).select("scope", "last_offset")


def watermark_of(history: DataFrame, scope: str, seq: str = "seqcol") -> DataFrame:
    """Value of one cursor, 0 if it was never written."""
    return history.filter(F.col("scope") == scope) \
        .agg(F.coalesce(F.max_by("last_offset", seq), F.lit(0)).alias("last_offset"))


def slowest_cursor(history: DataFrame, consumers: Sequence[str], seq: str = "seqcol") -> int:
    """How far all of the named consumers have come: the least of their cursors, 0 while one has none."""
    own = named_watermarks(history.filter(F.col("scope").isin(*consumers)), seq)
    n, least = own.agg(F.count(F.lit(1)), F.min("last_offset")).first()
    return least if n == len(set(consumers)) else 0
