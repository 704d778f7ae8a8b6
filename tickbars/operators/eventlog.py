"""Event log and heartbeat views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import epoch_us, meta_to_json
from tickbars.operators.latest import latest_by_key

HEARTBEAT_KEY = ("service", "name", "role")


def event_rows(df: DataFrame, *, service: Column, name: Column, role: Column, level: Column, code: Column,
               message: Column, ts: Column | None = None, meta: list[Column] | None = None,
               corr_id: Column | None = None, parent_corr_id: Column | None = None) -> DataFrame:
    """Rows of a DataFrame as event log rows, to be appended to the log table."""
    empty = F.lit("")
    return df.select(
        (F.current_timestamp() if ts is None else ts).alias("ts"),
        service.alias("service"), name.alias("name"), role.alias("role"), level.alias("level"), code.alias("code"),
        message.alias("message"),
        (meta_to_json(*meta) if meta else F.lit("{}")).alias("meta"),
        F.coalesce(corr_id, empty).alias("corr_id") if corr_id is not None else empty.alias("corr_id"),
        F.coalesce(parent_corr_id, empty).alias("parent_corr_id") if parent_corr_id is not None else empty.alias("parent_corr_id"),
    )


def append_events(events: DataFrame, path: str, write_id: int | None = None) -> None:
    """Append event rows to the log, one folder per day.

    A job that may be repeated gives its ``write_id``: its rows have folders of their own, which a repetition replaces.
    """
    rows = events.select(*schemas.EVENT_LOG.names).withColumn("date", F.to_date("ts"))
    if write_id is None:
        rows.write.mode("append").partitionBy("date").parquet(path)
    else:
        rows.withColumn("write_id", F.lit(write_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("date", "write_id").parquet(path)


def latest_error_per_instance(events: DataFrame, seq: str = "ts") -> DataFrame:
    """Latest ERROR row per (service, name)."""
    return latest_by_key(events.filter(F.col("level") == "ERROR"), ["service", "name"], seq)


def heartbeats(beats: DataFrame, seq: str = "seqcol") -> DataFrame:
    """Latest beat per (service, name, role).

    A beat without meta keeps the last meta given; uptime counts from the start, never below 0. Beats that
    do not say when their service started count from the first of them. One aggregate per column over one
    ordering, so nothing but the winners leaves an input task.
    """
    plain = [c for c in ("state", "started_at", "last_heartbeat", "last_error") if c in beats.columns]
    first = [] if "started_at" in beats.columns else [F.min("last_heartbeat").alias("started_at")]
    latest = beats.groupBy(*HEARTBEAT_KEY).agg(
        *[F.max_by(c, seq).alias(c) for c in plain], *first,
        F.max_by("meta", F.when(F.col("meta").isNotNull(), F.col(seq))).alias("meta"),
    )
    seconds = F.floor((epoch_us(F.col("last_heartbeat")) - epoch_us(F.col("started_at"))) / F.lit(1_000_000))
    return latest.select(*HEARTBEAT_KEY, "state", "started_at", "last_heartbeat",
                         F.greatest(seconds, F.lit(0)).cast("bigint").alias("uptime_s"),
                         F.coalesce("last_error", F.lit("")).alias("last_error"),
                         F.coalesce("meta", F.lit("{}")).alias("meta"))
