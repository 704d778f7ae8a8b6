"""Event log, configs, heartbeats, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import meta_to_json
from tickbars.operators import eventlog, filters, latest, paging
from tickbars.plans.registry import Tables, query

_EVENT = "ts, service, name, role, level, code, message, meta, corr_id, parent_corr_id"
_EVENT_COLS = tuple(_EVENT.split(", "))


def _latest(keys: str, where: str = "TRUE", source: str = "eventlog") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seqcol DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


@query("recent_events", "eventlog", f"""
SELECT {_EVENT} FROM eventlog WHERE level = 'ERROR' AND ts >= (SELECT max(ts) FROM eventlog) - INTERVAL '1440' MINUTE""")
def recent_events(t: Tables) -> DataFrame:
    return filters.recent_events(t.view("eventlog"), 1440, "ERROR", t.as_of("events", "ts")).select(*_EVENT_COLS)


@query("latest_by_key", "eventlog", f"SELECT service, name, role, level, message, ts FROM {_latest('service, name, role')}")
def latest_by_key(t: Tables) -> DataFrame:
    return latest.latest_by_key(t.view("eventlog"), ["service", "name", "role"], "seqcol").select("service", "name", "role", "level", "message", "ts")


@query("latest_error_per_instance", "eventlog", f"""SELECT service, name, message, corr_id, ts FROM {_latest("service, name", "level = 'ERROR'")}""")
def latest_error_per_instance(t: Tables) -> DataFrame:
    return eventlog.latest_error_per_instance(t.view("eventlog"), "seqcol").select("service", "name", "message", "corr_id", "ts")


@query("live_configs", "configs", f"SELECT provider, name, symbols, autostart, updated_at FROM {_latest('provider, name', 'TRUE', 'configs')} WHERE NOT deleted")
def live_configs(t: Tables) -> DataFrame:
    return latest.live_configs(t.view("configs")).select("provider", "name", "symbols", "autostart", "updated_at")


@query("newest_first", "eventlog", f"SELECT {_EVENT} FROM eventlog ORDER BY seqcol DESC")
def newest_first(t: Tables) -> DataFrame:
    return paging.newest_first(t.view("eventlog"), "seqcol").select(*_EVENT_COLS)


@query("multi_key_sort", "eventlog", "SELECT service, name, seqcol FROM eventlog ORDER BY service, name, seqcol DESC")
def multi_key_sort(t: Tables) -> DataFrame:
    return paging.multi_key_sort(t.view("eventlog"), ["service", "name"], ["seqcol"]).select("service", "name", "seqcol")


_META = """'{"seqcol":' || CAST(seqcol AS VARCHAR) || ',"level":"' || level || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}'"""


@query("meta_to_json", "eventlog", f"SELECT seqcol, {_META} AS meta FROM eventlog")
def meta_json(t: Tables) -> DataFrame:
    return t.view("eventlog").select("seqcol", meta_to_json(F.col("seqcol"), F.col("level"), F.col("ts")).alias("meta"))


@query("event_log", "eventlog", f"""
SELECT ts, 'feeder' AS service, name, role, level, code, message, {_META} AS meta, corr_id, parent_corr_id FROM eventlog""")
def event_log(t: Tables) -> DataFrame:
    return eventlog.event_rows(
        t.view("eventlog"), service=F.lit("feeder"), name=F.col("name"), role=F.col("role"), level=F.col("level"), code=F.col("code"),
        message=F.col("message"), ts=F.col("ts"), meta=[F.col("seqcol"), F.col("level"), F.col("ts")], corr_id=F.col("corr_id"),
        parent_corr_id=F.col("parent_corr_id"))


@query("heartbeats", "eventlog", """
SELECT service, name, role, arg_max(level, seqcol) AS state, min(ts) AS started_at, max(ts) AS last_heartbeat,
       CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS uptime_s, '' AS last_error,
       coalesce(arg_max(meta, seqcol) FILTER (WHERE seqcol % 3 = 0), '{}') AS meta
FROM eventlog GROUP BY service, name, role""")
def heartbeats(t: Tables) -> DataFrame:
    """Log rows read as beats: started at the first of a key, meta given by every third."""
    beats = t.view("eventlog").select(
        "service", "name", "role", F.col("level").alias("state"), F.col("ts").alias("last_heartbeat"),
        F.lit(None).cast("string").alias("last_error"), F.when(F.col("seqcol") % 3 == 0, F.col("meta")).alias("meta"), "seqcol")
    return eventlog.heartbeats(beats)
