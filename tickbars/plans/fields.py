"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import (bar_id, epoch_us, iso_utc, ms_to_ns, ns_to_ntz, parse_instant, part_to_phase, s_to_ns, schema_resolution,
                                stream_key, time_bucket, to_double, to_long, us_to_ntz, vwap)
from tickbars.operators import filters
from tickbars.plans.quotes import quotes_table
from tickbars.plans.registry import Tables, query

START_NS, END_NS = 1_704_844_800_000_000_000, 1_705_449_600_500_000_000
_RANGE = "Timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND Timestamp <= TIMESTAMP '2024-01-17 00:00:00.5'"


@query("filter_symbol", "trades", "SELECT Symbol, TradeID, Price FROM trades WHERE Symbol IN ('CLICK', 'VIEW')")
def filter_symbol(t: Tables) -> DataFrame:
    return filters.filter_symbol(t.view("trades"), ["CLICK", "VIEW"]).select("Symbol", "TradeID", "Price")


@query("filter_exchange", "quotes", "SELECT Exchange, Symbol, LpTime, LastPrice FROM quotes WHERE Exchange = 'NYSE'")
def filter_exchange(t: Tables) -> DataFrame:
    return filters.filter_exchange(quotes_table(t), "nyse").select("Exchange", "Symbol", "LpTime", "LastPrice")


@query("filter_time_range", "trades", f"SELECT Symbol, TradeID, Timestamp FROM trades WHERE {_RANGE}")
def filter_time_range(t: Tables) -> DataFrame:
    return filters.filter_time_range(t.view("trades"), "Timestamp", START_NS, END_NS).select("Symbol", "TradeID", "Timestamp")


@query("project_fields", "trades", "SELECT Timestamp, Symbol, Price FROM trades")
def project_fields(t: Tables) -> DataFrame:
    live = filters.project_fields(t.view("trades"), ["timestamp", "SYMBOL", "price", "nothing"])
    return filters.project_fields(live, ["Price"], ("Timestamp", "Symbol"), case_sensitive=True).select("Timestamp", "Symbol", "Price")


@query("time_bucket", "trades", """
SELECT TradeID, time_bucket(INTERVAL '1' MINUTE, Timestamp) AS m1, time_bucket(INTERVAL '5' MINUTE, Timestamp) AS m5,
       date_trunc('day', Timestamp) AS day FROM trades""")
def buckets(t: Tables) -> DataFrame:
    ts = F.col("Timestamp")
    rows = t.view("trades").select("TradeID", "Timestamp", time_bucket(ts, 1).alias("m1"))
    return rows.withColumn("m5", time_bucket(ts, 5)).withColumn("day", time_bucket(ts, 1440)).drop("Timestamp")


@query("bar_id", "trades", """
SELECT TradeID, hour(Timestamp) * 60 + minute(Timestamp) AS id_1m, (hour(Timestamp) * 60 + minute(Timestamp)) // 5 AS id_5m FROM trades""")
def bar_ids(t: Tables) -> DataFrame:
    return t.view("trades").select("TradeID", bar_id(F.col("Timestamp"), 1).alias("id_1m"), bar_id(F.col("Timestamp"), 5).alias("id_5m"))


@query("vwap", "trades", """
SELECT Symbol, CAST(Timestamp AS DATE) AS day, Quantity = 0 AS no_volume,
       round(CASE WHEN sum(Quantity) <> 0 THEN sum(Price * Quantity) / sum(Quantity) END, 6) AS vwap FROM trades GROUP BY ALL""")
def average_prices(t: Tables) -> DataFrame:
    groups = t.view("trades").groupBy("Symbol", F.to_date("Timestamp").alias("day"), (F.col("Quantity") == 0).alias("no_volume"))
    return groups.agg(F.round(vwap(F.sum(F.col("Price") * F.col("Quantity")), F.sum("Quantity")), 6).alias("vwap"))


@query("null_ternary_cast", "quote_updates", """
SELECT arrival, lp IS NULL AS lp_missing, CASE WHEN volume IS NULL THEN 0 ELSE 1 END AS has_volume FROM quote_updates""")
def null_ternary_cast(t: Tables) -> DataFrame:
    return t.view("quote_updates").select("arrival", F.col("lp").isNull().alias("lp_missing"), F.col("volume").isNotNull().cast("int").alias("has_volume"))


@query("text_functions", "quote_updates", """
SELECT arrival, upper(symbol) AS up, lower(upper(symbol)) AS low, trim('  ' || symbol || ' ') AS trimmed,
       split_part(exchange || ':' || symbol, ':', 2) AS after_colon, concat_ws(',', exchange, symbol) AS csv FROM quote_updates""")
def text_functions(t: Tables) -> DataFrame:
    joined = F.concat_ws(":", "exchange", "symbol")
    return t.view("quote_updates").select(
        "arrival", F.upper("symbol").alias("up"), F.lower(F.upper("symbol")).alias("low"),
        F.trim(F.concat(F.lit("  "), "symbol", F.lit(" "))).alias("trimmed"), F.split(joined, ":", 2)[1].alias("after_colon"),
        F.concat_ws(",", "exchange", "symbol").alias("csv"))


@query("epoch_convert", "trades", """
SELECT TradeID, (epoch_us(Timestamp) // 1000) * 1000000 AS from_ms, CAST((epoch_us(Timestamp) // 1000000) * 1e9 AS BIGINT) AS from_s,
       Timestamp AS from_ns, date_trunc('second', Timestamp) AS from_seconds_text,
       Timestamp AS from_ns_text, Timestamp AS from_iso, CAST(NULL AS TIMESTAMP) AS from_junk,
       CASE WHEN epoch_us(Timestamp) % 1000000 = 0 THEN strftime(Timestamp, '%Y-%m-%dT%H:%M:%SZ')
            ELSE strftime(Timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso FROM trades""")
def epoch_convert(t: Tables) -> DataFrame:
    us = epoch_us(F.col("Timestamp"))
    seconds = F.floor(us / F.lit(1_000_000)).cast("bigint")
    ns = us * 1000
    return t.view("trades").select(
        "TradeID",
        ms_to_ns(F.floor(us / F.lit(1000)).cast("bigint")).alias("from_ms"),
        s_to_ns(seconds.cast("string")).alias("from_s"),
        ns_to_ntz(ns).alias("from_ns"),
        parse_instant(seconds.cast("string")).alias("from_seconds_text"),
        parse_instant(ns.cast("string")).alias("from_ns_text"),
        parse_instant(iso_utc(us_to_ntz(us))).alias("from_iso"),
        parse_instant(F.col("Symbol")).alias("from_junk"),
        iso_utc(F.col("Timestamp")).alias("iso"),
    )


@query("safe_cast", "", """
SELECT event_id, TRY_CAST(value AS DOUBLE) AS as_double, CAST(NULL AS DOUBLE) AS bad_double, event_id AS as_long,
       CAST(NULL AS BIGINT) AS bad_long FROM events""")
def safe_cast(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", to_double(F.col("value").cast("string")).alias("as_double"), to_double(F.col("props")).alias("bad_double"),
                                    to_long(F.col("event_id").cast("string")).alias("as_long"), to_long(F.col("event_type")).alias("bad_long"))


@query("schema_resolution", "", """
SELECT event_id, CASE event_type WHEN 'click' THEN '1m' WHEN 'view' THEN '5m' END AS res FROM events""")
def resolution(t: Tables) -> DataFrame:
    schema = F.when(F.col("event_type") == "click", "ohlcv_1m").when(F.col("event_type") == "view", "ohlcv_5m").otherwise("trades")
    return t.table("events").select("event_id", schema_resolution(schema).alias("res"))


@query("part_to_phase", "", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'close' WHEN 'error' THEN 'snapshot' ELSE 'update' END AS phase FROM events""")
def phases(t: Tables) -> DataFrame:
    part = F.when(F.col("event_type") == "click", "added").when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "snapshot") \
        .when(F.col("event_type") == "signup", "updated").otherwise("else")
    return t.table("events").select("event_id", part_to_phase(part).alias("phase"))


@query("stream_key", "quote_updates", """
SELECT arrival, 'tradingview|quotes|' || upper(symbol) || CASE WHEN exchange = 'cme' THEN '' ELSE '@' || upper(exchange) END AS stream_key FROM quote_updates""")
def stream_keys(t: Tables) -> DataFrame:
    exchange = F.when(F.col("exchange") != "cme", F.col("exchange"))
    return t.view("quote_updates").select("arrival", stream_key(F.lit("tradingview"), F.lit("quotes"), F.upper("symbol"), exchange).alias("stream_key"))
