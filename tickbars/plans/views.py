"""Views over the given tables that stand in for ticks, bars and logs.

The texts run unchanged in Spark and as SQL; names in braces are the tables a view reads.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": (("events",), """
SELECT 'trade' AS EventType, ts AS EventTime, upper(event_type) AS Symbol, event_id AS TradeID,
       value AS Price, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS Quantity,
       user_id AS BuyerID, CAST(0 AS BIGINT) AS SellerID, ts AS Timestamp,
       (event_id % 2 = 0) AS IsBuyerMaker
FROM {events}"""),
    "trades_user": (("trades",), """
SELECT EventType, EventTime, concat('U', CAST(BuyerID AS STRING)) AS Symbol, TradeID, Price, Quantity,
       BuyerID, SellerID, Timestamp, IsBuyerMaker
FROM {trades}"""),
    "trades_dup": (("trades",), """
SELECT *, 1 AS arrival FROM {trades}
UNION ALL
SELECT EventType, EventTime, Symbol, TradeID, Price + 1, Quantity, BuyerID, SellerID,
       Timestamp + INTERVAL '1' SECOND, IsBuyerMaker, 2 AS arrival
FROM {trades} WHERE TradeID % 7 = 0"""),
    "quote_updates": (("events",), """
SELECT CASE user_id % 3 WHEN 0 THEN 'nyse' WHEN 1 THEN 'cme' ELSE 'bmfbovespa' END AS exchange,
       event_type AS symbol, event_id AS arrival, ts AS lp_time,
       CASE WHEN event_id % 4 = 1 THEN NULL ELSE value END AS lp,
       CASE WHEN event_id % 4 = 2 THEN NULL ELSE value - 0.01 END AS bid,
       CASE WHEN event_id % 4 = 3 THEN NULL ELSE value + 0.01 END AS ask,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE
         (hour(ts) * 3600 + minute(ts) * 60) * 10 + CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS volume
FROM {events}"""),
    "vendor_bars": (("events",), """
SELECT CASE user_id % 3 WHEN 0 THEN 'nyse' WHEN 1 THEN 'cme' ELSE 'bmfbovespa' END AS Exchange,
       event_type AS Symbol, date_trunc('minute', ts) AS Timestamp,
       min_by(value, event_id) AS Open, max(value) AS High, min(value) AS Low,
       max_by(value, event_id) AS Close, CAST(count(*) AS DOUBLE) AS Volume, TRUE AS IsFinal,
       max(event_id) AS arrival
FROM {events}
GROUP BY 1, 2, 3"""),
    # Vendor bars that lag behind: those of the last ten days of each symbol have not come yet.
    "settled_bars": (("vendor_bars",), """
SELECT b.* FROM {vendor_bars} b
JOIN (SELECT Exchange, Symbol, max(Timestamp) - INTERVAL '10' DAY AS until FROM {vendor_bars} GROUP BY Exchange, Symbol) e
  ON b.Exchange = e.Exchange AND b.Symbol = e.Symbol
WHERE b.Timestamp < e.until"""),
    "settled_bars_dup": (("settled_bars",), """
SELECT * FROM {settled_bars}
UNION ALL
SELECT upper(Exchange), Symbol, Timestamp, Open, High + 1, Low, Close + 1, Volume + 1, IsFinal,
       arrival + 1000000
FROM {settled_bars} WHERE arrival % 5 = 0"""),
    "vendor_bars_dup": (("vendor_bars",), """
SELECT * FROM {vendor_bars}
UNION ALL
SELECT upper(Exchange), Symbol, Timestamp, Open, High + 1, Low, Close + 1, Volume + 1, IsFinal,
       arrival + 1000000
FROM {vendor_bars} WHERE arrival % 5 = 0"""),
    "ticks": (("lineitem",), """
SELECT 'tpch' AS provider, lower(l_returnflag) AS stream, concat('P', CAST(l_partkey AS STRING)) AS symbol,
       l_shipdate AS ts,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS seq,
       (l_linestatus = 'F') AS is_final, l_quantity AS qty, l_extendedprice AS price,
       l_orderkey % 64 AS batch_id, l_orderkey AS arrival, l_suppkey AS arrival2
FROM {lineitem}"""),
    "eventlog": (("events",), """
SELECT ts, event_type AS service, concat('i', CAST(user_id AS STRING)) AS name, 'worker' AS role,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
       upper(event_type) AS code, concat('event ', CAST(event_id AS STRING)) AS message, props AS meta,
       concat('c', CAST(event_id AS STRING)) AS corr_id, '' AS parent_corr_id, event_id AS seqcol
FROM {events}"""),
    "configs": (("orders",), """
SELECT o_orderpriority AS provider, concat('n', CAST(o_custkey AS STRING)) AS name, '' AS symbols,
       FALSE AS autostart, (o_orderstatus = 'F') AS deleted, o_orderdate AS updated_at, o_orderkey AS seqcol
FROM {orders}"""),
}

_OHLCV = """
SELECT b AS Timestamp, Symbol, (hour(b) * 60 + minute(b)) // {n} AS BarId,
       arg_min(Price, (Timestamp, TradeID)) AS Open, max(Price) AS High, min(Price) AS Low,
       arg_max(Price, (Timestamp, TradeID)) AS Close, sum(Quantity) AS Volume,
       count(*) AS Trades,
       CASE WHEN sum(Quantity) <> 0 THEN sum(Price * Quantity) / sum(Quantity) END AS Vwap,
       CAST(sum(CAST(IsBuyerMaker AS INT)) AS BIGINT) AS BuyerMakerCount
FROM (SELECT *, time_bucket(INTERVAL '{n}' MINUTE, Timestamp) AS b FROM trades)
GROUP BY b, Symbol"""

_CARRY = "OVER (PARTITION BY exchange, symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# Derived tables the SQL counterparts share.
ORACLE_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars_1m": (("trades",), _OHLCV.replace("{n}", "1")),
    "bars_5m": (("trades",), _OHLCV.replace("{n}", "5")),
    "quote_state": (("quote_updates",), f"""
SELECT *, CASE WHEN volume IS NULL THEN NULL WHEN before IS NULL THEN 0.0
               ELSE greatest(volume - before, 0.0) END AS vol_delta
FROM (
  SELECT *, lag(volume) OVER (PARTITION BY sub_key ORDER BY arrival) AS before
  FROM (
    SELECT concat(upper(exchange), ':', upper(symbol)) AS sub_key, upper(exchange) AS exchange,
           upper(symbol) AS symbol, arrival, lp_time,
           last_value(lp IGNORE NULLS) {_CARRY} AS lp, last_value(bid IGNORE NULLS) {_CARRY} AS bid,
           last_value(ask IGNORE NULLS) {_CARRY} AS ask, last_value(volume IGNORE NULLS) {_CARRY} AS volume
    FROM quote_updates))"""),
    "quotes": (("quote_state",), """
SELECT exchange AS Exchange, symbol AS Symbol, lp_time AS LpTime, lp AS LastPrice, bid AS Bid, ask AS Ask,
       volume AS Volume, coalesce(vol_delta, 0.0) AS VolDelta, arrival
FROM quote_state WHERE lp IS NOT NULL OR bid IS NOT NULL OR ask IS NOT NULL OR vol_delta > 0"""),
    "quote_bars": (("quotes",), """
SELECT b AS Timestamp, Exchange, Symbol, hour(b) * 60 + minute(b) AS BarId,
       arg_min_null(LastPrice, (LpTime, arrival)) AS Open, max(LastPrice) AS High, min(LastPrice) AS Low,
       arg_max_null(LastPrice, (LpTime, arrival)) AS Close, sum(VolDelta) AS Volume, FALSE AS IsFinal
FROM (SELECT *, time_bucket(INTERVAL '1' MINUTE, LpTime) AS b FROM quotes)
GROUP BY b, Exchange, Symbol"""),
    "deduped_bars": (("vendor_bars_dup",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT upper(Exchange) AS Exchange, upper(Symbol) AS Symbol, Timestamp, Open, High, Low, Close, Volume, IsFinal, arrival,
         row_number() OVER (PARTITION BY upper(Exchange), upper(Symbol), Timestamp ORDER BY arrival DESC) AS rn
  FROM vendor_bars_dup) WHERE rn = 1"""),
    "last_bars": (("deduped_bars",), """
SELECT Exchange, Symbol, max(Timestamp) AS LastBarTs FROM deduped_bars GROUP BY Exchange, Symbol"""),
    "settled": (("settled_bars_dup",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT upper(Exchange) AS Exchange, upper(Symbol) AS Symbol, Timestamp, Open, High, Low, Close, Volume, IsFinal, arrival,
         row_number() OVER (PARTITION BY upper(Exchange), upper(Symbol), Timestamp ORDER BY arrival DESC) AS rn
  FROM settled_bars_dup) WHERE rn = 1"""),
    "last_settled": (("settled",), """
SELECT Exchange, Symbol, max(Timestamp) AS LastBarTs FROM settled GROUP BY Exchange, Symbol"""),
    "stitched": (("settled", "last_settled", "quote_bars"), """
SELECT Timestamp, Exchange, Symbol, hour(Timestamp) * 60 + minute(Timestamp) AS BarId, Open, High, Low, Close, Volume, IsFinal
FROM (
  SELECT *, row_number() OVER (PARTITION BY Exchange, Symbol, Timestamp
                               ORDER BY CASE WHEN IsFinal THEN 2 ELSE 1 END DESC, arrival DESC) AS rn
  FROM (
    SELECT Exchange, Symbol, Timestamp, Open, High, Low, Close, Volume, IsFinal, arrival FROM settled
    UNION ALL
    SELECT q.Exchange, q.Symbol, q.Timestamp, q.Open, q.High, q.Low, q.Close, q.Volume, q.IsFinal, 0
    FROM quote_bars q LEFT JOIN last_settled l ON q.Exchange = l.Exchange AND q.Symbol = l.Symbol
    WHERE l.LastBarTs IS NULL OR q.Timestamp > l.LastBarTs))
WHERE rn = 1"""),
    "journal": (("ticks",), """
SELECT *, epoch_us(ts) * 1000 AS ts_ns, coalesce(seq, epoch_us(ts) * 1000) AS nat_key FROM ticks"""),
    "canonical": (("journal",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, stream, symbol, nat_key
    ORDER BY is_final DESC NULLS LAST, batch_id DESC NULLS LAST, seq DESC NULLS LAST, ts_ns DESC NULLS LAST,
             arrival DESC NULLS LAST, arrival2 DESC NULLS LAST, price DESC NULLS LAST, qty DESC NULLS LAST) AS rn
  FROM journal) WHERE rn = 1"""),
    "gaps_arrival": (("trades_user",), """
SELECT Symbol AS symbol, seen + 1 AS start_id, TradeID - 1 AS end_id, epoch_us(Timestamp) * 1000 AS discovered_at_ns
FROM (
  SELECT *, max(TradeID) OVER (PARTITION BY Symbol ORDER BY epoch_us(Timestamp), TradeID
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM trades_user)
WHERE TradeID > seen + 1"""),
    "gaps_sorted": (("trades_user",), """
SELECT Symbol AS symbol, before + 1 AS start_id, TradeID - 1 AS end_id
FROM (SELECT *, lag(TradeID) OVER (PARTITION BY Symbol ORDER BY TradeID) AS before
      FROM (SELECT DISTINCT Symbol, TradeID FROM trades_user))
WHERE TradeID - before > 1"""),
}
