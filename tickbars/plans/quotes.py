"""Quote state, volume increments, subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.operators import quotes
from tickbars.plans.registry import Tables, query

_FIELDS = ("lp", "bid", "ask", "volume")


def updates(t: Tables) -> DataFrame:
    """Quote updates named by their subscription key."""
    ex, sym = F.upper("exchange"), F.upper("symbol")
    return t.view("quote_updates").select(F.concat_ws(":", ex, sym).alias("sub_key"), ex.alias("exchange"), sym.alias("symbol"),
                                          "arrival", "lp_time", *_FIELDS)


def quote_state(t: Tables) -> DataFrame:
    return quotes.quote_state(updates(t), fields=_FIELDS)


def quotes_table(t: Tables) -> DataFrame:
    """The quotes table, with the arrival number kept to break ties in time."""
    return quotes.material_quotes(quote_state(t)).select(
        F.col("exchange").alias("Exchange"), F.col("symbol").alias("Symbol"), F.col("lp_time").alias("LpTime"),
        F.col("lp").alias("LastPrice"), F.col("bid").alias("Bid"), F.col("ask").alias("Ask"), F.col("volume").alias("Volume"),
        F.lit(None).cast("double").alias("Change"), F.lit(None).cast("double").alias("ChangePct"),
        F.coalesce("vol_delta", F.lit(0.0)).alias("VolDelta"), "arrival")


@query("quote_carry_forward", "quote_state", "SELECT sub_key, arrival, lp, bid, ask, volume FROM quote_state")
def quote_carry_forward(t: Tables) -> DataFrame:
    return quote_state(t).select("sub_key", "arrival", *_FIELDS)


@query("volume_delta", "quote_state", "SELECT sub_key, arrival, volume, vol_delta FROM quote_state")
def volume_delta(t: Tables) -> DataFrame:
    return quote_state(t).select("sub_key", "arrival", "volume", "vol_delta")


@query("material_quotes", "quotes", "SELECT Exchange, Symbol, LpTime, LastPrice, Bid, Ask, Volume, VolDelta, arrival FROM quotes")
def material_quotes(t: Tables) -> DataFrame:
    return quotes_table(t).drop("Change", "ChangePct")


@query("known_subscriptions", "quote_updates", """
SELECT arrival, concat(upper(exchange), ':', upper(symbol)) AS sub_key, lp FROM quote_updates
WHERE concat(upper(exchange), ':', upper(symbol)) IN
  (SELECT concat('NYSE:', upper(event_type)) FROM events UNION SELECT concat('CME:', upper(event_type)) FROM events WHERE value > 50)""")
def known_subscriptions(t: Tables) -> DataFrame:
    events = t.table("events")
    nyse = events.select(F.concat(F.lit("NYSE:"), F.upper("event_type")).alias("sub_key"))
    cme = events.filter("value > 50").select(F.concat(F.lit("CME:"), F.upper("event_type")).alias("sub_key"))
    return quotes.known_subscriptions(updates(t), nyse.union(cme).distinct()).select("arrival", "sub_key", "lp")
