"""Subscription specs: one row per (provider, stream, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars import schemas


def read_feed_specs(spark: SparkSession, path: str) -> DataFrame:
    """Subscription file (a JSON list) to normalized feed rows."""
    return feed_specs(spark.read.schema(schemas.FEED_SPEC).json(path, multiLine=True))


def feed_specs(specs: DataFrame, *, invalid: str = "fail") -> DataFrame:
    """Normalize specs and give one row per stream.

    Providers and streams are trimmed and lowered, symbols made unique in first-seen order, upper
    case for the trade provider only. A spec without provider, name or streams fails the job, or is
    left out with ``invalid="drop"``.
    """
    provider = F.lower(F.trim(F.coalesce("provider", F.lit(""))))
    name = F.trim(F.coalesce("name", F.lit("")))
    given = F.coalesce("symbols", F.array().cast("array<string>"))
    cased = F.when(provider == schemas.TRADE_PROVIDER, F.transform(given, F.upper)).otherwise(given)
    valid = (provider != "") & (name != "") & (F.coalesce(F.size("streams"), F.lit(0)) > 0)
    normalized = specs.select(
        provider.alias("provider"),
        name.alias("name"),
        F.transform("streams", lambda s: F.lower(F.trim(s))).alias("streams"),
        F.array_distinct(cased).alias("symbols"),
        F.coalesce("autostart", F.lit(False)).alias("autostart"),
        F.col("extra"),
        valid.alias("valid"),
    )
    if invalid == "fail":
        checked = F.when(F.col("valid"), True).otherwise(
            F.raise_error(F.concat(F.lit("feed spec without provider, name or streams: "), F.to_json(F.struct("provider", "name")))).cast("boolean"))
        normalized = normalized.filter(checked)
    else:
        normalized = normalized.filter("valid")
    return normalized.select("provider", F.explode("streams").alias("stream"), "name", "symbols", "autostart", "extra") \
        .withColumn("feeder", F.concat_ws(":", "provider", "stream", "name"))


def subscribed_keys(feeds: DataFrame) -> DataFrame:
    """Distinct subscription keys (``EXCH:SYM``, upper case) of the feeds."""
    return feeds.select(F.upper(F.trim(F.explode("symbols"))).alias("sub_key")).distinct()
