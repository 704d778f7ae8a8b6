"""Raw messages as a stream: lines of text to typed ticks, bad lines to rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.sources.trades import parse_trade_json
from tickbars.streaming.bars import MAX_FILES
from tickbars.streaming.state import BatchFn

#: Makes ticks out of messages, and keeps the named columns of the messages.
Parser = Callable[..., DataFrame]


def read_messages(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """A stream of text files, one message to a line, in column ``value``."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def reject_reason(message: Column) -> Column:
    """Why a tick cannot be used; null if it can."""
    return F.when(F.get_json_object(message, "$").isNull(), "not JSON").when(F.col("symbol").isNull(), "no symbol") \
        .when(F.col("seq").isNull(), "no id").when(F.col("ts_ns").isNull(), "no time")


def parsed(messages: DataFrame, parse: Parser = parse_trade_json) -> DataFrame:
    """Ticks with their message and, for bad ones, a reason; on a stream or a table."""
    return parse(messages, keep=("value",)).withColumn("reason", reject_reason(F.col("value"))) \
        .withColumn("accepted", F.col("reason").isNull()).withColumn("value", F.when(~F.col("accepted"), F.col("value")))


def message_writer(path: str) -> BatchFn:
    """A ``foreachBatch`` function over ``parsed`` rows: both kinds in one write, apart by folder."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/batch_id={batch_id}")
    return write


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The ticks that were written."""
    return spark.read.parquet(path).filter("accepted = 'true'").drop("accepted", "reason", "value")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """Lines that gave no tick, and why."""
    return spark.read.parquet(path).filter("accepted = 'false'").select("batch_id", "value", "reason")
