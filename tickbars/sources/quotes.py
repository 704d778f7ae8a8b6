"""Raw quote messages to update rows and ticks, and quote ticks to table rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars import schemas
from tickbars.functions import ns_to_ntz, s_to_ns, split_exchange_symbol, to_double


_MARK = "~m~"
#: Frames that leave a task together.
FRAME_ROWS = 10_000


def _split_frames(text: str | None) -> Iterator[str]:
    """Messages of one length-prefixed text, one by one; stops at the first malformed frame."""
    at = 0
    while text is not None and text.startswith(_MARK, at):
        start = at + len(_MARK)
        end = text.find(_MARK, start)
        size = text[start:end].strip() if end >= 0 else ""
        if not size.isdecimal():
            break
        body = end + len(_MARK)
        at = body + int(size)
        yield text[body:at]


def explode_frames(raw: DataFrame, column: str = "value") -> DataFrame:
    """One row per JSON message of each framed text; heartbeats and broken JSON are dropped.

    Lengths decide where a frame ends, so a text has to be walked through; that step runs in Python, over Arrow
    batches, and hands on bounded numbers of frames, however many one text holds.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rows, frames = [], []

            def found() -> pa.RecordBatch:
                columns = batch.take(pa.array(rows, pa.int64())).columns
                columns[at] = pa.array(frames, batch.schema.field(at).type)
                return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

            for i, text in enumerate(batch.column(at).to_pylist()):
                for frame in _split_frames(text):
                    if not frame.startswith("~h~"):
                        rows.append(i)
                        frames.append(frame)
                        if len(frames) == FRAME_ROWS:
                            yield found()
                            rows, frames = [], []
            yield found()

    return raw.mapInArrow(split, raw.schema).filter(F.try_parse_json(column).isNotNull())


def parse_quote_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Quote messages to one row per update: its place in the message, key, exchange, symbol, and the
    fields the update brings.

    Messages of another kind are ignored; the update part may be one object or a list of them.
    Numbers that cannot be read are null, so that the last known value is kept later on.
    """
    second = F.get_json_object(column, "$.p[1]")
    as_list = F.when(F.substring(F.ltrim(second), 1, 1) == "[", second) \
        .otherwise(F.concat(F.lit("["), second, F.lit("]")))
    others = [c for c in raw.columns if c != column]
    v = F.col("u.v")
    key = F.trim(F.col("u.n"))
    exchange, symbol = split_exchange_symbol(key)
    return raw.filter(F.get_json_object(column, "$.m") == "qsd") \
        .select(*others, F.posexplode(F.from_json(as_list, f"ARRAY<{schemas.QUOTE_UPDATE}>")).alias("pos", "u")) \
        .filter(key != "") \
        .select(
            *others,
            "pos",
            key.alias("sub_key"),
            exchange.alias("exchange"),
            symbol.alias("symbol"),
            to_double(v["lp"]).alias("lp"),
            to_double(v["bid"]).alias("bid"),
            to_double(v["ask"]).alias("ask"),
            to_double(v["volume"]).alias("volume"),
            to_double(v["ch"]).alias("ch"),
            to_double(v["chp"]).alias("chp"),
            s_to_ns(v["lp_time"]).alias("lp_time_ns"),
        )


def quotes_to_ticks(quotes: DataFrame) -> DataFrame:
    """Merged quote rows (see ``operators.quotes.quote_state``) to ticks."""
    return quotes.select(
        F.lit(schemas.QUOTE_PROVIDER).alias("provider"),
        F.lit(schemas.QUOTES).alias("stream"),
        F.upper("symbol").alias("symbol"),
        F.col("lp_time_ns").alias("ts_ns"),
        F.lit(None).cast("bigint").alias("seq"),
        F.struct(
            F.upper(F.coalesce("exchange", F.lit(""))).alias("exchange"),
            F.col("lp").alias("last_price"),
            F.col("bid").alias("bid"),
            F.col("ask").alias("ask"),
            F.col("volume").alias("volume"),
            F.col("ch").alias("change"),
            F.col("chp").alias("change_pct"),
            F.coalesce("vol_delta", F.lit(0.0)).alias("vol_delta"),
        ).alias("payload"),
        F.lit(False).alias("is_final"),
    )


def flatten_quotes(ticks: DataFrame) -> DataFrame:
    """Quote ticks to rows of the quotes table."""
    p = F.col("payload")
    return ticks.select(
        F.coalesce(p["exchange"], F.lit("")).alias("Exchange"),
        F.col("symbol").alias("Symbol"),
        ns_to_ntz(F.col("ts_ns")).alias("LpTime"),
        p["last_price"].alias("LastPrice"),
        p["bid"].alias("Bid"),
        p["ask"].alias("Ask"),
        p["volume"].alias("Volume"),
        p["change"].alias("Change"),
        p["change_pct"].alias("ChangePct"),
        p["vol_delta"].alias("VolDelta"),
    )
