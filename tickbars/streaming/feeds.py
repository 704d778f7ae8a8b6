"""Live feeds: change feed, subscriptions, gapless attach, independent consumers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickbars.functions import instant_to_ns
from tickbars.operators.feed import FeedSpec, gapless_feed, gapless_watermark
from tickbars.operators.filters import filter_exchange, filter_symbol, project_fields
from tickbars.operators.latest import best_per_key
from tickbars.session import exists, touch
from tickbars.streaming.state import BatchFn, Versions, start

#: Makes a batch function of ticks out of one of bars.
Through = Callable[[BatchFn], BatchFn]


def bar_changes(out: str, state: str) -> BatchFn:
    """A function over changed bars, of ``LiveBars.batch`` or ``stream_changed_bars`` (update mode), that labels bar rows.

    A bar is added in the first batch that holds trades of it and updated in later ones. It is
    completed, once, when a newer bar of its symbol exists; one that arrives behind the newest is
    added and completed at once. Bars themselves live in the engine's state; kept here is the open
    bar of each symbol.
    """
    opened = Versions(state)

    def run(changed: DataFrame, batch_id: int) -> None:
        changed = changed.persist()
        values = [c for c in changed.columns if c not in ("first_batch", "last_batch")]
        before = opened.before(changed.sparkSession, batch_id)
        if before is None:
            before = changed.select(*values).limit(0)
        known = before.select("Symbol", F.col("Timestamp").alias("_before"))
        newest = changed.groupBy("Symbol").agg(F.max("Timestamp").alias("_newest"))

        added = F.col("first_batch") == F.col("last_batch")
        was_open = F.coalesce(F.col("Timestamp") == F.col("_before"), F.lit(False))
        done = (F.col("Timestamp") < F.greatest("_newest", "_before")) & (added | was_open)
        parts = F.array_compact(F.array(F.when(added, F.lit("added")).otherwise("updated"), F.when(done, F.lit("completed"))))
        labelled = changed.join(newest, "Symbol").join(known, "Symbol", "left").select(*values, F.explode(parts).alias("part"))
        untouched = before.join(changed.select("Symbol", "Timestamp"), ["Symbol", "Timestamp"], "left_anti") \
            .join(newest, "Symbol").filter(F.col("Timestamp") < F.col("_newest")).select(*values, F.lit("completed").alias("part"))
        labelled.unionByName(untouched).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        bars = changed.select(*values, F.lit(1).alias("_rank")).unionByName(before.select(*values, F.lit(0).alias("_rank")))
        opened.write(best_per_key(bars, ["Symbol"], F.col("Timestamp").desc(), F.col("_rank").desc()).drop("_rank"), batch_id)
        changed.unpersist()
    return run


def subscribe_foreach(stream: DataFrame, spec: FeedSpec, symbol: str, callback: BatchFn, checkpoint: str, *, fields: Iterable[str] | None = None,
                      exchange: str | None = None, trigger: dict | None = None, through: Through | None = None) -> StreamingQuery:
    """Deliver the rows of one symbol of a feed to a callback, batch by batch.

    Pass trades and, as ``through``, a function that makes a batch function of trades out of one of bars, such as
    ``lambda f: LiveBars(path).batch(1, on_closed=f)``. Or pass completed bars (``stream_bars``, ``closed_by_clock``), or a
    change feed. The symbol is picked out of each batch of the feed: bars of a silent symbol close with the
    progress of the others, or of the clock. The returned query is the subscription; ``stop()`` ends it.
    """
    if not isinstance(symbol, str):
        raise ValueError("only one symbol per subscription")
    shown = stream if through is None else stream.sparkSession.createDataFrame([], ", ".join(f"{c} STRING" for c in spec.cols))
    if project_fields(shown, fields) is None:
        raise ValueError("no requested field exists in this feed")

    def deliver(rows: DataFrame, batch_id: int) -> None:
        own = filter_symbol(rows, symbol, spec.symbol_col)
        if "Exchange" in spec.cols:
            own = filter_exchange(own, exchange)
        callback(project_fields(own, fields), batch_id)
    return start(stream, through(deliver) if through else deliver, checkpoint, trigger=trigger)


def attach_gapless(snapshot: DataFrame, live: DataFrame, spec: FeedSpec, emit: BatchFn, checkpoint: str, *,
                   include_open_bar: bool = True, trigger: dict | None = None, through: Through | None = None) -> StreamingQuery:
    """Emit a snapshot and its boundary, then the stream's rows after the watermark.

    ``live`` streams the same feed, from at least the watermark on; with ``through`` it streams the trades its bars are made
    of, see ``subscribe_foreach``. The snapshot goes out as batch -1. It is attached once ``emit`` has returned from it: only
    then a mark is left beside the checkpoint, and the live rows begin. After a failure before that the snapshot and its
    watermarks are made and sent again; later on, a restart goes on from the kept watermarks with live rows.
    """
    keys, spark, kept = list(spec.keys), snapshot.sparkSession, f"{checkpoint}-attached"
    marks_path, sent = f"{kept}/watermarks", f"{kept}/sent"
    if not exists(spark, sent):
        gapless_watermark(snapshot, keys, spec.time_col, bars=bool(spec.bin_minutes)).write.mode("overwrite").parquet(marks_path)
        emit(gapless_feed(snapshot, snapshot.limit(0), spark.read.parquet(marks_path), keys, spec.time_col, include_open_bar=include_open_bar), -1)
        touch(spark, sent)
    marks = spark.read.parquet(marks_path).withColumnRenamed("watermark_ns", "_mark")

    def after_marks(rows: DataFrame) -> DataFrame:
        later = rows.join(marks, keys, "left").filter(F.col("_mark").isNull() | (instant_to_ns(F.col(spec.time_col)) > F.col("_mark")))
        return later.drop("_mark").withColumns({"phase": F.lit("live"), "part": F.lit("completed")})

    if through is None:
        return start(after_marks(live), emit, checkpoint, trigger=trigger)
    return start(live, through(lambda rows, batch_id: emit(after_marks(rows), batch_id)), checkpoint, trigger=trigger)


def independent_consumers(source: Callable[[], DataFrame], consumers: Mapping[str, BatchFn], checkpoints: str,
                          trigger: dict | None = None) -> dict[str, StreamingQuery]:
    """Several consumers of one feed, each with a checkpoint, and so a cursor, of its own."""
    return {name: start(source(), batch, f"{checkpoints}/{name}", trigger=trigger) for name, batch in consumers.items()}
