"""Writing ticks and rows: routing by stream, the journal, partitioned tables, text output."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickbars import schemas
from tickbars.functions import ns_to_ntz
from tickbars.operators.batches import PRUNE_SAFETY_BATCHES, set_watermarks, slowest_cursor
from tickbars.operators.eventlog import event_rows
from tickbars.operators.filters import filter_provider_stream
from tickbars.operators.latest import canonical_upsert, upsert_into, with_natural_key
from tickbars.session import exists, remove
from tickbars.sources.quotes import flatten_quotes
from tickbars.sources.trades import flatten_trades
from tickbars.sources.vendor import flatten_bars

#: Batches that stand beside the blocks of the canonical table before they are merged into them.
FOLD_EVERY = 16
#: Size of a file that is large enough.
TARGET_BYTES = 128 << 20


@dataclass(frozen=True)
class Route:
    """How the ticks of one (provider, stream) become rows of a table."""

    flatten: Callable[[DataFrame], DataFrame]
    payload: str
    table: str


ROUTES: dict[tuple[str, str], Route] = {
    (schemas.TRADE_PROVIDER, schemas.TRADES): Route(flatten_trades, schemas.TRADE_PAYLOAD, "trades"),
    (schemas.QUOTE_PROVIDER, schemas.QUOTES): Route(flatten_quotes, schemas.QUOTE_PAYLOAD, "quotes"),
    (schemas.QUOTE_PROVIDER, schemas.BARS): Route(flatten_bars, schemas.BAR_PAYLOAD, "bars"),
}


def typed_payload(ticks: DataFrame, payload: str) -> DataFrame:
    """Ticks with a JSON payload to ticks with a struct payload; malformed text gives null fields."""
    if dict(ticks.dtypes)["payload"] != "string":
        return ticks
    return ticks.withColumn("payload", F.from_json("payload", payload))


def routed(ticks: DataFrame, provider: str, stream: str, routes: Mapping[tuple[str, str], Route] = ROUTES) -> DataFrame:
    """Table rows of one (provider, stream)."""
    route = routes[(provider, stream)]
    own = ticks.filter((F.col("provider") == provider) & (F.col("stream") == stream))
    return route.flatten(typed_payload(own, route.payload))


def unrouted(ticks: DataFrame, routes: Mapping[tuple[str, str], Route] = ROUTES) -> DataFrame:
    """Event log rows for pairs without a route, one per pair."""
    known = F.lit(False)
    for provider, stream in routes:
        known = known | ((F.col("provider") == provider) & (F.col("stream") == stream))
    pairs = ticks.filter(~F.coalesce(known, F.lit(False))).groupBy("provider", "stream").agg(F.count(F.lit(1)).alias("rows"))
    text = F.concat(F.lit("no writer registered for provider="), F.coalesce("provider", F.lit("")), F.lit(" stream="), F.coalesce("stream", F.lit("")))
    return event_rows(pairs, service=F.lit("feeder"), name=F.lit("writer_missing"), role=F.lit("sink"), level=F.lit("WARN"),
                      code=F.lit("NO_WRITER"), message=text, meta=[F.col("rows")])


def route_by_stream(root: str, routes: Mapping[tuple[str, str], Route] = ROUTES, event_log: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each stream of a batch to its table.

    A batch is landed once, in a folder per (provider, stream), and each route reads its own folder. It writes
    to its own ``batch_id=`` folder of each table, so a retry replaces what the failed attempt left.
    """
    def write(ticks: DataFrame, batch_id: int) -> None:
        spark, staging = ticks.sparkSession, f"{root}-landed/batch={batch_id}"
        ticks.write.mode("overwrite").partitionBy("provider", "stream").parquet(staging)
        landed = spark.read.schema(ticks.schema).parquet(staging)
        for (provider, stream), route in routes.items():
            routed(landed, provider, stream, routes).write.mode("overwrite").parquet(f"{root}/{route.table}/batch_id={batch_id}")
        if event_log:
            unrouted(landed, routes).write.mode("overwrite").parquet(f"{event_log}/batch_id={batch_id}")
        remove(spark, staging)
    return write


def journal_append(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends a batch to the hot journal, once per batch id."""
    def write(ticks: DataFrame, batch_id: int) -> None:
        rows = ticks.drop("batch_id")
        rows.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
    return write


def write_journal(ticks: DataFrame, root: str) -> None:
    """Write ticks that carry their batch ids; each batch present replaces its stored self.

    Rebalancing by batch keeps files few, and splits a batch that is too large for one task.
    """
    ticks.hint("rebalance", "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(root)


def key_block(ids_per_block: int, days_per_block: int) -> Column:
    """Folder of a natural key: a range of sequence ids, or of days for ticks without one.

    Ranges, unlike hashes, keep a live batch to the few newest folders.
    """
    days = F.floor(F.col("ts_ns") / F.lit(days_per_block * 86_400_000_000_000))
    ids = F.floor(F.col("seq") / F.lit(ids_per_block))
    return F.when(F.col("seq").isNull(), F.concat(F.lit("t"), days)).otherwise(F.concat(F.lit("s"), ids))


def canonical_merge(root: str, ties: Iterable[str] = (), ids_per_block: int = 10_000_000, days_per_block: int = 1) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the canonical table: one best row per natural key.

    The table is partitioned by blocks of keys. Only the blocks a batch touches are read; their merged
    rows go to a staging folder, complete or not at all, and from there replace the blocks. A batch
    that failed while replacing goes on from its staging folder; one that failed before merges again.
    """
    ties, folders = tuple(ties), ("provider", "stream", "block")

    def write_blocks(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)

    def write(ticks: DataFrame, batch_id: int) -> None:
        spark, staging = ticks.sparkSession, f"{root}-staging/batch={batch_id}"
        rows = ticks if "batch_id" in ticks.columns else ticks.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows = with_natural_key(rows).withColumn("block", key_block(ids_per_block, days_per_block))
        if not exists(spark, f"{staging}/_SUCCESS"):
            if exists(spark, root):
                rows = rows.persist()
                merged = upsert_into(_touched_blocks(spark.read.schema(rows.schema).parquet(root), rows, folders).select(*rows.columns), rows, ties)
            else:
                merged = canonical_upsert(rows, ties)
            write_blocks(merged.hint("rebalance", *folders), staging)
            rows.unpersist()
        # Staged files lie in their folders already: they are read and written as they are, without another shuffle.
        write_blocks(spark.read.schema(rows.schema).parquet(staging), root)
        remove(spark, staging)
    return write


def _touched_blocks(stored: DataFrame, rows: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """Stored rows of the folders that a batch touches; a missing provider or stream is a folder like any other."""
    touched = rows.select(*[F.col(c).alias(f"_{c}") for c in folders]).distinct()
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in folders])
    return stored.join(touched, same, "left_semi")


def canonical_deltas(root: str, ties: Iterable[str] = (), fold_every: int = FOLD_EVERY, **blocks: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the canonical table as blocks of keys and newer batches beside them.

    A batch only writes its own best rows; ``canonical_rows`` picks the best of all. Every so many batches, those since are
    merged into the blocks they touch and removed. Until then a row may stand in both places, which changes
    nothing, so a failed batch is simply run again.
    """
    ties, merge = tuple(ties), canonical_merge(f"{root}/blocks", ties, **blocks)

    def fold(spark: SparkSession, end: int) -> None:
        if exists(spark, f"{root}/deltas/delta={end - 1}"):
            merge(spark.read.parquet(f"{root}/deltas").filter(F.col("delta") < end).drop("delta"), end)
            for batch_id in range(end - fold_every, end):
                remove(spark, f"{root}/deltas/delta={batch_id}")

    def write(ticks: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % fold_every == 0:
            fold(ticks.sparkSession, batch_id)
        rows = ticks if "batch_id" in ticks.columns else ticks.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        canonical_upsert(rows, ties).write.mode("overwrite").parquet(f"{root}/deltas/delta={batch_id}")
    return write


def canonical_rows(spark: SparkSession, root: str, ties: Iterable[str] = ()) -> DataFrame:
    """The canonical table kept by ``canonical_deltas``: the best row of each natural key."""
    newer = spark.read.parquet(f"{root}/deltas").drop("delta")
    if not exists(spark, f"{root}/blocks"):
        return canonical_upsert(newer, tuple(ties))
    schema = StructType([*newer.schema, StructField("block", StringType())])
    return canonical_upsert(spark.read.schema(schema).parquet(f"{root}/blocks").drop("block").unionByName(newer), tuple(ties))


def journal_and_canonical(journal_root: str, canonical_root: str, ties: Iterable[str] = (), **settings: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for both tables: the batch goes to the hot journal, and from there, as it was
    stored, into the canonical table (see ``canonical_deltas``). Either step can be repeated."""
    append, merge = journal_append(journal_root), canonical_deltas(canonical_root, ties, **settings)

    def write(ticks: DataFrame, batch_id: int) -> None:
        append(ticks, batch_id)
        columns = [f for f in ticks.schema if f.name != "batch_id"]
        merge(ticks.sparkSession.read.schema(StructType(columns)).parquet(f"{journal_root}/batch_id={batch_id}"), batch_id)
    return write


def prune_batches(spark: SparkSession, root: str, last_committed: int, safety: int = PRUNE_SAFETY_BATCHES) -> int:
    """Delete the ``batch_id=`` folders of a journal up to ``last_committed - safety``; gives the rows that went."""
    cutoff = last_committed - safety
    if cutoff <= 0:
        return 0
    old = spark.read.parquet(root).filter(F.col("batch_id") <= cutoff).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows")).collect()
    for row in old:
        remove(spark, f"{root}/batch_id={row.batch_id}")
    return sum(row.rows for row in old)


def prune_by_cursors(spark: SparkSession, root: str, cursors: DataFrame, consumers: Sequence[str], safety: int = PRUNE_SAFETY_BATCHES) -> int:
    """Delete batches of a journal that every consumer has read, but for the last ``safety`` of them; gives the rows that went.

    ``cursors`` is the history of named cursors. A consumer that is behind, or has no cursor yet, holds back all it has not read.
    """
    return prune_batches(spark, root, slowest_cursor(cursors, consumers), safety)


def cursor_writer(batch: Callable[[DataFrame, int], None], consumer: str, path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that moves the consumer's cursor to the newest batch of the feed, once its rows are written."""
    def run(rows: DataFrame, batch_id: int) -> None:
        batch(rows, batch_id)
        newest = rows.agg(F.max("batch_id").alias("last_offset")).filter("last_offset IS NOT NULL")
        set_watermarks(newest.withColumn("scope", F.lit(consumer)), path, batch_id)
    return run


def hot_dir(root: str, provider: str, stream: str, layout: str = "flat") -> str:
    """Folder of one stream: ``root/provider_stream``, or ``root/provider/stream`` when nested."""
    return f"{root}/{provider}/{stream}" if layout == "nested" else f"{root}/{provider}_{stream}"


def write_ticks(ticks: DataFrame, root: str, mode: str = "append", unit: str = "day", write_id: int | None = None) -> None:
    """Ticks to a Parquet table partitioned by provider, stream and date (the first of each ``unit``).

    Rebalancing splits a folder that holds a large share of the rows over several tasks and files. A job that may
    be repeated gives its ``write_id``: its rows have folders of their own, which a repetition replaces.
    """
    folders = ["provider", "stream", "date"]
    rows = ticks.withColumn("date", F.to_date(F.date_trunc(unit, ns_to_ntz(F.col("ts_ns")))))
    if write_id is None:
        rows.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).parquet(root)
    else:
        rows.withColumn("write_id", F.lit(write_id)).hint("rebalance", *folders).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "write_id").parquet(root)


def crowded_folders(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``folder, files, bytes`` of the folders of a table that hold more files than their size asks for.

    Reads names and sizes of files only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    folders = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length").groupBy("folder") \
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return folders.filter(F.col("files") > F.ceil(F.col("bytes") / target_bytes))


def compact_partitions(spark: SparkSession, root: str, partitions: tuple[str, ...] = ("provider", "stream", "date"), *,
                       target_bytes: int = TARGET_BYTES, folders_at_once: int = 1000) -> int:
    """Rewrite the crowded folders of a partitioned table in place, and only those; gives their number.

    The rows go to a staging folder, complete or not at all, and from there replace their folders. A run that failed while
    replacing goes on from its staging folder.
    """
    staging, schema = f"{root}-compacted", spark.read.parquet(root).schema

    def put(rows: DataFrame, path: str) -> None:
        rows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)

    def replace() -> None:
        put(spark.read.schema(schema).parquet(staging), root)
        remove(spark, staging)

    if exists(spark, f"{staging}/_SUCCESS"):
        replace()
    names = [r.folder for r in crowded_folders(spark, root, target_bytes).select("folder").collect()]  # names of folders, not of files
    for at in range(0, len(names), folders_at_once):
        put(spark.read.schema(schema).option("basePath", root).parquet(*names[at:at + folders_at_once]), staging)
        replace()
    return len(names)


def rows_to_ndjson(rows: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows_to_ndjson(rows).write.mode("overwrite").text(path)


def replay_journal(journal: DataFrame, since_ns: int, providers: Iterable[str] | None = None, streams: Iterable[str] | None = None) -> DataFrame:
    """Journal rows from an instant on, to go through the same functions as live ticks.

    Order does not matter to those functions, so none is imposed.
    """
    return filter_provider_stream(journal, providers, streams).filter(F.col("ts_ns") >= since_ns)


def replay_summary(replayed: DataFrame) -> DataFrame:
    """Rows replayed and the last instant, 0 and 0 if there was nothing."""
    return replayed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("ts_ns"), F.lit(0)).alias("last_ts_ns"))
