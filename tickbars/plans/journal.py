"""Journal: canonical rows, batches, paging, retention, replay, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.functions import instant_to_ns, payload_or_raw
from tickbars.operators import batches, filters, latest, paging
from tickbars.plans.registry import Tables, query
from tickbars.session import shared_dir
from tickbars.sinks import tables

TIES = ("arrival", "arrival2", "price", "qty")
KEY_COLS = ("provider", "stream", "symbol", "nat_key", "is_final", "batch_id", "seq", "ts_ns", "price", "qty")
_KEYS = ", ".join(KEY_COLS)
SINCE = "2000-01-01 00:00:00"
SINCE_NS = 946_684_800_000_000_000
START_BATCH, N_BATCHES = 10, 5
LAST_COMMITTED, SAFETY = 63, 20


def journal(t: Tables) -> DataFrame:
    """Ticks with nanosecond times, natural keys and a JSON payload."""
    ticks = t.view("ticks").withColumn("ts_ns", instant_to_ns(F.col("ts")))
    return latest.with_natural_key(ticks).withColumn("payload", F.to_json(F.struct("qty", "price")))


def canonical(t: Tables) -> DataFrame:
    return latest.canonical_upsert(journal(t), TIES)


@query("canonical_upsert", "canonical", f"SELECT {_KEYS} FROM canonical")
def canonical_upsert(t: Tables) -> DataFrame:
    return canonical(t).select(*KEY_COLS)


@query("canonical_merge", "canonical", f"SELECT {_KEYS} FROM canonical")
def canonical_merge(t: Tables) -> DataFrame:
    """The upsert applied batch by batch: the first half of the batches, then the second."""
    rows, root = journal(t), shared_dir(t.spark, "canonical")
    merge = tables.canonical_deltas(root, TIES, days_per_block=365)
    merge(rows.filter("batch_id < 32"), 0)
    merge(rows.filter("batch_id >= 32"), 1)
    return tables.canonical_rows(t.spark, root, TIES).select(*KEY_COLS)


@query("canonical_folded", "canonical", f"SELECT {_KEYS} FROM canonical")
def canonical_folded(t: Tables) -> DataFrame:
    """The upsert in three batches, the first of them merged into blocks before the third comes."""
    rows, root = journal(t), shared_dir(t.spark, "canonical")
    merge = tables.canonical_deltas(root, TIES, fold_every=2, days_per_block=365)
    for batch_id, which in enumerate(("batch_id < 20", "batch_id >= 20 AND batch_id < 40", "batch_id >= 40")):
        merge(rows.filter(which), batch_id)
    return tables.canonical_rows(t.spark, root, TIES).select(*KEY_COLS)


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = journal(t)
    return tuple(latest.canonical_upsert(rows.filter(c), TIES).select(*KEY_COLS, "arrival", "arrival2") for c in ("batch_id < 32", "batch_id >= 32"))


_BEST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, stream, symbol, nat_key
    ORDER BY is_final DESC NULLS LAST, batch_id DESC NULLS LAST, seq DESC NULLS LAST, ts_ns DESC NULLS LAST,
             arrival DESC NULLS LAST, arrival2 DESC NULLS LAST, price DESC NULLS LAST, qty DESC NULLS LAST) AS rn
  FROM journal WHERE {which}) WHERE rn = 1"""
_ON = "s.provider = i.provider AND s.stream = i.stream AND s.symbol = i.symbol AND s.nat_key = i.nat_key"


@query("insert_new_keys", "journal", f"""
SELECT {', '.join('i.' + c for c in KEY_COLS)} FROM ({_BEST.format(which='batch_id >= 32')}) i
WHERE NOT EXISTS (SELECT 1 FROM ({_BEST.format(which='batch_id < 32')}) s WHERE {_ON})""")
def insert_new_keys(t: Tables) -> DataFrame:
    stored, incoming = _halves(t)
    return latest.insert_new_keys(stored, incoming).select(*KEY_COLS)


_WINS = "i.is_final OR (NOT s.is_final AND coalesce(i.seq, -1) >= coalesce(s.seq, -1) AND (NOT (i.seq IS NULL AND s.seq IS NULL) OR i.ts_ns >= s.ts_ns))"


@query("update_matching_keys", "journal", f"""
SELECT s.provider, s.stream, s.symbol, s.nat_key,
       {', '.join(f"CASE WHEN i.provider IS NOT NULL AND ({_WINS}) THEN i.{c} ELSE s.{c} END AS {c}" for c in KEY_COLS[4:])}
FROM ({_BEST.format(which='batch_id < 32')}) s LEFT JOIN ({_BEST.format(which='batch_id >= 32')}) i ON {_ON}""")
def update_matching_keys(t: Tables) -> DataFrame:
    stored, incoming = _halves(t)
    return latest.update_matching_keys(stored, incoming).select(*KEY_COLS)


@query("natural_key", "journal", "SELECT provider, stream, symbol, seq, ts_ns, nat_key FROM journal")
def natural_key(t: Tables) -> DataFrame:
    return journal(t).select("provider", "stream", "symbol", "seq", "ts_ns", "nat_key")


_PART = f"""
SELECT *, (row_number() OVER (PARTITION BY batch_id ORDER BY ts_ns, arrival, arrival2, price, qty) - 1) // 500 AS part_no FROM journal"""


@query("envelope_pack", "journal", f"""
SELECT batch_id, part_no, max(ts_ns) AS produced_at_ns, count(*) AS row_count, min(ts_ns) AS first_ts_ns,
       round(sum(price), 2) AS total_price FROM ({_PART}) GROUP BY batch_id, part_no""")
def envelope_pack(t: Tables) -> DataFrame:
    total = F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + F.get_json_object(r["payload"], "$.price").cast("double"))
    return batches.envelope_pack(journal(t), *TIES, rows_per_envelope=500).select(
        "batch_id", "part_no", "produced_at_ns", "row_count", F.col("rows")[0]["ts_ns"].alias("first_ts_ns"), F.round(total, 2).alias("total_price"))


@query("envelope_unpack", "journal", "SELECT batch_id, provider, stream, symbol, ts_ns, seq, is_final FROM journal")
def envelope_unpack(t: Tables) -> DataFrame:
    return batches.envelope_unpack(batches.envelope_pack(journal(t), *TIES)).drop("payload")


@query("batch_stats", "journal", """
SELECT batch_id, count(*) AS row_count, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM journal GROUP BY batch_id""")
def batch_stats(t: Tables) -> DataFrame:
    return batches.batch_stats(journal(t))


@query("max_batch_id", "journal", "SELECT max(batch_id) AS max_batch_id FROM journal")
def max_batch_id(t: Tables) -> DataFrame:
    return batches.max_batch_id(journal(t))


@query("distinct_batches_from", "journal", f"""
SELECT j.batch_id, j.provider, j.stream, j.symbol, j.ts_ns, j.seq, j.is_final, f.produced_at_ns FROM journal j
JOIN (SELECT batch_id, max(ts_ns) AS produced_at_ns FROM journal WHERE batch_id >= {START_BATCH} GROUP BY batch_id
      ORDER BY batch_id LIMIT {N_BATCHES}) f ON j.batch_id = f.batch_id""")
def distinct_batches_from(t: Tables) -> DataFrame:
    return batches.distinct_batches_from(journal(t), START_BATCH, N_BATCHES) \
        .select("batch_id", "provider", "stream", "symbol", "ts_ns", "seq", "is_final", "produced_at_ns")


@query("next_batches", "journal", f"""
SELECT batch_id, count(*) AS row_count FROM journal WHERE batch_id >= {START_BATCH} GROUP BY batch_id ORDER BY batch_id LIMIT {N_BATCHES}""")
def next_batches(t: Tables) -> DataFrame:
    return paging.next_batches(journal(t).groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count")), START_BATCH, N_BATCHES)


@query("retain_batches", "journal", f"""
SELECT batch_id, count(*) AS row_count FROM journal WHERE batch_id > {LAST_COMMITTED - SAFETY} GROUP BY batch_id""")
def retain_batches(t: Tables) -> DataFrame:
    kept = batches.retain_batches(journal(t), LAST_COMMITTED, SAFETY)
    return kept.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("pruned_count", "journal", f"SELECT count(*) AS deleted FROM journal WHERE batch_id <= {LAST_COMMITTED - SAFETY}")
def pruned_count(t: Tables) -> DataFrame:
    return batches.pruned_count(journal(t), LAST_COMMITTED, SAFETY)


_ROW_KEY = "concat_ws('|', provider, stream, symbol, CAST(nat_key AS VARCHAR))"


@query("keyset_page", "canonical", f"""
SELECT ts_ns, row_key, seq, is_final FROM (SELECT *, {_ROW_KEY} AS row_key FROM canonical WHERE stream IN ('a', 'r'))
WHERE ts_ns > {SINCE_NS} OR (ts_ns = {SINCE_NS} AND row_key > 'tpch|a|P5')
ORDER BY ts_ns, row_key LIMIT 2000""")
def keyset_page(t: Tables) -> DataFrame:
    key = F.concat_ws("|", "provider", "stream", "symbol", F.col("nat_key").cast("string"))
    rows = canonical(t).withColumn("row_key", key)
    return paging.keyset_page(rows, SINCE_NS, "row_key", "tpch|a|P5", page_rows=2000, streams=["a", "r"]).select("ts_ns", "row_key", "seq", "is_final")


@query("load_recent", "canonical", f"SELECT provider, stream, symbol, ts_ns, seq, is_final FROM canonical WHERE ts_ns >= {SINCE_NS} ORDER BY ts_ns")
def load_recent(t: Tables) -> DataFrame:
    return paging.load_recent(canonical(t), SINCE_NS, ["provider", "stream", "symbol", "ts_ns", "seq", "is_final"])


@query("filter_provider_stream", "journal", "SELECT provider, stream, symbol, ts_ns FROM journal WHERE provider = 'tpch' AND stream IN ('a', 'n')")
def filter_provider_stream(t: Tables) -> DataFrame:
    return filters.filter_provider_stream(journal(t), {"tpch", "other"}, {"a", "n"}).select("provider", "stream", "symbol", "ts_ns")


@query("replay_journal", "journal", f"SELECT provider, stream, symbol, ts_ns, seq, batch_id FROM journal WHERE stream = 'n' AND ts_ns >= {SINCE_NS}")
def replay_journal(t: Tables) -> DataFrame:
    return tables.replay_journal(journal(t), SINCE_NS, streams=["n"]).select("provider", "stream", "symbol", "ts_ns", "seq", "batch_id")


@query("replay_summary", "journal", f"SELECT count(*) AS rows, coalesce(max(ts_ns), 0) AS last_ts_ns FROM journal WHERE stream = 'n' AND ts_ns >= {SINCE_NS}")
def replay_summary(t: Tables) -> DataFrame:
    return tables.replay_summary(replay_journal(t))


_WATERMARKS = "SELECT concat(provider, '.', stream) AS scope, ts_ns AS last_offset, arrival * 10 + coalesce(seq, 7) AS seqcol FROM journal"


@query("named_watermarks", "journal", f"""
SELECT scope, last_offset FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seqcol DESC, last_offset DESC) AS rn FROM ({_WATERMARKS})) WHERE rn = 1""")
def named_watermarks(t: Tables) -> DataFrame:
    history = journal(t).select(F.concat_ws(".", "provider", "stream").alias("scope"), F.col("ts_ns").alias("last_offset"),
                                F.struct((F.col("arrival") * 10 + F.coalesce("seq", F.lit(7))).alias("a"), F.col("ts_ns").alias("b")).alias("seqcol"))
    return batches.named_watermarks(history)


@query("payload_fields", "journal", """
SELECT provider, stream, symbol, ts_ns, CASE WHEN seq IS NULL THEN NULL ELSE qty END AS qty,
       CASE WHEN seq IS NULL THEN NULL ELSE price END AS price,
       CASE WHEN seq IS NULL THEN 'qty=' || CAST(CAST(qty AS BIGINT) AS VARCHAR) END AS raw FROM journal""")
def payload_fields(t: Tables) -> DataFrame:
    """Payload text to columns; rows without a sequence id carry malformed text."""
    text = F.when(F.col("seq").isNull(), F.concat(F.lit("qty="), F.col("qty").cast("bigint").cast("string"))).otherwise(F.col("payload"))
    p = F.from_json(payload_or_raw(text), "qty DOUBLE, price DOUBLE, raw STRING")
    return journal(t).withColumn("p", p).select("provider", "stream", "symbol", "ts_ns", "p.qty", "p.price", "p.raw")


@query("journal_append", "journal", """
SELECT provider, stream, symbol, ts_ns, seq, is_final, batch_id FROM journal""")
def journal_append(t: Tables) -> DataFrame:
    """Ticks written to the journal twice: the second time replaces the first."""
    root = shared_dir(t.spark, "journal")
    rows = journal(t).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload", "batch_id")
    for _ in range(2):
        tables.write_journal(rows, root)
    return t.spark.read.parquet(root).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("compact_partitions", "journal", """
SELECT provider, stream, CAST(date_trunc('month', ts) AS DATE) AS date, symbol, ts_ns, seq, is_final, batch_id FROM journal""")
def compact_partitions(t: Tables) -> DataFrame:
    """Ticks by month written in two appends, of which some months get but one; then the others are compacted."""
    root = shared_dir(t.spark, "ticks")
    rows = journal(t).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload", "batch_id")
    for which in ("batch_id < 32", "batch_id >= 32"):
        tables.write_ticks(rows.filter(which), root, unit="month")
    tables.compact_partitions(t.spark, root)
    return t.spark.read.parquet(root).select("provider", "stream", "date", "symbol", "ts_ns", "seq", "is_final", "batch_id")


@query("journal_and_canonical", "journal", """, fed AS (
  SELECT CASE WHEN arrival % 7 = 0 THEN NULL ELSE provider END AS provider, stream, symbol, nat_key, ts_ns, seq, is_final, arrival % 3 AS batch_id, price, qty FROM journal)
SELECT 'canonical' AS table_name, * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, stream, symbol, nat_key
    ORDER BY is_final DESC NULLS LAST, batch_id DESC NULLS LAST, seq DESC NULLS LAST, ts_ns DESC NULLS LAST, price DESC NULLS LAST, qty DESC NULLS LAST) AS rn FROM fed) WHERE rn = 1
UNION ALL SELECT 'journal', * FROM fed""")
def journal_and_canonical(t: Tables) -> DataFrame:
    """Three batches, the middle one fed twice, some ticks without a provider: the rows of both tables."""
    hot, canonical = shared_dir(t.spark, "hot"), shared_dir(t.spark, "canonical")
    write = tables.journal_and_canonical(hot, canonical, ["price", "qty"], days_per_block=365)
    ticks = journal(t).select(F.when(F.col("arrival") % 7 != 0, F.col("provider")).alias("provider"), "stream", "symbol", "ts_ns", "seq", "is_final",
                              "price", "qty", (F.col("arrival") % 3).alias("batch_id"))
    for batch in (0, 1, 1, 2):
        write(ticks.filter(F.col("batch_id") == batch), batch)
    columns = ["provider", "stream", "symbol", "nat_key", "ts_ns", "seq", "is_final", "batch_id", "price", "qty"]
    stored = latest.with_natural_key(t.spark.read.parquet(hot)).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return tables.canonical_rows(t.spark, canonical, ["price", "qty"]).select(F.lit("canonical").alias("table_name"), *columns) \
        .unionByName(stored.select(F.lit("journal").alias("table_name"), *columns))


@query("prune_batches", "journal", """
SELECT (SELECT count(*) FROM journal WHERE batch_id <= 43) AS deleted, batch_id, symbol, ts_ns, seq FROM journal WHERE batch_id > 43""")
def prune_batches(t: Tables) -> DataFrame:
    """A stored journal without its old folders, and how many rows went."""
    root = shared_dir(t.spark, "pruned")
    tables.write_journal(journal(t).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload", "batch_id"), root)
    deleted = tables.prune_batches(t.spark, root, 63, 20)
    return t.spark.read.parquet(root).select(F.lit(deleted).cast("bigint").alias("deleted"), F.col("batch_id").cast("bigint").alias("batch_id"), "symbol", "ts_ns", "seq")


@query("set_watermark", "journal", """
SELECT concat(provider, '.', stream) AS scope, max(ts_ns) AS last_offset FROM journal GROUP BY 1""")
def set_watermark(t: Tables) -> DataFrame:
    """Cursors moved to where each stream stands, by way of an earlier position, and read back."""
    path = shared_dir(t.spark, "named")
    last = journal(t).groupBy(F.concat_ws(".", "provider", "stream").alias("scope")).agg(F.max("ts_ns").alias("last_offset"))
    batches.set_watermarks(last.withColumn("last_offset", F.col("last_offset") - 1), path, 1)
    for _ in range(2):
        batches.set_watermarks(last, path, 2)
    return batches.named_watermarks(t.spark.read.parquet(path))


@query("prune_by_cursors", "journal", """
SELECT (SELECT count(*) FROM journal WHERE batch_id <= 20) AS deleted, batch_id, symbol, ts_ns, seq FROM journal WHERE batch_id > 20""")
def prune_by_cursors(t: Tables) -> DataFrame:
    """Two consumers of a stored journal, one of them behind: only what both have read goes, but for the last 20 batches."""
    root, cursors = shared_dir(t.spark, "pruned"), shared_dir(t.spark, "cursors")
    tables.write_journal(journal(t).select("provider", "stream", "symbol", "ts_ns", "seq", "is_final", "payload", "batch_id"), root)
    stored = t.spark.read.parquet(root)
    for consumer, steps in {"tables": (20, 40), "journal": (30, 63)}.items():
        write = tables.cursor_writer(lambda rows, batch_id: None, consumer, cursors)
        for batch_id, (low, high) in enumerate(zip((-1, *steps), steps)):
            write(stored.filter((F.col("batch_id") > low) & (F.col("batch_id") <= high)), batch_id)
    deleted = tables.prune_by_cursors(t.spark, root, t.spark.read.parquet(cursors), ["tables", "journal"], 20)
    return t.spark.read.parquet(root).select(F.lit(deleted).cast("bigint").alias("deleted"), F.col("batch_id").cast("bigint").alias("batch_id"), "symbol", "ts_ns", "seq")
