"""Ordered scans over a stream: gap monitoring and quote state, batch by batch.

Each batch runs the parallel scan of ``operators.ordered`` and picks up where the last one ended
from a table of one row per key. A hot key is spread over tasks like any other, which a stateful
operator keyed by symbol could not do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.operators.gaps import highest_seen, seq_gaps_arrival
from tickbars.operators.quotes import FIELDS, last_state, material_quotes, quote_state
from tickbars.streaming.state import BatchFn, Versions


def gap_monitor(out: str, state: str, *, key: str = "symbol", seq: str = "seq", arrival: str = "arrival",
                discovered: Column | None = None, lookback_ids: int = 0) -> BatchFn:
    """A ``foreachBatch`` function that writes the gaps each batch shows."""
    cursors = Versions(state)
    found = F.col("ts_ns") if discovered is None else discovered

    def run(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        seen = cursors.before(rows.sparkSession, batch_id)
        gaps = seq_gaps_arrival(rows, key, seq, arrival, found, seen_before=seen, lookback_ids=lookback_ids)
        gaps.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        cursors.write(highest_seen(rows, key, seq, seen), batch_id)
        rows.unpersist()
    return run


def quote_scan(out: str, state: str, *, key: str = "sub_key", arrival: str = "arrival", ties: tuple[str, ...] = (),
               arrival_ns: Column | None = None) -> BatchFn:
    """A ``foreachBatch`` function that writes merged, material quotes."""
    states = Versions(state)

    def run(updates: DataFrame, batch_id: int) -> None:
        updates = updates.persist()
        fields = tuple(f for f in FIELDS if f in updates.columns)
        stored = states.before(updates.sparkSession, batch_id)
        merged = quote_state(updates, key, arrival, ties=ties, fields=fields, stored=stored, arrival_ns=arrival_ns)
        material_quotes(merged).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        states.write(last_state(updates, key, arrival, fields, stored, ties), batch_id)
        updates.unpersist()
    return run
