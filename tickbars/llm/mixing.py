"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickbars.llm.common import WORD, stored, text_key, whole_groups

#: Weights of the sources in code point order (null last), over and over.
WEIGHTS = (1, 2, 3)
#: No source is taken more than so many times.
MOST_TIMES = 3
#: Documents that one flight balances, and groups whose rests meet in the next.
BLOCK_ROWS = 4096
BLOCKS_TOGETHER = 512
#: So many documents of a source, spread over its sizes, wait for the landing, which tries all outcomes.
LANDING = 12


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """``source, source_size, n, target`` per source of rows ``(source, size)``.

    Targets share the sum of all sizes by weight, none above ``most`` times its source: with sources in the order
    of limit over weight, those before the level get their limit and the others share the rest. That is what
    repeated re-sharing of the excess comes to. The windows see one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    limit = F.col("source_size") * F.lit(float(most))
    per = per.withColumn("weight", weight).withColumn("limit", limit)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # The level at the first source that stays below its limit holds for it and all after it.
    below = F.when(F.col("limit") > F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))
    shared = F.min(below).over(everything)["level"]
    target = F.least("limit", F.coalesce(F.col("weight") * shared, F.col("limit")))
    return per.select("source", "source_size", "n", target.alias("target"))


class _Unit:
    __slots__ = ("row", "x", "c", "p")

    def __init__(self, row: int, x: float, c: float, p: float) -> None:
        self.row, self.x, self.c, self.p = row, x, c, p


def _move(units: list[_Unit], u: list[float], rng: random.Random) -> None:
    """A random step along ``u`` in either direction to where the first probability is 0 or 1; expectations stay."""
    up = min([(1 - t.p) / d if d > 0 else -t.p / d for t, d in zip(units, u) if d], default=0.0)
    down = min([t.p / d if d > 0 else (t.p - 1) / d for t, d in zip(units, u) if d], default=0.0)
    step = up if rng.random() * (up + down) < down else -down
    for t, d in zip(units, u):
        t.p = min(1.0, max(0.0, t.p + step * d))
        if t.p < 1e-9:
            t.p = 0.0
        elif t.p > 1 - 1e-9:
            t.p = 1.0


def flight(units: list[_Unit], rng: random.Random) -> list[_Unit]:
    """Moves probabilities, three units at a time, along the null space of (tokens, documents); both totals stay.

    Returns the units still undecided, two at most.
    """
    pool, waiting = [], iter(units)
    while True:
        pool = [t for t in pool if 0 < t.p < 1]
        pool += itertools.islice(waiting, 3 - len(pool))
        if len(pool) < 3:
            return pool
        a, b, c = pool
        u = [b.x * c.c - c.x * b.c, c.x * a.c - a.x * c.c, a.x * b.c - b.x * a.c]
        if not any(u):  # one size for all: two of them are enough
            u = [b.c, -a.c, 0.0] if a.c and b.c else [1.0, 0.0, 0.0]
        big = max(map(abs, u))
        _move(pool, [v / big for v in u], rng)


def land(units: list[_Unit]) -> None:
    """Decides the last units: of all outcomes the one nearest in tokens, then in documents."""
    if not units:
        return
    x, c, p = (np.array([getattr(t, k) for t in units]) for k in ("x", "c", "p"))
    outcomes = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    off = np.abs(outcomes @ x - x @ p)
    docs = np.abs(outcomes @ c - c @ p)
    best = outcomes[np.lexsort((docs, np.round(off, 6)))[0]]
    for t, d in zip(units, best):
        t.p = float(d)


def _flights(last: bool):
    """Flights over sorted rows ``(part, unit, size, copies, p)``; the last one lands as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in whole_groups(batches, ["part"]):
            part, size, copies = (rows[k].to_numpy() for k in ("part", "size", "copies"))
            p = rows["p"].to_numpy().copy()
            for at, end in zip(borders, borders[1:]):
                units = [_Unit(i, float(size[i] * copies[i]), float(copies[i]), float(p[i])) for i in range(at, end)]
                rng, open_ = random.Random(int(part[at])), [t for t in units if 0 < t.p < 1]
                if last:
                    open_.sort(key=lambda t: (t.x, t.row))
                    held = {len(open_) * (2 * k + 1) // (2 * LANDING) for k in range(LANDING)} if open_ else set()
                    waiting = [t for i, t in enumerate(open_) if i not in held]
                    land(flight(waiting, rng) + [open_[i] for i in sorted(held)])
                else:
                    flight(open_, rng)
                for t in units:
                    p[t.row] = t.p
            out = rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))
            yield from out.to_batches()
    return run


def times_taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """Per distinct ``(doc_id, source, text_key)``: ``size, source_size, target, times``.

    ``times`` is how often the document is taken: the whole part of target / source_size, and once more for a
    sample of the documents of the source. The sample is balanced: flights in blocks of documents keep both the
    tokens and the documents of each source, what they leave undecided meets in fewer blocks, and the last
    handful per source is landed on the nearest token total. A source of any size is spread over blocks. Equal
    rows (same id, source and text) share one decision. Seeds come from the source and block, so reruns agree.
    """
    sized = stored(docs.select("doc_id", "source", text_key().alias("text_key"), word_count().alias("size")))
    targets = stored(source_targets(sized, weights, most))
    units = sized.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("copies"))
    units = units.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        units.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("blocks")))
        .drop("n")
    )
    blocks = targets.agg(F.max(F.ceil(F.col("n") / F.lit(BLOCK_ROWS)))).first()[0] or 1
    decided = None
    while True:
        last = blocks <= 1
        part = F.xxhash64("source", F.col("source").isNull(), "block")
        rows = units.withColumn("part", part).repartition("part").sortWithinPartitions("part", F.xxhash64("doc_id", "text_key"), "doc_id", "text_key")
        flown = stored(rows.mapInArrow(_flights(last), rows.schema))
        done = flown.filter("p = 0 or p = 1")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        units = flown.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / F.lit(BLOCKS_TOGETHER))).drop("part")
        blocks = -(-blocks // BLOCKS_TOGETHER)
    return decided.select("doc_id", "source", "text_key", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("times"))


def _decided(docs: DataFrame, times: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` with columns of their decisions, named with two underscores in front."""
    own = times.select(*[F.col(c).alias(f"__{c}") for c in ["doc_id", "source", "text_key", *columns]])
    same = (F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("__own_key") == F.col("__text_key")))
    return docs.withColumn("__own_key", text_key()).join(own, same)


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """One row per document row: ``doc_id, size, source_size, target, taken`` (words, repeats counted), ``times``."""
    rows = _decided(docs.select("doc_id", "source", "text"), times_taken(docs, weights, most), ["size", "source_size", "target", "times"])
    taken = F.col("__size") * F.col("__times")
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                       F.col("__target").alias("target"), taken.alias("taken"), F.col("__times").alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it had."""
    rows = _decided(docs, times_taken(docs, weights, most).filter("times > 0"), ["times"])
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)
