"""What several operators share: words, stored intermediates, bucket links and connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.session import shared_dir

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder: later steps read them, and lost executors do not matter."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "llm"))
    return df.checkpoint()


def text_key(text: Column | str = "text") -> Column:
    """Tells rows of one ``doc_id`` apart by their text; equal rows have equal keys."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def majority(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """Per bit whether it is set in over half of the rows. ``hashes``: (n, bits / 64) unsigned words."""
    counts = np.zeros(bits, dtype=np.int64)
    rows = np.ascontiguousarray(hashes, dtype="<u8").reshape(len(hashes), -1)
    for at in range(0, len(rows), 1 << 15):
        part = rows[at:at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows), bitorder="little").view("<u8")


# Buckets ---------------------------------------------------------------------------------------


def split_buckets(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``(key, id, ...)`` that share a key with others, as groups ``(key, pair)`` of about ``2 * size`` at most.

    A larger bucket is cut into parts by a hash of the id, and each pair of parts becomes a group, so any two rows
    of a key meet in some group and no group is unbounded. Rows come sorted by group and id.
    """
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    meets = F.expr("transform(sequence(0, parts - 1), x -> least(x, part) * parts + greatest(x, part))")
    return (
        rows.join(crowded, "key").withColumn("parts", parts).withColumn("part", own)
        .withColumn("pair", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(meets)))
        .drop("n", "parts", "part")
        .repartition("key", "pair").sortWithinPartitions("key", "pair", "id")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of complete groups, with the borders of the groups."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        change = np.zeros(now.num_rows - 1, dtype=bool)
        for k in keys:
            v = now[k].to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.flatnonzero(change) + 1
        if not len(starts):
            rest = now
            continue
        yield now.slice(0, starts[-1]), np.r_[0, starts]
        rest = now.slice(starts[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def spanning_links(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what ``near`` connects among ``n`` rows: at most ``n - 1``, never all pairs.

    ``near(i, js)`` says which rows ``js`` link to row ``i``; rows already in i's group are not asked again.
    """
    label, links = np.arange(n), []
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        if not len(others):
            continue
        for j in others[near(i, others)]:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


# Connected groups ------------------------------------------------------------------------------


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of links ``(a, b)``: the smallest node it is connected to.

    Alternates large-star and small-star steps, each a few shuffles of the links; nothing comes to the driver
    but a count and a checksum per round.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known or not state[0]:
            break
        known = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
