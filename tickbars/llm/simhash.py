"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickbars.llm.common import components, majority, popcount, spanning_links, split_buckets, stored, text_key, whole_groups

BITS = 64
WORDS_PER_SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 2
#: Rows of a bucket that one task compares with as many others.
BUCKET_ROWS = 4096


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < WORDS_PER_SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, joined, ends, at = xxhash.xxh64_intdigest, b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = itertools.chain((0,), (e + 1 for e in ends))
        hashes = [digest(joined[a:e], SEED) for a, e in zip(starts, ends[WORDS_PER_SHINGLE - 1:])]
    return int(majority(np.array(hashes, dtype="<u8")).view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(fingerprint).astype("int64")


# Partitions of the bits and their thresholds -----------------------------------------------------


def bit_pairs(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set, over all of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), dtype=np.int64)
        rows = 0
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            both += (bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
            rows += len(bits)
        yield pa.record_batch({"pos": np.arange(BITS * BITS + 1), "c": np.r_[both.ravel(), rows]})

    counts = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for pos, c in prints.select("fp").mapInArrow(count, "pos long, c long").groupBy("pos").agg(F.sum("c")).collect():
        counts[pos] = c
    return int(counts[-1]), counts[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` partitions of like size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(like, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        room = (BITS - sum(map(len, groups))) // (m - k)
        own = [max(left, key=lambda b: (like[b, sorted(left)].sum(), -b))]
        left -= {*own}
        while len(own) < room:
            best = max(left, key=lambda b: (like[b, own].sum(), -b))
            own.append(best)
            left.discard(best)
        groups.append(sorted(own))
    return groups


def _value(bits: list[int], clear: tuple[int, ...] = ()):
    """The bits of a partition as a mask of the fingerprint, without some of them."""
    mask = sum(1 << b for b in bits if b not in clear)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 at the least total cost, by dynamic programming.

    ``costs[i][t + 1]`` is the cost of partition i at threshold t. Two fingerprints within ``distance`` then
    are within t_i in some partition i: else they would differ in sum(t_i + 1) bits at least.
    """
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (distance + 1)
    for own in costs:
        nxt: list[tuple[float, list[int]] | None] = [None] * (distance + 2)
        for used, at in enumerate(best):
            for more in range(distance + 2 - used) if at else ():
                total = at[0] + own[more]
                if nxt[used + more] is None or total < nxt[used + more][0]:
                    nxt[used + more] = (total, at[1] + [more - 1])
        best = nxt
    return best[-1][1]


def plan_probes(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds, at the least estimated number of probes and candidates.

    Two and three partitions are weighed. Candidates at threshold 0 are counted over all fingerprints; those at
    more follow from the share of fingerprints that agree in each bit.
    """
    n, both = bit_pairs(prints)
    agree = 1 - 2 * (p := np.diag(both) / max(n, 1)) * (1 - p)
    odds = (1 - agree) / agree
    layouts = [group_bits(n, both, m) for m in range(2, distance + 2)]
    flat = [bits for layout in layouts for bits in layout]
    values = F.array(*[F.struct(F.lit(i).alias("i"), _value(bits).alias("v")) for i, bits in enumerate(flat)])
    same = (
        prints.select(F.explode(values).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    )
    pairs = dict(map(tuple, same))
    plans = []
    for layout in layouts:
        costs = []
        for bits in layout:
            one = odds[bits].sum()
            two = (one**2 - (odds[bits] ** 2).sum()) / 2
            w, c = len(bits), pairs.get(flat.index(bits), 0.0)
            # At threshold t a pair meets once for each mask that covers where it differs.
            costs.append([0.0, n + c, n * w + c * (w + one), n * w * (w - 1) / 2 + c * (w * (w - 1) / 2 + (w - 1) * one + two)])
        chosen = allocate([c[:distance + 2] for c in costs], distance)
        plans.append((sum(c[t + 1] for c, t in zip(costs, chosen)), [(b, t) for b, t in zip(layout, chosen) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def probe_keys(plan: list[tuple[list[int], int]]):
    """Array of bucket keys: fingerprints within t bits in a partition share the key of some mask of t bits."""
    keys = []
    for i, (bits, t) in enumerate(plan):
        for k, clear in enumerate(itertools.combinations(bits, t)):
            keys.append(F.xxhash64(F.lit(i), F.lit(k), _value(bits, clear)))
    return F.array(*keys)


def _verified(distance: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in whole_groups(batches, ["key", "pair"]):
            x = rows["id"].to_numpy().view(np.uint64)
            starts, sizes = borders[:-1], np.diff(borders)
            two = starts[sizes == 2]
            two = two[popcount(x[two] ^ x[two + 1]) <= distance]
            found = [(two, two + 1)]
            for at, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                own = x[at:at + size]
                near = spanning_links(size, lambda i, js: popcount(own[js] ^ own[i]) <= distance)
                found.append((at + np.array([i for i, _ in near], dtype=int), at + np.array([j for _, j in near], dtype=int)))
            a, b = (x[np.concatenate(side)].view(np.int64) for side in zip(*found))
            yield pa.record_batch({"a": a, "b": b})
    return links


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all that are within ``distance`` bits.

    Each bucket gives links that span its connected fingerprints, not all of its pairs.
    """
    rows = prints.select(F.col("fp").alias("id"), F.explode(probe_keys(plan_probes(prints, distance))).alias("key"))
    return split_buckets(rows, BUCKET_ROWS).mapInArrow(_verified(distance), "a long, b long")


def near_duplicate_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document row: ``doc_id, text_key, fp, root, component_id``.

    ``fp`` is the fingerprint of the whole text; documents of one connected group share ``root`` (a fingerprint)
    and ``component_id``, their smallest doc_id. Fingerprints are compared once each, however many documents have
    them. Null and empty texts have fingerprint 0 and link like any other; rows with a null doc_id take part and
    have a group, whose component_id is null if it has no other document. Repeated rows stay.
    """
    own = stored(docs.select("doc_id", text_key().alias("text_key"), fingerprints("text").alias("fp")))
    prints = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(prints, distance))
    linked = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    linked = stored(linked)
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(linked.drop("least"), "fp").join(smallest, "root").select("doc_id", "text_key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (null last), then the smallest text key.

    Columns stay as they are. Of repeated rows of the kept document one stays.
    """
    groups = near_duplicate_groups(docs, distance)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = groups.groupBy("root").agg(F.min(first).alias("first")).select(
        F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key"))
    rows = docs.withColumn("__own", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
