"""Exact top-k inner products by MaxScore over postings of signed components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickbars.llm.common import stored, whole_groups

SCALE = 256
TOP = 5
#: Queries in a block and candidates in a shard: what one task holds.
BLOCK_QUERIES = 2048
SHARD_ROWS = 16384
#: Strongest rows of a posting list whose scores start the threshold.
HEADS = 8
#: Components probed between two looks at the threshold.
PROBED_TOGETHER = 8


class Shard:
    """Postings of the components of a shard, one list per dimension and sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.rows, self.weights, self.heads = {}, {}, {}
        self.most = np.zeros((2, vectors.shape[1]), dtype=vectors.dtype)
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            for side, values in enumerate((column, -column)):
                rows = np.flatnonzero(values > 0)
                if len(rows):
                    w = values[rows]
                    self.rows[side, d], self.weights[side, d], self.most[side, d] = rows, w, w.max()
                    self.heads[side, d] = rows[np.argsort(-w, kind="stable")[:HEADS]]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best, ties to the smaller id, without the query's own id."""
        side = (query < 0).astype(int)
        bound = np.abs(query) * self.most[side, np.arange(len(query))]
        terms = np.flatnonzero(bound > 0)
        terms = terms[np.argsort(bound[terms], kind="stable")]
        seeds = [self.heads[side[d], d] for d in terms[-16:]]
        seeds = np.unique(np.concatenate(seeds)) if seeds else np.array([], dtype=int)
        seeds = seeds[self.ids[seeds] != own]
        least = None
        if len(seeds) >= k:
            least = np.sort(self.vectors[seeds] @ query)[-k]
        if least is None or least <= 0:
            rows = np.flatnonzero(self.ids != own)  # a row without any posting may be among the best
            score = self.vectors[rows] @ query
        else:
            # Terms that together stay below the threshold are not essential: a row with no other cannot be among the best.
            first = int(np.searchsorted(np.cumsum(bound[terms]), least, side="left"))
            essential, others = terms[first:], terms[:first][::-1]
            score = np.zeros(len(self.ids), dtype=self.vectors.dtype)
            for d in essential:
                score[self.rows[side[d], d]] += abs(query[d]) * self.weights[side[d], d]
            open_ = bound[others].sum()
            rows = np.flatnonzero((score > 0) & (score + open_ >= least))
            rows = rows[self.ids[rows] != own]
            # What the essential components take away, then the others while a row can still reach the threshold.
            score = self.vectors[np.ix_(rows, essential)] @ query[essential]
            for at in range(0, len(others) + 1, PROBED_TOGETHER):
                stay = score + open_ >= least
                rows, score = rows[stay], score[stay]
                part = others[at:at + PROBED_TOGETHER]
                if len(part):
                    score = score + self.vectors[np.ix_(rows, part)] @ query[part]
                    open_ -= bound[part].sum()
            # Components of sides on which no row of the shard has a weight can only take away.
            rest = np.setdiff1d(np.flatnonzero(query), terms)
            if len(rest):
                score = score + self.vectors[np.ix_(rows, rest)] @ query[rest]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return rows[best], score[best]


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, v in enumerate(lists.to_pylist()):
        out[i, :len(v)] = v
    return out


def _search_cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in whole_groups(batches, ["cell"]):
            for at, end in zip(borders, borders[1:]):
                part = rows.slice(at, end - at)
                asks = part["asks"].to_numpy()
                width = max((len(v) for v in part["v"].to_pylist()), default=0)
                v, ids = _matrix(part["v"], width), part["vec_id"].to_numpy()
                most = int(np.abs(v.astype(object)).max(initial=0)) if v.size else 0
                # Sums of whole numbers below 2**53 are exact in doubles; others are added as Python integers.
                v = v.astype(np.float64 if width * most * most < 2**53 else object)
                shard = Shard(ids[~asks], v[~asks])
                out = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
                for q in np.flatnonzero(asks):
                    found, score = shard.search(v[q], ids[q], k)
                    out["query_id"] += [ids[q]] * len(found)
                    out["query_key"] += [part["key"][int(q)].as_py()] * len(found)
                    out["vec_id"] += shard.ids[found].tolist()
                    out["score"] += [max(-2**63, min(2**63 - 1, int(s))) for s in score]
                yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in out.items()})
    return run


def top_k(vectors: DataFrame, every: int, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the ``k`` largest inner
    products of floor(scale * component) over all other rows, ties to the smaller id.

    Null vectors, those with a null or non-finite component and rows without id take no part. Vectors of unequal
    length compare as if the shorter went on with zeros; equal query rows (id and vector) are asked once, and equal
    candidate rows each count. Queries meet candidates in blocks: a cell holds a block of queries and a shard of
    candidates, of bounded size both, and the shards' best are merged by rank.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).withColumn("key", F.xxhash64("v")))
    asked = F.col("vec_id") % every == 0
    n, asks = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asks // BLOCK_QUERIES))
    hashed = F.xxhash64("vec_id", "key")
    shard, block = F.pmod(hashed, F.lit(shards)), F.pmod(hashed, F.lit(blocks))
    queries = rows.filter(asked).dropDuplicates(["vec_id", "key"]).withColumn("asks", F.lit(True)).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s * blocks + block)))
    candidates = rows.withColumn("asks", F.lit(False)).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: shard * blocks + b)))
    cells = queries.unionByName(candidates).withColumn("cell", F.col("cell").cast("long"))
    found = cells.repartition(F.col("cell")).sortWithinPartitions("cell", "asks", "vec_id").mapInArrow(
        _search_cells(k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
