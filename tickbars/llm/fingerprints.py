"""I-Match document fingerprints over a band of inverse document frequencies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms are told apart by so many bits of their hash; the lexicon is a bitmap of that many bits (2 MB).
TERM_BITS = 24
#: Band of the inverse document frequency, as shares of its largest value, ln(documents).
BAND = (0.25, 0.92)
#: Lexicon subsets: so many of each share, and the shares 1, 1/2, 1/4, ...
SUBSETS = 12
SHARES = 12
#: Subsets that the likeness of two fingerprints looks at, the sparsest with a term first.
COMPARED = 24
_SEED = 7
#: A term is in a subset if its draw lies below the limit of its share.
_LIMITS = np.array([1 << 64 - level for level in range(1, SHARES)], dtype=np.uint64)
_SALTS = np.array([[(j + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1] for j in range(SUBSETS)], dtype=np.uint64)
#: Text that one range of documents holds, about, and the most ranges.
RANGE_BYTES = 32 << 20
MOST_RANGES = 10_000


def terms(text: str) -> np.ndarray:
    """Distinct terms of a text, as hashes: its lower-cased words."""
    return np.array([xxhash.xxh3_64_intdigest(w, _SEED) for w in {*text.lower().split()}], dtype=np.uint64)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes from hashes: multiply and shift, with a wrap."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def subset_hashes(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit hash per lexicon subset, of the distinct terms in it; 0 where none is.

    Subset j holds the terms whose j-th hash lies below its share: random, but the same for all documents. Sorted
    by that hash, the terms of each share come first, so one running sum of their hashes has those of all shares.
    """
    if not len(hashes):
        return np.zeros(SUBSETS * SHARES, dtype=np.uint16)
    with np.errstate(over="ignore"):
        draws = np.sort(_mixed(hashes ^ _SALTS, 1), axis=1)
        sums = np.cumsum(_mixed(draws, 2), axis=1)
    n = np.concatenate([np.full((1, SUBSETS), len(hashes)), *[np.count_nonzero(draws < limit, axis=1)[None] for limit in _LIMITS]])
    found = _mixed(sums[np.arange(SUBSETS), np.maximum(n, 1) - 1], 3) % np.uint64(65535) + np.uint64(1)
    return np.where(n > 0, found, np.uint64(0)).astype(np.uint16).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the ``COMPARED`` sparsest subsets in which either has a term.

    A subset with one term of the two documents matches with the share of terms they have in common, so sparse
    subsets tell how alike they are at any length. 1 for equal fingerprints, also where no subset has a term.
    """
    if np.array_equal(a, b):
        return 1.0
    some = np.flatnonzero((a > 0) | (b > 0))[::-1][:COMPARED]
    return float((a[some] == b[some]).mean()) if len(some) else 0.0


def _hex(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


# Lexicon -----------------------------------------------------------------------------------------


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> bytes:
    """Bitmap of the terms whose document frequency lies in the band, over all documents.

    Each task counts its documents per term; the counts meet by term. The bitmap has 2 ** TERM_BITS bits however
    many terms there are: terms that share a place count as one.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << TERM_BITS, dtype=np.int32)
        for b in batches:
            for t in b["text"].to_pylist():
                seen[np.unique(_places(terms(t or "")))] += 1
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 1 << 16):
            part = found[at:at + (1 << 16)]
            yield pa.record_batch({"place": part.astype(np.int32), "c": seen[part].astype(np.int64)})

    n = docs.count()
    high, low = n ** (1 - band[0]), n ** (1 - band[1])  # idf = ln(n / df) within the band
    counts = docs.select("text").mapInArrow(count, "place int, c long").groupBy("place").agg(F.sum("c").alias("df"))
    inside = counts.filter((F.col("df") >= low) & (F.col("df") <= high))
    maps = inside.groupBy(F.bitmap_bucket_number(F.col("place") + F.lit(1)).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + F.lit(1))).alias("bits"))
    out = np.zeros((1 << TERM_BITS) // 8, dtype=np.uint8)
    for b, bits in maps.collect():  # at most 512 rows of 4 KB
        out[(b - 1) * 4096:b * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out.tobytes()


def in_lexicon(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The terms of a document that the lexicon has; all of them, if it has none."""
    places = _places(hashes)
    kept = hashes[(bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1]
    return kept if len(kept) else hashes


# Documents and their edited texts ------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text)`` in ranges of doc_id, as ``range, tail, doc_id, text`` in descending order within each.

    The rows with the first id of a range also come, as its tail, to the range before it, and those of the first
    range to the last. Only the borders and the first id of each range are held by the driver.
    """
    size, bytes_ = rows.agg(F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    n = max(1, min(MOST_RANGES, -(-int(bytes_ or 0) // RANGE_BYTES)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 and size else []
    borders = np.unique(np.array(cuts, dtype=np.int64))

    def range_of(ids: pd.Series) -> np.ndarray:
        return np.where(ids.isna(), -1, np.searchsorted(borders, ids.fillna(0).to_numpy(dtype=np.int64), side="right"))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids))

    firsts = dict(map(tuple, rows.select(F.col("doc_id").alias("d"), place(F.col("doc_id").cast("long")).alias("r")).groupBy("r").agg(F.max("d")).collect()))
    ranges = sorted(firsts, reverse=True)
    before = dict(zip(ranges, ranges[-1:] + ranges[:-1]))

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        return pd.Series([[r, before[r]] if r < 0 or d == firsts[r] else [r] for r, d in zip(range_of(ids).tolist(), ids)])

    placed = rows.select("doc_id", "text", F.posexplode(places(F.col("doc_id").cast("long"))).alias("tail", "range"))
    return placed.select("range", "tail", "doc_id", "text").repartition("range").sortWithinPartitions(
        "range", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per document row.

    The next document is the one that follows in descending doc_id (null last, equal ids by text), and the first
    for the last; a lone document follows itself. Null texts count as empty. A text without a term of the band is
    fingerprinted by all its terms; one without any term has a fingerprint of zeros. Equal texts have equal
    fingerprints. Rows are dealt by ranges of doc_id, and each range is walked in order with one row held.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(lexicon(rows, band))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def own(text: str) -> np.ndarray:
        return subset_hashes(in_lexicon(terms(text), np.frombuffer(words.value, dtype=np.uint8)))

    def result(doc_id, text: str, mine: np.ndarray, other: str, theirs: np.ndarray) -> tuple:
        changed = edited(text, other)
        new = own(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), _hex(mine), _hex(new), likeness(mine, new), likeness(mine, theirs)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next has not come yet; the first tail row is that of the last row of a range
        for b in batches:
            out = []
            for r, tail, doc_id, text in zip(*[b[c].to_pylist() for c in ("range", "tail", "doc_id", "text")]):
                if tail and held is None:
                    continue
                mine = own(text)
                if held is not None:
                    out.append(result(*held, text, mine))
                held = None if tail else (doc_id, text, mine)
            if out:
                yield pa.record_batch([pa.array(c, b["doc_id"].type if i == 0 else None) for i, c in enumerate(zip(*out))], names=fields)

    return _in_ranges(rows).mapInArrow(walk, schema)
