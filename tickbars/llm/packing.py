"""Packing documents into token sequences of balanced attention cost."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Tokens that are packed together: bounds memory, not the documents.
WINDOW_TOKENS = 1 << 22
#: Cost of a piece of n tokens: n for what is linear in length, n * n / QUADRATIC_AT for attention.
QUADRATIC_AT = 1024


@functools.cache
def encoding(vocabulary: str):
    """The vocabulary of ``byte_bpe_50k.json`` in the form of ranks, which gives the same ids sooner."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cost(n):
    return n + n * n / QUADRATIC_AT


def capacities(tokens: int, sequence: int = SEQUENCE) -> np.ndarray:
    """Sequences that hold so many tokens exactly: full ones, and the powers of two that make up the rest."""
    rest = tokens % sequence
    return np.array([sequence] * (tokens // sequence) + [1 << b for b in range(sequence.bit_length(), -1, -1) if rest >> b & 1], dtype=np.int64)


def pack(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces ``(document, start, length, sequence, offset)``, and the cost of each sequence.

    A document of a full sequence or more fills sequences of its own; what is left of each goes, in descending
    order, to the lowest-cost sequence with room for it. Those for which no sequence has room are cut, again
    lowest cost first, so every sequence comes out full.
    """
    pieces, costs, n = [], [], 0
    rests = np.asarray(lengths, dtype=np.int64).copy()
    for d in np.flatnonzero(rests >= sequence):
        for k in range(int(rests[d]) // sequence):
            pieces.append((int(d), k * sequence, sequence, n, 0))
            costs.append(cost(sequence))
            n += 1
        rests[d] %= sequence
    room = capacities(int(rests.sum()), sequence)
    size, spent = room.copy(), np.zeros(len(room))

    def put(d: int, start: int, length: int, s: int) -> None:
        pieces.append((d, start, length, n + s, int(size[s] - room[s])))
        room[s] -= length
        spent[s] += cost(length)

    uncut = []
    for d in np.argsort(-rests, kind="stable"):
        length = int(rests[d])
        if not length:
            break
        fits = room >= length
        s = int(np.argmin(np.where(fits, spent, np.inf)))
        if fits[s]:
            put(int(d), int(lengths[d]) - length, length, s)
        else:
            uncut.append(int(d))
    for d in uncut:
        at, end = int(lengths[d] - rests[d]), int(lengths[d])
        while at < end:
            s = int(np.argmin(np.where(room > 0, spent, np.inf)))
            length = min(end - at, int(room[s]))
            put(d, at, length, s)
            at += length
    return pieces, np.r_[costs, spent]


_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, its place in the document, the checksum of its ids, and its place in a sequence.

    Documents are tokenized whole (a null text as empty) and end with id 1; each id lies in one piece. They are
    packed where they are read, in windows of bounded size within a partition, so nothing is shuffled and no
    document waits for others; every sequence has ``sequence`` tokens or a power of two fewer, without padding.
    ``sequence_id`` holds the partition and a count. The same files read in the same splits give the same result.
    Repeated rows are packed as often as they come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequences = encoding(vocabulary).encode_to_numpy, TaskContext.get().partitionId() << 40
        ids, documents, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            pieces, costs = pack(lengths, sequence)
            doc, start, length, seq, offset = np.array(pieces, dtype=np.int64).reshape(-1, 5).T
            sums = [zlib.crc32(ids[d][a:a + n].tobytes()) for d, a, n in zip(doc, start, length)]
            totals = np.bincount(seq, weights=length).astype(np.int64)
            out = pa.record_batch({
                "doc_id": pa.array([documents[d] for d in doc], kind), "start": start, "length": length, "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": lengths[doc], "sequence_id": sequences + seq, "offset": offset,
                "sequence_tokens": totals[seq], "sequence_cost": costs[seq]})
            sequences += len(costs)
            return out

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("doc_id").type
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                own = np.append(encode(t or "", allowed_special="all"), np.uint32(END_ID)).astype("<u4", copy=False)
                ids.append(own)
                documents.append(d)
                held += len(own)
                if held >= WINDOW_TOKENS:
                    yield flush()
                    ids, documents, held = [], [], 0
        if ids:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {_FIELDS}")
