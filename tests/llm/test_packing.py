import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import ROWS, given, no_documents, odd_documents
from tickbars.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def full(total):
    return total == packing.SEQUENCE or total < packing.SEQUENCE and total & (total - 1) == 0


def check(rows, out):
    """Each document's pieces cover its ids once, with their checksums; each sequence is gapless and full."""
    spans, sequences = {}, {}
    for r in out:
        spans.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id in {r[0] for r in rows}:
        wanted = sorted(tuple(ids_of(t)) for i, t in rows if i == doc_id)
        assert sum(r.length for r in spans[doc_id]) == sum(map(len, wanted))
        if len(wanted) == 1:
            ids, at = ids_of(next(t for i, t in rows if i == doc_id)), 0
            for r in sorted(spans[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert full(at)


def test_given(spark):
    docs = given(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(docs).collect())


def test_odd_documents_in_small_windows(spark, monkeypatch):
    check([(r[0], r[1]) for r in ROWS], packing.pack_documents(odd_documents(spark)).collect())
    assert packing.pack_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 1], [5000, 1, 1, 700], [1024] * 7, [3] * 5000, list(np.random.default_rng(3).integers(1, 4000, 500))])
def test_pack(lengths):
    pieces, costs = packing.pack(np.array(lengths, dtype=np.int64))
    used, spent = {}, np.zeros(len(costs))
    for doc, start, length, sequence, offset in pieces:
        used.setdefault(sequence, []).append((offset, length))
        spent[sequence] += packing.cost(length)
    assert all(full(sum(n for _, n in v)) for v in used.values()) and np.allclose(spent, costs)
    assert sum(n for v in used.values() for _, n in v) == sum(lengths)


def test_costs_are_balanced():
    """Short documents: sequences cost much the same, and less evenly if documents go where they fit first."""
    lengths = np.random.default_rng(0).integers(20, 900, 3000)
    _, costs = packing.pack(lengths)
    full_ones = costs[:lengths.sum() // packing.SEQUENCE]
    assert full_ones.std() / full_ones.mean() < 0.1
