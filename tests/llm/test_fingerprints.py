import hashlib

import numpy as np

from cases import ROWS, given, no_documents, odd_documents
from tickbars.llm import fingerprints as fp
from tickbars.llm.queries import QUERIES


def expected(rows):
    """Digests of the edited texts, from one list in order."""
    import xxhash

    def as_long(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), as_long(r[1]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, rows):
    out = fp.fingerprint_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    return out


def test_given(spark):
    docs = given(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = check(docs, rows)
    by_text = {}
    texts = dict(rows)
    for r in out:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r.near_edited for r in out]) > 10 * np.mean([r.near_next for r in out])
    assert QUERIES["op3_fingerprints"](spark, "/root/testdata/sf0.001").count() == len(rows)


def test_odd_documents(spark, monkeypatch):
    check(odd_documents(spark), [(r[0], r[1]) for r in ROWS])
    monkeypatch.setattr(fp, "RANGE_BYTES", 500)  # several ranges, some of one row
    check(odd_documents(spark), [(r[0], r[1]) for r in ROWS])


def test_empty_and_lone(spark):
    assert fp.fingerprint_documents(no_documents(spark)).count() == 0
    check(spark.createDataFrame([(5, "a lone text")], "doc_id long, text string"), [(5, "a lone text")])


def test_lexicon_is_the_band(spark):
    docs = given(spark)
    texts = [r.text or "" for r in docs.collect()]
    df = {}
    for t in texts:
        for p in set(fp._places(fp.terms(t)).tolist()):
            df[p] = df.get(p, 0) + 1
    low, high = len(texts) ** (1 - fp.BAND[1]), len(texts) ** (1 - fp.BAND[0])
    bits = np.frombuffer(fp.lexicon(docs), dtype=np.uint8)
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {p for p, n in df.items() if low <= n <= high}


def test_subsets_are_of_the_terms_not_their_order():
    a = fp.terms("alpha beta gamma delta epsilon zeta")
    assert np.array_equal(fp.subset_hashes(a), fp.subset_hashes(a[::-1]))
    assert fp.likeness(fp.subset_hashes(a), fp.subset_hashes(a)) == 1.0
    assert not fp.subset_hashes(a[:0]).any()
