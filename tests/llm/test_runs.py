import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import ROWS, SF, given, no_documents, odd_documents
from tickbars.llm import runs
from tickbars.llm.queries import QUERIES, op13

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(s):
    """Every period at every place."""
    n, out = len(s), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p) and j > i:
                w = s[i:j + p]
                if not any(w[q:] == w[:-q] for q in range(1, p)):
                    out.add((i, j + p, p))
            i = j + 1
    return sorted(out)


def found(s):
    kinds, ids = np.unique(s, return_inverse=True)
    return runs.find_runs(ids, len(kinds))


def test_random_sequences():
    rng = random.Random(5)
    for _ in range(1200):
        n, k = rng.randint(20, 140), rng.choice([1, 2, 2, 3, 5, 20])
        s = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n), rng.randint(1, n // 3)
            for i in range(a, rng.randint(a, n)):
                s[i] = s[a + (i - a) % p]
        assert found(s) == brute(s), s


@pytest.mark.parametrize("s", [
    [0] * 24, [0] * 23, [0, 1] * 12, list(range(9)) * 3, list(range(8)) * 3, list(range(50)) * 3 + [7], ([0] * 30 + [1]) * 20,
    (list(range(5)) * 8 + [9]) * 5, list(range(40)) + list(range(40)) * 2, sum(([1, 2, 3, 4, 10 + i] for i in range(200)), [])])
def test_shapes(s):
    assert found(s) == brute(s)


def test_fibonacci_words():
    x, y = [0], [0, 1]
    while len(y) < 900:
        x, y = y, y + x
    assert found(y) == brute(y)


def test_grammar_gives_the_sequence_again_and_repeats_no_pair():
    rng = random.Random(2)
    for _ in range(200):
        ids = np.array([rng.randrange(3) for _ in range(rng.randint(1, 200))])
        g = runs.Grammar(ids, 3)

        def text(symbol, g=g):
            return [symbol] if symbol < 3 else text(g.left[symbol - 3]) + text(g.right[symbol - 3])
        assert sum(map(text, g.root), []) == ids.tolist()
        assert all(g.size(x) == len(text(x)) for x in g.root)
        pairs, last = {}, None
        for i, pair in enumerate(zip(g.root, g.root[1:])):
            assert i - pairs.get(pair, i) in (0, 1)  # at most overlapping, as in x x x
            pairs.setdefault(pair, i)


def test_long_sequences_end():
    assert found([0] * 100_000) == [(0, 100_000, 1)]
    assert found(list(range(777)) * 100) == [(0, 77_700, 777)]


def expected(doc_id, text, edit=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if edit and h is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    own = brute(words) if n < 700 else found(words)
    drop = {i for s, e, p in own for i in range(s + p, e)}
    best = max(own, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(own), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{e - s},{p}\n" for s, e, p in own)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES["op13_periodic_runs"](spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == sorted(expected(i, t) for i, t in docs.select("doc_id", "text").collect())
    assert sum(r[1] for r in rows) > 5


def test_odd_documents(spark):
    rows = [tuple(r) for r in op13(odd_documents(spark)).collect()]
    assert sorted(rows, key=str) == sorted((expected(r[0], r[1]) for r in ROWS), key=str)
    assert op13(no_documents(spark)).collect() == []
    many = spark.createDataFrame([(i, "a b c d \t e f g h\n" * 9 if i % 3 else None) for i in range(60)], "doc_id int, text string")
    assert sorted(tuple(r) for r in op13(many).collect()) == sorted(expected(r.doc_id, r.text) for r in many.collect())


def test_runs_and_texts_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 8 + "y " + "z " * 30), (2, "one two"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in runs.detect_runs(docs).collect()}
    assert [tuple(r) for r in out[1].runs] == [(1, 24, 3), (26, 30, 1)] and tuple(out[1].best) == (26, 30, 1)
    assert out[1].collapsed == "x a b c y z" and out[1].n_words == 56
    assert out[2].runs == [] and out[2].best is None and out[2].collapsed == "one two"
    assert out[3].n_words == 0 and out[3].collapsed == ""


def test_small_slices(spark, monkeypatch):
    docs = given(spark).filter(F.col("doc_id") < 30).collect()
    import pyarrow as pa
    from tickbars.llm.words import joined, slices, split_words
    batch = pa.record_batch({"text": pa.array([None, "", " a  b\n", *[r.text for r in docs], "  "])})
    parts = list(slices(batch, most=1000))
    assert sum(p.num_rows for p in parts) == batch.num_rows and len(parts) > 3
    got = [x for p in parts for x in joined(*split_words(p["text"])).to_pylist()]
    assert got == [" ".join(WORD.findall(t or "")) for t in batch["text"].to_pylist()]
