import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cases import ROWS, SF, given, no_documents, odd_documents
from tickbars.llm import lm
from tickbars.llm.queries import QUERIES

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), "\n"]


def expected(rows, order=lm.ORDER, folds=10):
    """By dictionaries of whole words and a recursive probability."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0 for i, _ in rows]
    counts = Counter()
    for (_, text), out in zip(rows, held):
        if not out:
            s = [" ", *tokens(text)]
            for k in range(1, order + 1):
                counts.update(tuple(s[j:j + k]) for j in range(len(s) - k + 1))
    unigrams = {g: c for g, c in counts.items() if len(g) == 1 and g != (" ",)}
    learned, kinds = sum(unigrams.values()), len(unigrams)
    below = learned + 0.1 * (kinds + 1)

    def p(word, history):
        if not history:
            return (unigrams.get((word,), 0) + 0.1) / below
        c = counts.get((*history, word), 0)
        return (c + lm.PRIOR * p(word, history[1:])) / (counts.get(history, 0) + lm.PRIOR)

    out = []
    for (i, text), h in zip(rows, held):
        s = tokens(text)
        full = (" ", *s)
        score = sum(math.log10(p(w, full[max(0, j + 1 - (order - 1)):j + 1])) for j, w in enumerate(s))
        out.append((i, h, len(s), sum((w,) in unigrams for w in s), learned, sum(math.log10((unigrams.get((w,), 0) + 0.1) / below) for w in s), score))
    return out


def compare(got, rows, **settings):
    order = lambda r: (str(r[0]), r[2], round(r[6], 5))
    got, want = sorted((tuple(r) for r in got), key=order), sorted(expected(rows, **settings), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = QUERIES["op12_lm_scores"](spark, SF)
    assert out.columns == COLUMNS
    rows = out.collect()
    compare(rows, pairs(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # word order helps on texts not learned from


@pytest.mark.parametrize("order", [1, 2, 4])
def test_orders_in_many_blocks_and_shards(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "SHARD_GRAMS", 5_000)
    monkeypatch.setattr(lm, "HELD_WORDS", 1_000)
    docs = given(spark)
    compare(lm.score_documents(docs, order=order).collect(), pairs(docs), order=order)


def test_odd_documents(spark):
    compare(lm.score_documents(odd_documents(spark)).collect(), [r[:2] for r in ROWS])
    assert lm.score_documents(no_documents(spark)).collect() == []


def test_nothing_learned(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "Some WORDS of no use" if i % 2 else None) for i in ids]
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compare(out, rows)
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 for r in out)


def test_probabilities_after_a_history_add_up_to_one():
    texts = ["a b a c a b d", "b a b a", "", "d c b a a a", "a b"]
    vocabulary = sorted({w for t in texts for w in tokens(t)})
    asked = [f"{' '.join(h)} {w}" for h in (["a"], ["a", "b"], ["c", "d"], ["zz", "b"]) for w in [*vocabulary, "unseen"] if w != "\n"]
    grams = lm.Grams.of(pa.array([*texts, *asked]), 3)
    counts = grams.counts(np.r_[np.ones(len(texts), bool), np.zeros(len(asked), bool)])
    learned = sum(len(tokens(t)) for t in texts)
    own = lm.Automaton(grams, counts, learned + 0.1 * (len(vocabulary) + 1))
    words = grams.ids[0]
    ends = np.r_[grams.firsts[1:], len(words)]
    spans = {t: (a, b) for t, a, b in zip([*texts, *asked], grams.firsts.tolist(), ends.tolist())}
    for h in ("a", "a b", "c d", "zz b"):
        mass = 0.0
        for w in [*vocabulary, "unseen"]:
            a, b = spans[f"{h} {w}"] if w != "\n" else spans[f"{h} a"]
            path = words[a + 1:b - 1].tolist()
            if w == "\n":
                path[-1] = words[b - 1]
            mass += 10 ** (own.score(int(words[a]), path) - own.score(int(words[a]), path[:-1]))
        assert mass == pytest.approx(1.0)


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        x = rng.integers(0, 1 << 31, 1000).astype(kind)
        assert (lm._unpacked(lm._packed(x), len(x), kind) == x).all()
