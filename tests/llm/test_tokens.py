import random

import public_tokenizers
from tokenizers import Tokenizer

from cases import ROWS, given, no_documents, odd_documents
from tickbars.llm import tokens
from tickbars.llm.queries import QUERIES

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_given(spark):
    texts = {r.doc_id: r.text for r in given(spark).collect()}
    for r in QUERIES["op4_token_counts"](spark, "/root/testdata/sf0.001").collect():
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def test_odd_documents(spark):
    out = sorted(((r.doc_id, r.n_tokens) for r in tokens.count_tokens(odd_documents(spark)).collect()), key=str)
    assert out == sorted(((r[0], library(r[1])) for r in ROWS), key=str)
    assert tokens.count_tokens(no_documents(spark)).count() == 0


def test_random_texts_and_small_caches(monkeypatch):
    rng = random.Random(5)
    parts = [*"ab  \n\t'sdtx\u00e9\u4e2d\U0001F600\x00 \u200b1.,-", "<|endoftext|>", "<|endof", "  ", " 's", "'ll", " \n", "\u3000", "aaaaaaaaaaaaaaaa"]
    for cached in (tokens.CACHED, 3):
        monkeypatch.setattr(tokens, "CACHED", cached)
        own = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
        for _ in range(3000):
            text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
            assert own(text) == library(text), repr(text)
