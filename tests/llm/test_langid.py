import numpy as np
import zlib

from cases import ROWS, given, no_documents, odd_documents
from tickbars.llm import langid
from tickbars.llm.queries import QUERIES


def test_accuracy_on_held_out(spark):
    docs = given(spark)
    found = langid.identify(docs).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    assert (found[found.held_out].lang == found[found.held_out].lang_pred).mean() >= 0.95
    assert found.score.between(0, 1).all() and not found.rejected.any()


def test_query(spark):
    out = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["held_out"] == "boolean" and out.count() == given(spark).count()


def test_odd_documents(spark):
    docs = given(spark).unionByName(odd_documents(spark, False))
    model = langid.train(docs)
    out = model.classify([r[1] for r in ROWS])
    for r, pred, score in zip(ROWS, out.lang_pred, out.score):
        letters = any(c.isalpha() for c in r[1] or "")
        assert (pred == "und") == (not letters) and 0 <= score <= 1
    assert langid.identify(odd_documents(spark)).count() == len(ROWS)
    assert langid.identify(no_documents(spark)).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR text = ''").count() == 0
    assert kept.join(given(spark), "doc_id", "left_semi").count() >= given(spark).count()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]


def kneser_ney(texts, order):
    """The same estimate by dictionaries, straight from the definition."""
    grams = [dict() for _ in range(order + 1)]
    symbols = set()
    for t in texts:
        c = [0] * (order - 2) + langid.codes(t).tolist()
        symbols |= set(c)
        for i in range(order - 1, len(c)):
            g = tuple(c[i - order + 1:i + 1])
            grams[order][g] = grams[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1
    v = len(symbols) + 1

    def p(g):
        if not g:
            return 1 / v
        counts = grams[len(g)]
        once, twice = sum(x == 1 for x in counts.values()), sum(x == 2 for x in counts.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        after = {k: x for k, x in counts.items() if k[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        return max(counts.get(g, 0) - d, 0) / total + d * len(after) / total * p(g[1:])

    return p


def test_model_is_interpolated_kneser_ney():
    texts = ["the cat sat on the mat, the rat.", "a cat and a hat", "that is that", "calibration only"]
    model = langid.Model({"en": texts})
    p = kneser_ney(texts[:3], langid.ORDER)
    for t in ("the hat", "zebra cat!", "a", "que sera"):
        c = [0] * (langid.ORDER - 2) + langid.codes(t).tolist()
        expected = [-np.log2(p(tuple(c[i - langid.ORDER + 1:i + 1]))) for i in range(langid.ORDER - 1, len(c))]
        h, n = model.entropies(langid.codes(t))
        assert n == len(expected) and abs(h[0] - np.mean(expected)) < 1e-4
        both, sizes = model.entropies_of((langid.codes(x) for x in ("the", t, "", "mat")), 4)
        assert abs(both[1][0] - h[0]) < 1e-4 and sizes.tolist()[1:3] == [n, 0]


def test_slices_do_not_matter(monkeypatch):
    model = langid.Model({"en": ["the cat sat on the mat"] * 4})
    t = langid.codes("the cat and the mat sat on that rat " * 20)
    whole, n = model.entropies(t)
    monkeypatch.setattr(langid, "SLICE", 64)
    parts, m = model.entropies(t)
    assert n == m and np.allclose(whole, parts, atol=1e-4)


def test_a_mislabelled_calibration_document_does_not_end_rejection():
    import random

    from tickbars.llm import langid

    rng = random.Random(2)
    words = {k: ["".join(rng.choices(a, k=rng.randint(2, 8))) for _ in range(200)] for k, a in (("a", "abcdefgh"), ("b", "ijklmnop"), ("c", "aeimqtuv"))}
    text = lambda k, n=120: " ".join(rng.choices(words[k], k=n))
    own = {k: [text(k) for _ in range(80)] for k in "ab"}
    own["a"][3] = own["b"][7] = text("c")  # every fourth document calibrates
    model = langid.Model(own)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(120))
    assert model.classify([text("c") for _ in range(5)] + [noise]).rejected.all()
    assert not model.classify([text(k) for k in "ab" for _ in range(20)]).rejected.any()


def test_every_language_is_learned_even_from_long_documents_only(spark):
    import random

    rng = random.Random(4)

    def text(k, n):
        letters = [chr(0x4E00 + 12 * k + j) for j in range(12)]
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    rows = [(k * 100 + i, text(k, 2500 if k == 0 else 30), f"l{k:02}") for k in range(70) for i in range(12)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id // 100 for r in out if r.held_out} >= set(range(1, 60))
    assert all(r.lang_pred == f"l{r.doc_id // 100:02}" and not r.rejected for r in out)
