import numpy as np

from cases import ROWS, given, no_documents, odd_documents
from tickbars.llm import mixing
from tickbars.llm.queries import QUERIES


def targets(sizes, weights=(1, 2, 3), most=3):
    """By resharing the excess again and again. ``sizes``: source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(docs, rows, near):
    out = mixing.mix_report(docs).toPandas()
    words = lambda t: len((t or "").encode().split())
    assert len(out) == len(rows)
    assert sorted(map(str, zip(out.doc_id.astype(object).where(out.doc_id.notna(), None), out["size"]))) == sorted(map(str, ((float(i) if out.doc_id.dtype == float and i is not None else i, words(t)) for i, t, _ in rows)))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    goal = targets(sizes)
    per = out.groupby(["source_size", "target"])["taken"].sum()
    assert sorted(round(v, 4) for v in out.target.unique()) == sorted({round(v, 4) for v in goal.values()})
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    for (size, target), taken in per.items():
        many = sum(1 for s in sizes if sizes[s] == size and round(goal[s], 4) == round(target, 4))
        assert abs(taken - many * target) <= near(size)


def test_given(spark):
    rows = [(r.doc_id, r.text, r.source) for r in given(spark).collect()]
    check(given(spark), rows, lambda size: 0.5 * size)
    one, two = (sorted(map(tuple, QUERIES["op9_mix_sources"](spark, "/root/testdata/sf0.001").collect())) for _ in "ab")
    assert one == two


def test_odd_documents(spark):
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    check(odd_documents(spark), rows, lambda size: 3 * size)
    assert mixing.mix_report(no_documents(spark)).count() == 0 and mixing.mix(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.times for r in mixing.mix_report(docs).collect())


def test_blocks_keep_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "BLOCKS_TOGETHER", 4)
    rows = [(i, " ".join(["w"] * (i * 37 % 90 + 1)), "big" if i % 3 else f"s{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs, rows, lambda size: 0.01 * size)
    out = mixing.times_taken(docs).toPandas()
    for _, part in out.groupby("source"):
        whole = (part.target / part.source_size).iloc[0]
        assert abs(part.times.sum() - whole * len(part)) <= 8  # documents are balanced as well


def test_flight_keeps_both_totals_and_expectations():
    import random

    sizes = np.random.default_rng(1).integers(1, 500, 60)
    hits = np.zeros(60)
    for seed in range(400):
        units = [mixing._Unit(i, float(x), 1.0, 0.3) for i, x in enumerate(sizes)]
        rest = mixing.flight(units, random.Random(seed))
        p = np.array([u.p for u in units])
        assert len(rest) <= 2 and abs(p @ sizes - 0.3 * sizes.sum()) < 1e-5 and abs(p.sum() - 18) < 1e-6
        hits += p
    assert abs(hits / 400 - 0.3).max() < 0.12
