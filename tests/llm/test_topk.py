import numpy as np
import pytest

from cases import SF
from oracle import compare, duck
from tickbars.llm import topk
from tickbars.llm.queries import ORACLES, QUERIES


def brute(rows, every, k=5, scale=256):
    usable = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({(i, tuple(v)) for i, v in usable if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in usable if i != q[0])
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_query_matches_sql(spark):
    name = "op1_top_k_search"
    assert compare(duck(SF), spark, name, QUERIES[name], ORACLES[name], SF) is None


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0, 0.5]), (1, [1.0, -2.0, 0.5]), (2, [1.0, -2.0, 0.5]), (2, [1.0, -2.0, 0.5]), (3, None), (4, [nan, 1.0, 0.0]),
            (5, [1.0, inf, 0.0]), (6, [1.0, None, 0.0]), (None, [1.0, 1.0, 1.0]), (7, [0.0, 0.0, 0.0]), (8, []), (9, [-3.0]), (10, [-1.0, 2.0, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS key")
    found = topk.top_k(df, every=5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 5)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), every=5).count() == 0


def test_few_and_negative_scores(spark):
    rows = [(0, [1.0, 1.0])] + [(i, [-float(i), 0.0]) for i in range(1, 9)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50).collect())) == brute(rows, 50)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "large"])
def test_shard_search_is_exact(kind):
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (600, 24))
    if kind == "sparse":
        v[rng.random(v.shape) < 0.9] = 0
    if kind == "ties":
        v = v // 150
    v = v.astype(object) * 2**40 if kind == "large" else v.astype(float)
    ids = rng.permutation(600)
    shard = topk.Shard(ids, v)
    for q in range(0, 600, 17):
        rows, score = shard.search(v[q], ids[q], 5)
        full = sorted((-int(s), i) for s, i in zip(v @ v[q], ids) if i != ids[q])[:5]
        assert [(-int(s), ids[r]) for r, s in zip(rows, score)] == full


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect())) == brute(rows, 10)
