import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from cases import ROWS, SF, given, no_documents, odd_documents
from tickbars.llm import common, simhash
from tickbars.llm.queries import QUERIES


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=2):
    """Root of each fingerprint by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def check(rows, out):
    prints = [fingerprint(t) for _, t in rows]
    roots = classes(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    expected = [(i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints)]
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)


def test_given(spark):
    check([(r.doc_id, r.text) for r in given(spark).collect()], QUERIES["op8_simhash_near_dedup"](spark, SF).collect())


def test_odd_documents(spark):
    out = simhash.near_duplicate_groups(odd_documents(spark)).collect()
    check([(r[0], r[1]) for r in ROWS], [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out])
    assert simhash.near_duplicate_groups(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and simhash.drop_near_duplicates(no_documents(spark)).count() == 0
    prints = [fingerprint(r.text) for r in kept.collect()]
    assert len(prints) == len(set(classes([fingerprint(r[1]) for r in ROWS]).values())) == len({classes([fingerprint(r[1]) for r in ROWS])[p] for p in prints})


@pytest.mark.parametrize("bucket", [4, 4096])
def test_links_lose_no_pair(spark, monkeypatch, bucket):
    """Fingerprints with correlated bits, chains and a crowded ball; small buckets are cut into parts."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)}
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    prints |= {p ^ (1 << rng.randrange(64)) for p in list(prints)[:100]} | {rng.getrandbits(20) for _ in range(200)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {tuple(r) for r in common.components(simhash.fingerprint_links(frame)).collect()}
    roots = classes(prints)
    groups = {}
    for p, r in roots.items():
        groups.setdefault(r, set()).add(p - (1 << 64) if p >> 63 else p)
    assert found == {(p, min(g)) for g in groups.values() if len(g) > 1 for p in g}


def test_allocation():
    assert sum(t + 1 for t in simhash.allocate([[0, 5, 50, 99], [0, 1, 2, 3]], 2)) == 3
    assert simhash.allocate([[0, 5, 50, 99], [0, 1, 2, 3]], 2) == [-1, 2]
    assert simhash.allocate([[0, 1, 9, 99]] * 3, 2) == [0, 0, 0]


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 40], bits[:, 50] = bits[:, 3], bits[:, 3]
    groups = simhash.group_bits(2000, bits.T @ bits, 3)
    assert sorted(sum(groups, [])) == list(range(64)) and any({3, 40, 50} <= set(g) for g in groups)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    found = pd.DataFrame(common.components(spark.createDataFrame(links, "a long, b long")).collect(), columns=["node", "root"])
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert dict(zip(found.node, found.root)) == {n: label[n] for n in linked} and len(found) == len(linked)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
