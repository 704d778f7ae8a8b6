import random

import pytest
from pyspark.sql import functions as F

from cases import SF
from oracle import compare, duck
from tickbars.llm import urlfilter
from tickbars.llm.queries import ORACLES, QUERIES


def test_query_matches_sql(spark):
    name = "op10_url_filters"
    assert compare(duck(SF), spark, name, QUERIES[name], ORACLES[name], SF) is None


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/en/1x?q#f", "https://a.b.example.org/es/", "http://example.org?x/en/1", "https://com/fr/", "https://x.com/fr",
        "https://notexample.org/en/1", "https://.org/", "https://org", "https://org/", "http://X.Com/de/1://y", "https://x.net/a", "http://x.net/a?b", "https://\u0130.org/en/1",
        "https://example.org#/en/1", "http://u@h.org:80/p", "https://example.org/en/1", "https://example.org/en/1", "x://y/" + "z" * 5000]


def judged(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if (host, path) in listed else "allow"


@pytest.mark.parametrize("bits", [64, urlfilter.FILTER_BITS])
def test_odd_urls(spark, bits):
    """With filters of 64 bits the levels are cut into several."""
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "key", "shard", "rule")})
    listed = {judged(u, ())[:2] for u in URLS if u and u.startswith("http://")} - {("", "")}
    out = urlfilter.judge(pages, F.col("url").startswith("http://"), filter_bits=bits).collect()
    assert {r.page_id: tuple(r)[1:] for r in out} == {i: judged(u, listed) for i, u in enumerate(URLS)}


def test_no_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), F.lit(True)).count() == 0


@pytest.mark.parametrize("bits,share", [(1 << 20, 0.1), (256, 0.5), (1 << 20, 0.9), (1 << 20, 0.0)])
def test_cascade_is_exact(spark, bits, share):
    rng = random.Random(1)
    keys = [(f"key {i}", rng.random() < share) for i in range(1500)]
    frame = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = urlfilter.Cascade(frame, bits)
    out = cascade.add_listed(frame, F.col("key"), "found").collect()
    assert len(out) == 1500 and all(r.found == r.listed for r in out)
    assert (len(cascade.levels) > 1) == (share > 0)


def test_main_path_is_native(spark):
    plan = QUERIES["op10_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
