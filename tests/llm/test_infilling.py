import hashlib
import random
import re

from cases import ROWS, given, no_documents, odd_documents
from tickbars.llm import infilling

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def expected(doc_id, text):
    """By the list of lines, without a skip list."""
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(docs):
    out = infilling.fill_in_middle(docs)
    assert out.columns == COLUMNS
    back = out.withColumn("back", infilling.restored()).collect()
    key = lambda r: str((r[0], r[5]))
    want = [(i, *expected(i, t)) for i, t in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:6] for r in back), key=key) == sorted(want, key=key)
    texts = sorted((r.text or "" for r in docs.collect()))
    assert sorted(r.back for r in back) == texts


def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 17, 100, 1000):
        sizes = [rng.randint(1, 90) for _ in range(n)]
        own = infilling.SkipList(sizes)
        total = 0
        for rank in range(n + 1):
            assert own.locate(rank) == total
            total += sizes[rank] if rank < n else 0


def test_lanes_thin_out():
    own = infilling.SkipList([1] * 100_000)
    assert 10 < len(own.lanes) < 40
    assert sum(len(units) for units, _, _ in own.lanes) < 2.2 * 100_000


def test_line_sizes():
    for text in ("", "\n", "a", "a\n", "\n\n", "a\nb", "a\n\nb\n", "é\U0001F600\r\nx\x0b\x0cy z"):
        assert infilling.line_sizes(text) == [len(x) for x in re.findall("[^\n]*\n|[^\n]+", text)]


def test_given(spark):
    check(given(spark))


def test_odd_documents(spark):
    check(odd_documents(spark))
    assert infilling.fill_in_middle(no_documents(spark)).collect() == []
    assert len(ROWS) == infilling.fill_in_middle(odd_documents(spark)).count()


def test_marks_and_pieces_of_marks(spark):
    texts = ["a <P> b\nc", "<S>", "x<M>\n", "<", "<P", "P>\n<S", "<\n<\n<P\nM>\n>", ">\nS>\nP><", "<P\n>"]
    check(spark.createDataFrame([(i * 31 + j, t) for i in range(12) for j, t in enumerate(texts)], "doc_id long, text string"))


def test_rate_and_share(spark):
    docs = given(spark)
    assert {r.form for r in infilling.fill_in_middle(docs, rate=0).select("form").distinct().collect()} == {"plain"}
    assert "psm" not in {r.form for r in infilling.fill_in_middle(docs, spm=100).select("form").distinct().collect()}
