"""Fill-in-the-middle: texts cut at line borders and put in another order, through an indexable skip list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Documents in a hundred that are transformed, and those of them whose suffix comes first.
RATE, SPM = 100, 50
#: A node of one lane is in the next with probability one half.
LANE_SEED = 11
#: Texts of about so many characters leave a task together.
BATCH_CHARS = 1 << 22


class SkipList:
    """Units of a text with their sizes in code points, reached by rank.

    The lowest lane links each unit to the next; every lane above skips over about half of the nodes of the one below.
    A link carries how many units and how many code points lie under it. ``locate`` descends from the topmost lane and
    adds up widths until exactly ``rank`` units are passed, in about 2 log2(n) steps.
    """

    def __init__(self, sizes: Sequence[int]) -> None:
        n = len(sizes)
        rng = np.random.Generator(np.random.PCG64(LANE_SEED))
        node = np.arange(n + 1)  # node 0 is the head, before the first unit; node n follows the last
        points = np.asarray(sizes, dtype=np.int64)
        self.lanes: list[tuple[list[int], list[int], list[int]]] = [([1] * n, points.tolist(), [])]
        while len(node) > 2:
            up = np.flatnonzero(rng.random(len(node)) < 0.5)
            up = up[up > 0]
            if len(up) in (0, len(node) - 1):
                up = np.arange(2, len(node), 2)
            up = np.r_[0, up]  # the head is in every lane
            ends = up[1:]
            # Links that end at a node of this lane; beyond the last one, the lanes below go on.
            points = np.add.reduceat(points[:ends[-1]], up[:-1])
            self.lanes.append((np.diff(node[up]).tolist(), points.tolist(), up.tolist()))
            node = node[up]

    def locate(self, rank: int) -> int:
        """Code points in front of the unit of this rank, the first one's being 0."""
        at = passed = points = 0
        for units, widths, down in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += units[at]
                points += widths[at]
                at += 1
            if down:
                at = down[at]
        return points


def line_sizes(text: str) -> list[int]:
    """Code points of each line of a text, with the line feed that ends it."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    return sizes if sizes[-1] else sizes[:-1]


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that depend on the document's id alone; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in range(0, 32, 8))


def transform(doc_id, text: str | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Number of lines, form, code points of prefix and middle, and the transformed text of one document."""
    text = text or ""
    sizes = line_sizes(text)
    n = len(sizes)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(sizes)
    a, b = (units.locate(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each document row, without a shuffle.

    A text is cut at two line borders drawn from its id. A null text counts as empty. Empty texts and those that
    contain a mark stay ``plain``, with null sizes. A null doc_id stays null and draws as an id without digits;
    repeated rows stay, with the same result. Other columns are not read. Memory is bounded by the longest text.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, held, at = b["doc_id"].to_pylist(), [], 0, 0
            for i, value in enumerate(b["text"]):
                rows.append(transform(ids[i], value.as_py(), seed, rate, spm))
                held += len(rows[-1][4])
                if held > BATCH_CHARS or i + 1 == b.num_rows:
                    n, form, prefix, middle, output = zip(*rows)
                    yield pa.record_batch({
                        "doc_id": b["doc_id"].slice(at, len(rows)), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                        "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.string())})
                    rows, held, at = [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text again, from the transformed one and its form. A transformed text holds each mark once."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    middle = F.substring_index(out, MIDDLE, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(out, MIDDLE, 1)
        return F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)

    psm, spm = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(psm[0], middle, psm[1])).when(form == "spm", F.concat(spm[1], middle, spm[0])).otherwise(out)
