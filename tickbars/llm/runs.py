"""Periodic runs of words, found on the Re-Pair grammar of each text."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import WORD
from tickbars.llm.words import joined, slices, split_words

#: A run has at least so many words, and at least so many periods. The search for crossings relies on both.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: A run that crosses a border repeats so many words next to it (see ``_meetings``).
WINDOW = 4

Run = tuple[int, int, int]  # start, end, period


class Grammar:
    """Re-Pair grammar of a sequence of numbers from 0 to ``kinds - 1``.

    The pair of neighbours seen most often becomes a symbol of its own, again and again, until no pair comes twice.
    Rule ``kinds + r`` stands for the symbols ``left[r]`` and ``right[r]``; ``root`` is what is left of the sequence.
    """

    def __init__(self, ids: np.ndarray, kinds: int) -> None:
        self.kinds, self.left, self.right = kinds, [], []
        n = len(ids)
        symbol = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places = _repeated_pairs(ids, kinds)
        heap = [(-len(at), pair) for pair, at in places.items()]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            a, b = pair
            valid = [i for i in places.pop(pair) if symbol[i] == a and after[i] < n and symbol[after[i]] == b]  # in order
            live = valid
            if a == b:  # of neighbours that share a symbol only one can go
                live, last = [], -1
                for i in valid:
                    if i != last:
                        live.append(i)
                        last = after[i]
            if len(live) < 2:
                continue
            if heap and len(live) < -heap[0][0]:
                places[pair] = valid
                heapq.heappush(heap, (-len(live), pair))
                continue
            new = kinds + len(self.left)
            self.left.append(a)
            self.right.append(b)
            fresh: dict[tuple[int, int], list[int]] = {}
            for i in live:
                j = after[i]
                h, k = before[i], after[j]
                symbol[i], symbol[j] = new, -1
                after[i] = k
                if k < n:
                    before[k] = i
                    fresh.setdefault((new, symbol[k]), []).append(i)
                if h >= 0:
                    fresh.setdefault((symbol[h], new), []).append(h)
            for found, at in fresh.items():
                if len(at) > 1:
                    places[found] = at
                    heapq.heappush(heap, (-len(at), found))
        self.root, i = [], 0
        while i < n:
            self.root.append(symbol[i])
            i = after[i]
        self.sizes: list[int] = []
        for a, b in zip(self.left, self.right):
            self.sizes.append(self.size(a) + self.size(b))

    def size(self, symbol: int) -> int:
        """Words a symbol stands for."""
        return 1 if symbol < self.kinds else self.sizes[symbol - self.kinds]


def _repeated_pairs(ids: np.ndarray, kinds: int) -> dict[tuple[int, int], list[int]]:
    """Places of each pair of neighbours that comes more than once, in order."""
    if len(ids) < 3:
        return {}
    key = ids[:-1].astype(np.int64) * kinds + ids[1:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    borders = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    out = {}
    for g in np.flatnonzero(np.diff(borders) > 1).tolist():
        at = borders[g]
        out[divmod(int(ordered[at]), kinds)] = order[at:borders[g + 1]].tolist()
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries from the beginning are equal."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, step * 4
    return n


def _meetings(ids: np.ndarray, kinds: int, borders: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Where words around a border come again, one period away: ``window, border index, place, period``.

    Of a run of period p across a border, one side holds half or more: 12 words and 1.5 p. If it is the right one, the
    words from the border on come again p words later, for at least p / 2 words and ``WINDOW``; else those before the
    border came p words earlier. So for p below 16 windows of 4 words tell, for p from 16 to 31 windows of 8, and
    so on. Windows of equal words have equal numbers, those of double length from pairs of numbers.
    """
    n = len(ids)
    number, window = ids.astype(np.int64), 1
    near, far = 1, 4 * WINDOW
    while 2 * window <= n:
        _, number = np.unique(number[:n - 2 * window + 1] * (n + kinds) + number[window:n - window + 1], return_inverse=True)
        window *= 2
        if window < WINDOW:
            continue
        if number.max(initial=-1) + 1 == len(number) or near > n // LEAST_PERIODS:
            return
        places = np.arange(len(number))
        order = np.argsort(number, kind="stable")
        ordered = number[order] * n + order
        for right in (True, False):
            at = borders if right else borders - window
            fits = np.flatnonzero((at >= 0) & (at < len(number)))
            own = at[fits]
            if right:
                low, high = own + near, np.minimum(own + far, n)
            else:
                low, high = np.maximum(own - far + 1, 0), np.maximum(own - near + 1, 0)
            first, last = (np.searchsorted(ordered, number[own] * n + x) for x in (low, np.maximum(high, low)))
            found = last - first
            if not found.any():
                continue
            which = np.repeat(np.arange(len(own)), found)
            other = order[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(first, found)]
            start = np.minimum(places[own][which], other)
            yield window, fits[which], start, np.abs(other - own[which])
        near, far = far, 2 * far


def _crossing(ids: np.ndarray, meetings: list[tuple[int, int, int]], low: int, border: int, high: int) -> list[Run]:
    """Runs across a border within ``[low, high)``; ``meetings`` are ``(period, place, window)`` in order of period."""
    runs: list[Run] = []
    for period, at, window in meetings:
        if at < low or at + period >= high:
            continue
        # Inside a run of period q with a whole period and q words more of a run of period p, p is a multiple of q.
        if any(s <= at and at + period + q <= e and q <= window for s, e, q in runs):
            continue
        ahead = _common(ids[at:high - period], ids[at + period:high])
        back = _common(ids[low:at][::-1], ids[low + period:at + period][::-1])
        start, end = at - back, at + ahead + period
        if start < border < end and end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            if not any(s <= start and end <= e for s, e, _ in runs):  # else it has a smaller period
                runs.append((start, end, period))
    return runs


def _merged(found: Iterable[Run]) -> list[Run]:
    """Maximal runs, by start and period: those of one period that share a whole period are one."""
    out: list[list[int]] = []
    for start, end, period in sorted(found, key=lambda r: (r[2], r[0], r[1])):
        if out and out[-1][2] == period and start <= out[-1][1] - period:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, period])
    return sorted((s, e, p) for s, e, p in out)


def find_runs(ids: np.ndarray, kinds: int) -> list[Run]:
    """All runs ``(start, end, period)`` of a sequence of numbers below ``kinds``, by start and period.

    A run lies in the text of some symbol of the grammar, and crosses the border between the two symbols that this one
    stands for, or else it crosses borders of the root. Each border is searched once, at the first place of its symbol,
    within what the symbol stands for; what is found there holds at every place of the symbol. A piece of a run that
    touches the ends of its symbol is swallowed by the whole run, found at a symbol above.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    grammar = Grammar(ids, kinds)
    first: dict[int, int] = {}
    at, joints = 0, []
    for symbol in grammar.root:
        first.setdefault(symbol, at)
        at += grammar.size(symbol)
        joints.append(at)
    low, border, high, owner = [0] * (len(joints) - 1), joints[:-1], [n] * (len(joints) - 1), [-1] * (len(joints) - 1)
    for r in range(len(grammar.left) - 1, -1, -1):
        symbol = grammar.kinds + r
        start, half = first[symbol], grammar.size(grammar.left[r])
        first.setdefault(grammar.left[r], start)
        first.setdefault(grammar.right[r], start + half)
        if grammar.sizes[r] >= LEAST_WORDS:
            low.append(start)
            border.append(start + half)
            high.append(start + grammar.sizes[r])
            owner.append(symbol)
    meetings: dict[int, set[tuple[int, int, int]]] = {}
    for window, which, places, periods in _meetings(ids, kinds, np.array(border, dtype=np.int64)):
        for i, at, period in zip(which.tolist(), places.tolist(), periods.tolist()):
            meetings.setdefault(i, set()).add((period, at, window))
    found: set[Run] = set()
    inside: dict[int, list[Run]] = {}
    for i, own in meetings.items():
        runs = _crossing(ids, sorted(own), low[i], border[i], high[i])
        if owner[i] < 0:
            found.update(runs)
        elif runs:
            inside[owner[i]] = [(s - low[i], e - low[i], p) for s, e, p in runs]
    if inside:
        _translate(grammar, inside, found)
    return _merged(found)


def _translate(grammar: Grammar, inside: dict[int, list[Run]], found: set[Run]) -> None:
    """Add the runs of symbols at all their places, going down only where there are any."""
    holds = set(inside)
    for r, (a, b) in enumerate(zip(grammar.left, grammar.right)):
        if a in holds or b in holds:
            holds.add(grammar.kinds + r)
    at = 0
    for top in grammar.root:
        todo = [(top, at)] if top in holds else []
        while todo:
            symbol, place = todo.pop()
            found.update((place + s, place + e, p) for s, e, p in inside.get(symbol, ()))
            a, b = grammar.left[symbol - grammar.kinds], grammar.right[symbol - grammar.kinds]
            if b in holds:
                todo.append((b, place + grammar.size(a)))
            if a in holds:
                todo.append((a, place))
        at += grammar.size(top)


def greatest(runs: list[Run]) -> Run | None:
    """The run with the most periods; of equal ones the first, then the one of the smallest period."""
    def order(x: Run, y: Run) -> int:
        more = (y[1] - y[0]) * x[2] - (x[1] - x[0]) * y[2]
        return more or (-1 if (x[0], x[2]) < (y[0], y[2]) else 1)
    return min(runs, key=cmp_to_key(order)) if runs else None


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` of each document row, without a shuffle.

    ``runs`` are all maximal periodic runs of words (at least 24 words and three periods) as structs of start, length
    and smallest period, by start and period; ``best`` is the one with the most periods, or null. ``collapsed`` are the words
    without those that only repeat: in a run all after its first period, joined by one space. A null text counts
    as empty: no words, no runs, an empty text. A null doc_id stays null; repeated rows stay. Other columns are not
    read. Memory is bounded by the longest text.
    """
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                words, borders = split_words(b["text"])
                coded = words.dictionary_encode()
                ids = coded.indices.to_numpy()
                found, keep = [], np.ones(len(words), dtype=bool)
                for at, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
                    kinds, own = np.unique(ids[at:end], return_inverse=True)
                    runs = find_runs(own, len(kinds))
                    found.append(runs)
                    for s, e, p in runs:
                        keep[at + s + p:at + e] = False
                left = np.r_[0, np.cumsum(keep)]
                one = lambda r: None if r is None else {"start": r[0], "length": r[1] - r[0], "period": r[2]}
                yield pa.record_batch({
                    "doc_id": b["doc_id"], "n_words": pa.array(np.diff(borders), pa.int64()),
                    "runs": pa.array([list(map(one, runs)) for runs in found], pa.list_(_RUN)), "best": pa.array([one(greatest(runs)) for runs in found], _RUN),
                    "collapsed": joined(words.filter(pa.array(keep)), left[borders])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start: long, length: long, period: long>"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        detect, f"doc_id {kind}, n_words long, runs array<{run}>, best {run}, collapsed string")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document, by a hash of its id, ends in a stretch of its own words over and over.

    Texts so changed have one space between words. A null doc_id or text leaves the row as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), changed).otherwise(F.col("text")).alias("text"))
