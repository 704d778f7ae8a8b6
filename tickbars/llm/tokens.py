"""Token counts and token ids by byte-pair merging, over the vocabulary of a public tokenizer."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of each cache of a worker: a bound on memory, not on what is counted.
CACHED = 600_000
#: Longer pieces are not cached.
CACHED_CHARS = 48


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others
    get the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairMerger:
    """Counts the tokens of pieces: a heap of adjacent pairs by rank over a linked list of symbols.

    The count is the number of first symbols minus the number of merges; no ids are made.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        byte_of = {c: bytes([b]) for b, c in letters.items()}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        numbers = {c: i for i, c in enumerate(letters.values())}
        for a, b in pairs:
            numbers.setdefault(a + b, len(numbers))
        #: (symbol, symbol) as one number -> rank, and the symbol that each rank makes.
        self.width = len(numbers)
        self.ranks = {numbers[a] * self.width + numbers[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [numbers[a + b] for a, b in pairs]
        self.first = [numbers[letters[b]] for b in range(256)]
        self.whole = {b"".join(map(byte_of.__getitem__, a + b)) for a, b in pairs}
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2 or piece in self.whole:  # a word of the vocabulary comes out as itself
            return min(n, 1)
        symbols = [*map(self.first.__getitem__, piece), -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        width, find, made, push, pop = self.width, self.ranks.get, self.made, heapq.heappush, heapq.heappop
        # An entry is rank * (n + 1) + place: the lowest rank first, then the leftmost.
        step = n + 1
        heap = [r * step + i for i, r in enumerate([find(a * width + b, -1) for a, b in zip(symbols, symbols[1:])]) if r >= 0]
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i = divmod(pop(heap), step)
            left, j = symbols[i], after[i]
            if left < 0 or find(left * width + symbols[j]) != rank:
                continue  # one of the two has been merged since
            merged = symbols[i] = made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                r = find(merged * width + symbols[k])
                if r is not None:
                    push(heap, r * step + i)
            h = before[i]
            if h >= 0:
                r = find(symbols[h] * width + merged)
                if r is not None:
                    push(heap, r * step + h)
        return count


class Chunks(dict):
    """A bounded cache over the parts of a text between single spaces.

    The pattern of the tokenizer never goes on from other text into a space, so a part with the space in front
    of it is tokenized alike wherever it stands, unless white space meets white space at its ends: those parts
    hold None, and texts that have one are split as a whole.
    """

    def __init__(self, split, value) -> None:
        super().__init__()
        self.split, self.value = split, value

    def __missing__(self, chunk: str):
        part = chunk[1:]
        if not part or part[0].isspace() or part[-1].isspace():
            found = None
        else:
            found = self.value(self.split(chunk))
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = found
        return found


def spaced(text: str) -> list[str]:
    """The parts of a text, each with the space before it, but for the first."""
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]]


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str, pattern: str) -> None:
        merger = PairMerger(path)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, int] = {}
        self.merger = merger
        self.chunks = Chunks(self.split, self._sum)
        marks = [s for s in merger.special if s]
        self.special = regex.compile("|".join(map(regex.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.marks = marks

    def _piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merger.count(piece.encode("utf-8"))
            if len(piece) <= CACHED_CHARS:
                if len(self.pieces) >= CACHED:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _sum(self, pieces: list[str]) -> int:
        return sum(map(self._piece, pieces))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        head, *rest = spaced(text)
        if head and not head[-1].isspace():
            counts = list(map(self.chunks.__getitem__, rest))
            if None not in counts:
                return self._sum(self.split(head)) + sum(counts)
        return self._sum(self.split(text))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.cache
def counter(vocabulary: str) -> Counter:
    """One per worker process, so that tasks share what it has learned; its caches are bounded."""
    import public_tokenizers

    return Counter(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document row, without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. A special string inside a text is one token, as the library
    takes it by default. Repeated rows stay; a null doc_id stays null. Memory is bounded by the caches and the
    longest text. ``vocabulary`` names a public tokenizer file, read where the task runs.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in batches:
            n = [own(t) for t in b["text"].to_pylist()]
            yield pa.record_batch({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    rows = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
