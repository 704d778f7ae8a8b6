"""Language-model scores: smoothed n-grams as the states and arcs of a weighted backoff automaton."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickbars.llm.words import slices, split_words

#: Words of the longest n-grams.
ORDER = 3
#: What every word of the vocabulary, and one unknown word, is given besides its count.
ADDED = 0.1
#: Weight of the shorter history, in counts, when a history is followed by a word.
PRIOR = 4.0
#: Documents whose hash leaves no remainder are held out.
FOLDS = 10
#: Text scored together, and n-grams counted together.
BLOCK_BYTES, SHARD_GRAMS = 1 << 23, 1 << 20
#: Words a task holds before it passes them on to be counted.
HELD_WORDS = 1 << 21

#: Keys of words are 64-bit hashes. Those of longer n-grams, which are many more, do without the lowest bits.
_BITS = np.uint64((1 << 64) - (1 << 7))
_START, _END = (xxhash.xxh3_64_intdigest(s) for s in (" ", "\n"))  # no words: they are white space
#: Words get one shard in so many.
_WORD_SHARDS = 8
_CODEC = pa.Codec("zstd", 1)


# Words and n-grams ------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the different lower-case words, with those of start (even if there is no text) and end; the
    numbers of the words of all texts among them; where each text's begin."""
    words, borders = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    keys, number = np.unique(np.r_[hashes, np.array([_START, _END], dtype=np.uint64)], return_inverse=True)
    return keys, np.r_[number[coded.indices.to_numpy()], number[-2:]], borders


@dataclass
class Grams:
    """The different n-grams of some texts: words in the order of their keys, then pairs of words, and so on.

    ``ids[k]`` are the numbers of the n-grams of k + 1 words that end at each place of all texts; -1 where the text has
    fewer words so far. Texts have a start and an end around their words; ``firsts`` says where each begins.
    """

    keys: list[np.ndarray]
    firsts: np.ndarray
    ids: list[np.ndarray]

    @classmethod
    def of(cls, texts: pa.Array, order: int) -> Grams:
        keys, coded, borders = _coded_words(texts)
        sizes = np.diff(borders) + 2
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        words = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        inner = np.ones(len(words), dtype=bool)
        inner[firsts] = inner[ends - 1] = False
        words[firsts], words[ends - 1], words[inner] = coded[-2], coded[-1], coded[:-2]
        place = np.arange(len(words)) - np.repeat(firsts, sizes)
        found, ids, level, known = [keys], [words], keys[words], len(keys)
        own = level
        for k in range(1, order):
            longer = np.zeros_like(own)
            with np.errstate(over="ignore"):  # what reaches over the beginning of a text is not used
                longer[1:] = _mixed(level[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:] + np.uint64(k))
            level, use = longer, place >= k
            keys, number = np.unique(longer[use] & _BITS, return_inverse=True)
            full = np.full(len(words), -1, dtype=np.int64)
            full[use] = number + known
            found.append(keys)
            ids.append(full)
            known += len(keys)
        return cls(found, firsts, ids)

    def size(self) -> int:
        return sum(map(len, self.keys))

    def counts(self, learned: np.ndarray) -> np.ndarray:
        """How often each n-gram comes in the texts marked as ``learned``."""
        sizes = np.diff(np.r_[self.firsts, len(self.ids[0])])
        here = np.repeat(learned, sizes)
        return sum(np.bincount(i[here & (i >= 0)], minlength=self.size()) for i in self.ids)


# Keys and counts on their way ---------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, compressed."""
    return _CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(_CODEC.decompress(packed, n * width, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).reshape(n)


_SENT = "shard int, block long, n int, keys binary, counts binary"
_BACK = "block long, shard int, n int, counts binary"


def _shares(shards: int, order: int) -> list[int]:
    """Shards for words, for pairs of words, and so on."""
    words = max(1, shards // _WORD_SHARDS)
    return [words, *[max(1, (shards - words) // max(1, order - 1))] * (order - 1)]


def _sent(block: int, keys: list[np.ndarray], counts: np.ndarray, shares: list[int]) -> dict[str, list]:
    """Keys and their counts as a row per shard. A shard is a stretch of sorted keys; of them differences are sent."""
    out: dict[str, list] = {"shard": [], "block": [], "n": [], "keys": [], "counts": []}
    at = shard = 0
    for own, share in zip(keys, shares):
        place = ((own >> np.uint64(32)) * np.uint64(share) >> np.uint64(32)).astype(np.int64)
        borders = np.searchsorted(place, np.arange(share + 1)).tolist()
        for s, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
            if a < b:
                out["shard"].append(shard + s)
                out["block"].append(block)
                out["n"].append(b - a)
                out["keys"].append(_packed(np.diff(own[a:b], prepend=np.uint64(0))))
                out["counts"].append(_packed(counts[at + a:at + b].astype(np.uint32)))
        at, shard = at + len(own), shard + share
    return out


def _table(columns: dict[str, Sequence]) -> pa.Table:
    kinds = {"shard": pa.int32(), "block": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})


def _received(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all rows of a shard, one after another."""
    n = rows["n"].to_pylist()
    with np.errstate(over="ignore"):
        keys = [np.cumsum(_unpacked(k, m, np.uint64), dtype=np.uint64) for k, m in zip(rows["keys"].to_pylist(), n)]
    return np.concatenate(keys), np.concatenate([_unpacked(c, m, np.uint32) for c, m in zip(rows["counts"].to_pylist(), n)])


def _totals(rows: pa.Table) -> pa.Table:
    """The counts of a shard's n-grams over all blocks, sent back in the order they came in."""
    keys, counts = _received(rows)
    _, number = np.unique(keys, return_inverse=True)
    total = np.bincount(number, weights=counts).astype(np.uint64)[number]
    borders = np.cumsum([0, *rows["n"].to_pylist()])
    back = [_packed(total[a:b]) for a, b in zip(borders[:-1], borders[1:])]
    return _table({"block": rows["block"].to_pylist(), "shard": rows["shard"].to_pylist(), "n": rows["n"].to_pylist(), "counts": back})


# The automaton --------------------------------------------------------------------------------------


class Automaton:
    """Smoothed n-grams as states and arcs.

    A state is a history of fewer words than ``order``; state 0 has none. The arc of an n-gram leads from the history
    of its first words, over its last word, to the longest history it ends in, with the log-probability of that word:
    (count + PRIOR * probability after the shorter history) / (count of the history + PRIOR). Every state but 0 has a
    failure arc to the history without its first word, with log10(PRIOR / (count of the history + PRIOR)): it is
    taken for words without an arc. State 0 has an arc for each word, known or not: (count + ADDED) / all. The
    probabilities after any history add up to one.
    """

    def __init__(self, grams: Grams, counts: np.ndarray, all_words: float, prior: float = PRIOR, added: float = ADDED) -> None:
        n, order = grams.size(), len(grams.ids)
        length = np.zeros(n, dtype=np.int8)
        history, shorter, word = (np.full(n, -1, dtype=np.int64) for _ in range(3))
        for k, ids in enumerate(grams.ids):
            at = np.flatnonzero(ids >= 0)
            own = ids[at]
            length[own], word[own] = k + 1, grams.ids[0][at]
            if k:
                history[own], shorter[own] = grams.ids[k - 1][at - 1], grams.ids[k - 1][at]
        known = counts > 0
        p = np.where(length == 1, (counts + added) / all_words, 0.0)
        for k in range(2, order + 1):
            own = np.flatnonzero((length == k) & known)
            p[own] = (counts[own] + prior * p[shorter[own]]) / (counts[history[own]] + prior)
        with np.errstate(divide="ignore"):
            weight = np.log10(p)
        # State s is the n-gram s - 1. The arcs of a state stand together, in the order of their words.
        goal = np.where(length < order, np.arange(n), shorter) + 1
        goal[~known] = 0
        arcs = np.flatnonzero((length > 1) & known)
        arcs = arcs[np.argsort(history[arcs] * n + word[arcs])]
        self.words = memoryview(word[arcs].astype(np.int32))
        self.first = memoryview(np.searchsorted(history[arcs] + 1, np.arange(n + 2)))
        self.weight, self.goal = memoryview(weight[arcs]), memoryview(goal[arcs])
        self.word_weight, self.word_goal = memoryview(weight), memoryview(goal)
        self.fail = memoryview(np.r_[0, shorter + 1])
        self.fail_weight = memoryview(np.r_[0.0, np.log10(prior / (counts + prior))])

    def score(self, start: int, words: Sequence[int]) -> float:
        """Log-probability of words, from left to right, after the n-gram ``start``."""
        arcs, first, weight, goal, fail, fail_weight = self.words, self.first, self.weight, self.goal, self.fail, self.fail_weight
        state, total = self.word_goal[start], 0.0
        for w in words:
            while state:
                end = first[state + 1]
                i = bisect_left(arcs, w, first[state], end)
                if i < end and arcs[i] == w:
                    total += weight[i]
                    state = goal[i]
                    break
                total += fail_weight[state]
                state = fail[state]
            else:
                total += self.word_weight[w]
                state = self.word_goal[w]
        return total


# Over a corpus ---------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in compressed blocks of about ``BLOCK_BYTES`` of text, numbered within each task."""
    held: list[pa.RecordBatch] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.record_batch({"block": pa.array([number], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        for b in slices(batch, most=BLOCK_BYTES // 8):
            own = b["text"].nbytes
            if held and size + own > BLOCK_BYTES:
                yield block()
                held, size, number = [], 0, number + 1
            held.append(b)
            size += own
    if held:
        yield block()


def _opened(blocks: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(blocks["rows"][0].as_py()).read_all().combine_chunks()


def _vocabulary(docs: DataFrame, shards: int) -> tuple[int, int]:
    """Number of words, and of different ones, in all learned texts, ends included."""
    def sent(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return _table(_sent(0, [keys], counts, [shards])).combine_chunks().to_batches()[0]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if len(held) == 1:
                return held[0]
            keys, number = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(number, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in batches:
            for b in slices(batch):
                keys, coded, _ = _coded_words(b["text"])
                counts = np.bincount(coded[:-2], minlength=len(keys))
                counts[coded[-1]] = b.num_rows
                held.append((keys[counts > 0], counts[counts > 0]))
                if sum(len(k) for k, _ in held) > HELD_WORDS:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged())

    def sizes(rows: pa.Table) -> pa.Table:
        keys, counts = _received(rows)
        return pa.table({"words": [int(counts.sum(dtype=np.int64))], "kinds": [len(np.unique(keys))]})

    rows = docs.filter(~F.col("held_out")).select("text").mapInArrow(words, _SENT)
    found = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(sizes, "words long, kinds long")
    return tuple(x or 0 for x in found.agg(F.sum("words"), F.sum("kinds")).first())


def score_documents(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, prior: float = PRIOR, added: float = ADDED) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document row.

    Learned from are all whole texts that are not held out (crc32 of the id's digits, no digits for a null id, modulo
    ``folds`` is 0). ``base_score`` is the log10-probability by word counts alone, ``score`` the automaton's. A null text
    counts as empty: one token, its end. Repeated rows stay and count each time. If nothing is learned, every word
    is unknown. Other columns are not read.

    Documents come in blocks of ``BLOCK_BYTES`` of text. A block's different n-grams, learned or only asked for, go to
    the shards of the key space; there the counts of all blocks meet, and the totals go back in the same order, without keys.
    So what is gathered grows with the corpus, a block holds just the part of the automaton its own texts can reach,
    and an n-gram of every text is one number a block. Words are told apart by 64 bits of their hashes, longer
    n-grams by 57.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    blocks, shards = (max(1, math.ceil(x)) for x in (size / BLOCK_BYTES, order * size / 6 / SHARD_GRAMS))
    shares = _shares(shards, order)
    learned, kinds = _vocabulary(rows, shares[0])
    all_words = learned + added * (kinds + 1)
    dealt = rows.mapInArrow(_blocks, "block long, rows binary").repartition(blocks, "block")

    def ask(block: pa.Table) -> pa.Table:
        texts = _opened(block)
        grams = Grams.of(texts["text"].combine_chunks(), order)
        learn = ~texts["held_out"].to_numpy()
        return _table(_sent(block["block"][0].as_py(), grams.keys, grams.counts(learn), shares))

    def scored(block: pa.Table, back: pa.Table) -> pa.Table:
        texts = _opened(block)
        grams = Grams.of(texts["text"].combine_chunks(), order)
        back = back.sort_by("shard")
        counts = np.concatenate([_unpacked(c, n, np.uint64) for c, n in zip(back["counts"].to_pylist(), back["n"].to_pylist())]).astype(np.int64)
        automaton = Automaton(grams, counts, all_words, prior, added)
        words = grams.ids[0]
        own = counts[words]
        base = np.log10((own + added) / all_words)
        starts, ends = grams.firsts, np.r_[grams.firsts[1:], len(words)]
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": pa.array(ends - starts - 1, pa.int64()),
            "n_known": pa.array([int((own[a + 1:b] > 0).sum()) for a, b in zip(starts, ends)], pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), learned), pa.int64()),
            "base_score": [float(base[a + 1:b].sum()) for a, b in zip(starts, ends)],
            "score": [automaton.score(int(words[a]), words[a + 1:b].tolist()) for a, b in zip(starts, ends)]})

    asked = dealt.groupBy("block").applyInArrow(ask, _SENT)
    totals = asked.repartition(sum(shares), "shard").groupBy("shard").applyInArrow(_totals, _BACK)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(totals.repartition(blocks, "block").groupBy("block")).applyInArrow(
        scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
