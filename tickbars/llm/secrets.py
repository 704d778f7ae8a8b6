"""Secrets in texts: fixed patterns, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
VALUE_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
#: Candidates: maximal runs of so many characters that credentials are made of.
CANDIDATE_CHARS = 16
RUN = re.compile(f"[A-Za-z0-9+/_.=-]{{{CANDIDATE_CHARS},}}")
#: Strings to learn from: so many labelled ones of each kind and other candidates, by the least hash, none longer than this.
LEARNED = 400
ORDINARY = 4000
LEARNED_CHARS = 128
#: A candidate is explained better than an ordinary run by so many bits per character at least.
MARGIN = 0.5
#: Significance of the test by which states count as different.
ALPHA = 0.05
ALPHABET = 67


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns. ``runs``: the candidate runs, in which the last two kinds lie."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_CHARS]
    for a, b in runs:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_CHARS]
        if b - a >= HEX_CHARS:
            found += [(*m.span(), "hex") for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_CHARS]
    return found


# Grammar inference -----------------------------------------------------------------------------


@dataclass
class Automaton:
    """States with the counts of their symbols and the states these lead to; state 0 is the start."""
    seen: list[int] = field(default_factory=list)
    symbols: list[dict[str, int]] = field(default_factory=list)
    then: list[dict[str, int]] = field(default_factory=list)

    def bits(self, text: str) -> float:
        """Log-likelihood per character, in bits. A symbol new to a state is unlikely and does not change the state."""
        state, total = 0, 0.0
        for c in text:
            total += math.log2((self.symbols[state].get(c, 0) + 1 / ALPHABET) / (self.seen[state] + 1))
            state = self.then[state].get(c, state)
        return total / max(len(text), 1)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """A probabilistic automaton: the prefix tree of the strings, with statistically compatible states merged.

    States are taken in the order of the tree. Each is merged into the first settled state whose frequencies, and
    those of the states after both, differ by no more than the Hoeffding bound allows; else it is settled itself.
    """
    passed, ends, counts, then = [0], [0], [{}], [{}]
    for s in strings:
        at = 0
        for c in s:
            passed[at] += 1
            counts[at][c] = counts[at].get(c, 0) + 1
            if c not in then[at]:
                then[at][c] = len(then)
                for column, new in ((passed, 0), (ends, 0), (counts, {}), (then, {})):
                    column.append(new)
            at = then[at][c]
        passed[at] += 1
        ends[at] += 1
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = passed[a], passed[b]
            if differ(ends[a], n, ends[b], m):
                return False
            if any(differ(counts[a].get(c, 0), n, counts[b].get(c, 0), m) for c in {*counts[a], *counts[b]}):
                return False
            todo += [(then[a][c], t) for c, t in then[b].items() if c in then[a]]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            passed[a] += passed[b]
            ends[a] += ends[b]
            for c, k in counts[b].items():
                counts[a][c] = counts[a].get(c, 0) + k
            for c, t in then[b].items():
                if c in then[a]:
                    todo.append((then[a][c], t))
                else:
                    then[a][c] = t

    settled, known = [0], {0}
    while True:
        border = [(t, s, c) for s in settled for c, t in then[s].items() if t not in known]
        if not border:
            break
        state, parent, symbol = min(border)
        for s in settled:
            if compatible(s, state):
                then[parent][symbol] = s
                fold(s, state)
                break
        else:
            settled.append(state)
            known.add(state)
    place = {s: i for i, s in enumerate(settled)}
    return Automaton([passed[s] for s in settled], [counts[s] for s in settled], [{c: place[t] for c, t in then[s].items()} for s in settled])


def _class(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c


_SIZES = {"0": 10, "a": 26, "A": 26}


@dataclass
class Ordinary:
    """What other long runs look like: letter case, digits and marks after each other."""
    pairs: dict[tuple[str, str], int]
    from_: dict[str, int]

    @classmethod
    def of(cls, strings: list[str]) -> Ordinary:
        pairs: dict[tuple[str, str], int] = {}
        from_: dict[str, int] = {}
        for s in strings:
            at = "^"
            for k in map(_class, s):
                pairs[at, k] = pairs.get((at, k), 0) + 1
                from_[at] = from_.get(at, 0) + 1
                at = k
        return cls(pairs, from_)

    def bits(self, text: str) -> float:
        at, total = "^", 0.0
        for k in map(_class, text):
            total += math.log2((self.pairs.get((at, k), 0) + 0.1) / (self.from_.get(at, 0) + 0.8) / _SIZES.get(k, 1))
            at = k
        return total / max(len(text), 1)


@dataclass
class Formats:
    """Automata by kind, the model of other runs, and the score from which a candidate counts."""
    automata: dict[str, Automaton]
    ordinary: Ordinary
    least: float = 0.0

    def score(self, text: str) -> tuple[float, str]:
        """The best kind, by how many bits per character it explains a candidate better than an ordinary run."""
        plain = self.ordinary.bits(text)
        return max(((a.bits(text) - plain, k) for k, a in self.automata.items()), default=(-math.inf, ""))


def _quantile(values: list[float], q: float) -> float:
    values = sorted(values)
    return values[min(len(values) - 1, int(q * len(values)))]


def learn(labelled: dict[str, list[str]], ordinary: list[str]) -> Formats:
    """Automata from four fifths of the labelled strings; the score from which candidates count from the others.

    It is what nearly all labelled strings reach, and ``MARGIN`` at least. Candidates that reach it are not ordinary:
    the model of ordinary runs is fitted again without them, so that it does not matter how many there are.
    """
    fit = {k: [s for i, s in enumerate(v) if i % 5] for k, v in labelled.items()}
    held = [s for v in labelled.values() for s in v[::5]]
    automata, plain = {k: infer(v) for k, v in fit.items() if v}, ordinary
    for _ in range(4):
        formats = Formats(automata, Ordinary.of(plain))
        yes = _quantile([formats.score(s)[0] for s in held], 0.01) if held else math.inf
        formats.least = max(yes, MARGIN)
        left = [s for s in ordinary if formats.score(s)[0] < formats.least]
        if left == plain:
            break
        plain = left
    return formats


# Over documents --------------------------------------------------------------------------------


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def _free_runs(text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidates: runs apart from base spans, without marks at their ends."""
    taken = sorted((a, b) for a, b, _ in base)
    out, i = [], 0
    for a, b in runs:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        while b > a and text[b - 1] in ".=-_/+":
            b -= 1
        while b > a and text[a] in ".=-_/+":
            a += 1
        if b - a >= CANDIDATE_CHARS:
            out.append((a, b))
    return out


def sample_credentials(docs: DataFrame) -> tuple[dict[str, list[str]], list[str]]:
    """Distinct credentials by kind that the fixed patterns label, and other candidates: bounded samples of all documents."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for t in b["text"].to_pylist():
                if not t:
                    continue
                runs = _runs(t)
                base = base_spans(t, runs)
                for a, e, kind in base:
                    value = ASSIGN.match(t, a, e)[2] if kind == "assign" else t[a:e]
                    found.add((kind, value[:LEARNED_CHARS + 1]))
                found |= {("", t[a:e][:LEARNED_CHARS + 1]) for a, e in _free_runs(t, runs, base)}
            found = [(k, v) for k, v in found if len(v) <= LEARNED_CHARS]
            yield pa.record_batch({"kind": pa.array([k for k, _ in found], pa.string()), "value": pa.array([v for _, v in found], pa.string())})

    values = docs.select("text").mapInArrow(extract, "kind string, value string")
    # The group limit of the window keeps the least hashes of each task before anything is shuffled.
    rank = F.dense_rank().over(Window.partitionBy("kind").orderBy("h", "value"))
    least = values.distinct().withColumn("h", F.xxhash64("value")).withColumn("rank", rank)
    least = least.filter(F.col("rank") <= F.lit(ORDINARY)).filter((F.col("kind") == "") | (F.col("rank") <= LEARNED))
    labelled: dict[str, list[str]] = {}
    for kind, value in least.select("kind", "value", "h").distinct().orderBy("kind", "h", "value").drop("h").collect():
        labelled.setdefault(kind, []).append(value)
    return labelled, labelled.pop("", [])


def find_secrets(docs: DataFrame, formats: Formats) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added`` of each document row, without a shuffle.

    The three fixed patterns give the base spans. Every other candidate is scored by the automata, and those
    that reach ``formats.least`` are added as ``like_<kind>``. Null texts count as empty; whole texts are scanned;
    repeated rows stay. Positions are code points, ends exclusive.
    """
    order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def written(spans: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = functools.lru_cache(1 << 17)(formats.score)
        for b in batches:
            rows = []
            for t in b["text"].to_pylist():
                t = t or ""
                runs = _runs(t)
                base = base_spans(t, runs)
                added = []
                for a, e in _free_runs(t, runs, base):
                    value, kind = (score if e - a <= LEARNED_CHARS else formats.score)(t[a:e])
                    if value >= formats.least:
                        added.append((a, e, f"like_{kind}"))
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.record_batch([b["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                  names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind_of_id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Learn the formats from the credentials of the documents themselves, then find secrets in all of them."""
    return find_secrets(docs, learn(*sample_credentials(docs)))
