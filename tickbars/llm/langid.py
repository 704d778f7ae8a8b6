"""Language identification by interpolated Kneser-Ney models over characters."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 5
#: What is learned from: so many documents of each language, by the least hash of their ids, and so many characters
#: of each, from a place that hangs on its id. Every fourth of them calibrates the rejection and is not counted.
LEARNED_DOCS = 400
LEARNED_CHARS = 8000
#: Groups in which the documents of one language are ranked first, so that no task sees them all.
SALTS = 64
#: Characters scored at once, and places of the table of scores known already.
SLICE = 1 << 18
KNOWN_BITS = 18
#: The score of a document is the probability of its language given so many independent characters at most.
EVIDENCE = 50
#: A document is rejected if its entropy is this many times as far from its language as this share of the calibration
#: documents, and by so many bits at least, so that a small calibration set does not reject clean documents. Beyond
#: the share may be foreign passages and wrong labels.
TOLERANCE = 3.0
CALIBRATED = 0.9
LEAST_GAP = 1.5
NONE = "und"

_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def codes(text: str) -> np.ndarray:
    """Lower-case letters with a 0 for each run of anything else, and at both ends."""
    raw = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    raw = np.concatenate(([0], raw, [0])).astype(np.uint32)
    return raw[(raw != 0) | np.r_[True, raw[:-1] != 0]]


def has_letter(c: np.ndarray) -> bool:
    return len(c) > 1


def padded(c: np.ndarray) -> np.ndarray:
    """With borders in front, so that the first letters have a whole context."""
    return np.concatenate((np.zeros(ORDER - 2, dtype=np.uint32), c))


def ngram_hashes(c: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``n`` characters that end at each position, or at those given. ``n`` = 0 gives one value."""
    with np.errstate(over="ignore"):
        places = np.arange(len(c)) if at is None else at
        h = np.full(len(places), n + 1, dtype=np.uint64)
        power = 1
        for k in range(n):
            power = power * _P & (1 << 64) - 1
            part = c[:len(c) - k] if at is None else c[at - k]
            if at is None:
                h[k:] += part.astype(np.uint64) * np.uint64(power)
            else:
                h += part.astype(np.uint64) * np.uint64(power)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


@dataclass
class _Counts:
    """Distinct n-grams of one order in one language, sorted by hash, with probability and what they follow."""
    grams: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    gamma: np.ndarray


def _estimate(c: np.ndarray, places: np.ndarray, symbols: int) -> list[_Counts]:
    """Interpolated Kneser-Ney estimates of orders 1 to ``ORDER`` over the positions ``places`` of ``c``.

    The highest order counts occurrences; the others count in how many different contexts an n-gram comes.
    """
    found, at = [], places
    for n in range(ORDER, 0, -1):
        h = ngram_hashes(c, n, at)
        grams, first, count = np.unique(h, return_index=True, return_counts=True)
        at = at[first]  # one place for each distinct n-gram: what the next order counts
        found.append((n, grams, at, count))
    out: list[_Counts] = []
    for n, grams, at, count in reversed(found):
        context, shorter = ngram_hashes(c, n - 1, at - 1), ngram_hashes(c, n - 1, at)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        contexts, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, weights=count)
        gamma = discount * np.bincount(of) / total
        lower = out[-1].p[np.searchsorted(out[-1].grams, shorter)] if out else 1 / symbols
        p = (count - discount) / total[of] + gamma[of] * lower
        out.append(_Counts(grams, context, shorter, p, contexts, gamma))
    return out


class Model:
    """All languages in sorted hash arrays, one per order: n-grams that any language has, with the logarithm of
    their probability in each; and contexts, with that of the weight each language leaves to shorter ones."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        if not texts:  # nothing to learn from
            self._forget()
            return
        held = {lang: [t for i, t in enumerate(own) if i % 4 == 3] for lang, own in texts.items()}
        parts = {lang: [padded(codes(t)) for i, t in enumerate(own) if i % 4 != 3] for lang, own in texts.items()}
        symbols = len(np.unique(np.concatenate([c for own in parts.values() for c in own]))) + 1
        counted = []
        for lang in self.languages:
            own = parts[lang]
            starts = np.cumsum([0, *map(len, own)])
            places = np.concatenate([np.arange(a + ORDER - 1, b) for a, b in zip(starts, starts[1:])])
            counted.append(_estimate(np.concatenate(own), places, symbols))
        self.grams, self.logp, self.contexts, self.gamma = [], [], [], []
        k = len(self.languages)
        for n in range(ORDER):
            grams, first = np.unique(np.concatenate([x[n].grams for x in counted]), return_index=True)
            context, shorter = (np.concatenate([getattr(x[n], f) for x in counted])[first] for f in ("context", "shorter"))
            contexts = np.unique(np.concatenate([x[n].contexts for x in counted]))
            gamma = np.zeros((len(contexts), k), dtype=np.float32)
            for j, x in enumerate(counted):
                gamma[np.searchsorted(contexts, x[n].contexts), j] = np.log2(x[n].gamma)
            lower = self.logp[-1][np.searchsorted(self.grams[-1], shorter)] if n else np.full((len(grams), k), -np.log2(symbols), dtype=np.float32)
            logp = gamma[np.searchsorted(contexts, context)] + lower
            for j, x in enumerate(counted):
                logp[np.searchsorted(grams, x[n].grams), j] = np.log2(x[n].p)
            self.grams.append(grams)
            self.logp.append(logp.astype(np.float32))
            self.contexts.append(contexts)
            self.gamma.append(gamma)
        self.unknown = np.full(k, -np.log2(symbols), dtype=np.float32)
        self._forget()
        self.center, self.spread = np.zeros(k), np.full(k, np.inf)
        for j, lang in enumerate(self.languages):
            found = [(h[j], n) for h, n in map(self.entropies, map(codes, held[lang])) if n]
            if found:
                h, n = np.array(found).T
                self.center[j] = np.median(h)
                self.spread[j] = TOLERANCE * max(np.quantile((h - self.center[j]) / self._scale(n), CALIBRATED), 0.1)

    @staticmethod
    def _scale(n):
        """How far the entropy of a text of n characters may stray, up to a factor: short texts stray further."""
        return np.sqrt(1 / np.maximum(n, 1) + 1e-3)

    def _forget(self) -> None:
        self.known = np.zeros(1 << KNOWN_BITS, dtype=np.uint64)
        self.scores = np.zeros((1 << KNOWN_BITS, len(self.languages)), dtype=np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores")}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self._forget()

    def _looked_up(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the characters at the places: the longest known n-gram, and a factor for each shortening."""
        out = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            h = ngram_hashes(c, n, at[left])
            grams = self.grams[n - 1]
            i = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            hit = grams[i] == h
            out[left[hit]] += self.logp[n - 1][i[hit]]
            left = left[~hit]
            if not len(left):
                return out
            h = ngram_hashes(c, n - 1, at[left] - 1)
            contexts = self.contexts[n - 1]
            i = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
            hit = contexts[i] == h
            out[left[hit]] += self.gamma[n - 1][i[hit]]
        out[left] += self.unknown
        return out

    def _position_scores(self, c: np.ndarray) -> np.ndarray:
        """Per position from ``ORDER - 1`` on; n-grams met before come from a table of bounded size."""
        h = ngram_hashes(c, ORDER)[ORDER - 1:]
        slot = (h >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        new = np.flatnonzero(self.known[slot] != h)
        out = self.scores[slot]
        if len(new):
            grams, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            found = self._looked_up(c, new[first] + ORDER - 1)
            out[new] = found[of]
            self.known[slot[new[first]]], self.scores[slot[new[first]]] = grams, found
        return out

    def entropies(self, c: np.ndarray) -> tuple[np.ndarray, int]:
        """Bits per character in each language, and the number of characters; of a text without letters nothing."""
        if not has_letter(c):
            return np.zeros(len(self.languages)), 0
        c, total = padded(c), np.zeros(len(self.languages))
        for at in range(ORDER - 1, len(c), SLICE):
            total -= self._position_scores(c[at - ORDER + 1:at + SLICE]).sum(axis=0, dtype=np.float64)
        n = len(c) - ORDER + 1
        return total / n, n

    def entropies_of(self, texts: Iterable[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for ``n`` texts, the short ones together; no more than a slice of them is held at a time."""
        out, sizes = np.zeros((n, len(self.languages))), np.zeros(n, dtype=np.int64)
        batch: list[int] = []
        joined: list[np.ndarray] = []

        def run() -> None:
            starts = np.cumsum([0, *map(len, joined)])[:-1]
            scores = self._position_scores(np.concatenate(joined))
            # The first places of a text see the end of the one before; they are set aside.
            aside = (starts[1:, None] + np.arange(ORDER - 1) - (ORDER - 1)).ravel()
            scores[aside] = 0
            out[batch] = -np.add.reduceat(scores, np.maximum(starts - (ORDER - 1), 0), axis=0, dtype=np.float64)
            sizes[batch] = [len(x) - ORDER + 1 for x in joined]
            batch.clear()
            joined.clear()

        held = 0
        for i, c in enumerate(texts):
            if not has_letter(c):
                continue
            if len(c) > SLICE:
                out[i], sizes[i] = self.entropies(c)
                out[i] *= sizes[i]
                continue
            batch.append(i)
            joined.append(padded(c))
            held += len(c)
            if held > SLICE:
                run()
                held = 0
        if batch:
            run()
        return out / np.maximum(sizes, 1)[:, None], sizes

    def classify(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.languages:
            return pd.DataFrame({"lang_pred": [NONE] * len(texts), "score": 0.0, "rejected": True, "entropy": np.nan})
        h, n = self.entropies_of((codes(t or "") for t in texts), len(texts))
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp2(-(h - least[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
        far = least - self.center[best] > np.maximum(self.spread[best] * self._scale(n), LEAST_GAP)
        none = n == 0
        return pd.DataFrame({
            "lang_pred": np.where(none, NONE, np.array(self.languages, dtype=object)[best]),
            "score": np.where(none, 0.0, score), "rejected": far | none, "entropy": np.where(none, np.nan, least)})


# Over documents ----------------------------------------------------------------------------------


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """A model of all languages in ``lang``, from a bounded sample of the documents of each that are not held out.

    Rows with a null lang, text or doc_id, and texts without a letter, teach nothing. Which documents are taken, and which
    slice of a long one, depends on their ids alone; only ids and then the chosen slices come to the driver. The
    model grows with the number of languages, not of documents.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike("\\p{L}")) \
        .select("doc_id", "lang", "text")
    ids = usable.select("doc_id", "lang").distinct().withColumn("salt", F.crc32(F.col("doc_id").cast("string")) % SALTS)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    for keys in (("lang", "salt"), ("lang",)):
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= LEARNED_DOCS).drop("place")
    chosen = ids.groupBy("lang").agg(F.collect_list("doc_id").alias("ids"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    wanted = sorted({i for row in chosen for i in row.ids})
    texts: dict[str, list[str]] = {}
    if wanted:
        spare = F.greatest(F.length("text") - LEARNED_CHARS, F.lit(0))
        piece = F.substring("text", (F.pmod(F.xxhash64("doc_id"), spare + 1) + 1).cast("int"), F.lit(LEARNED_CHARS))
        rows = usable.filter(F.col("doc_id").isin(wanted)).select("lang", "doc_id", piece.alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
        for lang, _, text in rows.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect():
            texts.setdefault(lang, []).append(text)
    return Model(texts)


def predicted(model: Model, spark) -> Column:
    """Column ``struct(lang_pred, score, rejected, entropy)`` of the column ``text``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean, entropy double")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield shared.value.classify(part.tolist())

    # Else the planner would run it once for the filter on its result and again for the result.
    return classify.asNondeterministic()(F.col("text"))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, entropy`` of each document row.

    The language is the one with the lowest cross-entropy per character over the whole text. A null text, or one
    without a letter, is ``und`` with score 0. ``rejected``: such texts, and those whose entropy is further from
    their language than calibration allows. If nothing can be learned, all are ``und``. Repeated rows stay.
    """
    rows = docs.select("doc_id", "text")
    found = rows.select("doc_id", held_out().alias("held_out"), predicted(train(docs), docs.sparkSession).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.rejected", "x.entropy")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns; a null lang becomes the one found."""
    found = docs.withColumn("__found", predicted(train(docs), docs.sparkSession)).filter(~F.col("__found.rejected"))
    lang = F.coalesce(F.col("lang"), F.col("__found.lang_pred"))
    return found.withColumn("lang", lang).select(*docs.columns)
