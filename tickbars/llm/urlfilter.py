"""URL filters by a Bloom filter cascade: exact membership over a known universe of keys, without joins."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickbars.llm.common import stored

#: Rules (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Bits of one filter; a level that needs more has several, told apart by a hash of the key.
FILTER_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


# The cascade -------------------------------------------------------------------------------------


@dataclass
class _Level:
    """A Bloom filter as words of 64 bits. One filter is one array; more are rows ``(shard, words)``."""
    seed: int
    bits: int
    hashes: int
    shards: int
    table: DataFrame

    def positions(self, key: Column) -> list[Column]:
        """Places of a key, by other hashes at each level."""
        return [F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.shards))

    def holds(self, key: Column, words: Column) -> Column:
        tests = [F.getbit(words[F.shiftright(p, 6).cast("int")], p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self.positions(key)]
        return functools.reduce(Column.__and__, tests)


def _level(keys: DataFrame, n: int, false_share: float, seed: int, filter_bits: int) -> _Level:
    bits = max(64, math.ceil(n * -math.log(false_share) / math.log(2) ** 2))
    shards = -(-bits // filter_bits)
    level = _Level(seed, -(-bits // (64 * shards)) * 64, max(1, round(-math.log2(false_share))), shards, keys)
    place = keys.select(level.shard(F.col("key")).alias("shard"), F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    place = place.select("shard", F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bits"))
    blank = keys.sparkSession.range(level.bits // 64 * shards).select(
        (F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("w"), F.lit(0).cast("long").alias("bits"))
    words = place.unionByName(blank).groupBy("shard", "w").agg(F.bit_or("bits").alias("bits"))
    lists = words.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("words"))
    level.table = stored(lists.select("shard", F.expr("transform(words, x -> x.bits)").alias("words")))
    return level


class Cascade:
    """Which keys of a universe are listed, exactly.

    Level 1 encodes the listed keys; each further level encodes the keys that the level before wrongly holds, until
    none is left. A key is listed if the first level that does not hold it is an even one. ``universe`` has a row
    ``(key, listed)`` for every key that will be asked, repeats allowed; keys outside it may get either answer.
    One filter has at most ``filter_bits`` bits and is read as a single value, without a join. A level that needs
    more is cut into filters of that size, and keys find theirs by an equi-join on its number.
    """

    def __init__(self, universe: DataFrame, filter_bits: int = FILTER_BITS, most_levels: int = 64) -> None:
        keys = stored(universe.groupBy("key").agg(F.max("listed").alias("listed")))
        inside, outside = keys.filter("listed").select("key"), keys.filter(~F.col("listed")).select("key")
        n, against = inside.count(), outside.count()
        self.levels: list[_Level] = []
        while n:
            if len(self.levels) == most_levels:
                raise RuntimeError(f"keys are still mixed up after {most_levels} levels")
            # The first filter is as sharp as the sizes of the two sides call for, the others halve what is left.
            share = min(0.5, max(1e-6, n / (math.sqrt(2) * max(against, 1)))) if not self.levels else 0.5
            level = _level(inside, n, share, len(self.levels) + 1, filter_bits)
            self.levels.append(level)
            rest = stored(self._holding(outside, level))
            inside, outside = rest, inside
            n = inside.count()

    @staticmethod
    def _holding(keys: DataFrame, level: _Level) -> DataFrame:
        if level.shards == 1:
            return keys.filter(level.holds(F.col("key"), level.table.select("words").scalar()))
        rows = keys.withColumn("shard", level.shard(F.col("key"))).join(level.table, "shard")
        return rows.filter(level.holds(F.col("key"), F.col("words"))).select("key")

    def add_listed(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the key of the row is listed."""
        columns = list(df.columns)
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            if level.shards == 1:
                words = level.table.select("words").scalar()
            else:
                own, words = f"__shard{i}", F.col(f"__words{i}")
                table = level.table.select(F.col("shard").alias(own), F.col("words").alias(f"__words{i}"))
                df = df.withColumn(own, level.shard(key)).join(table, own)
            answer = F.when(level.holds(key, words), answer).otherwise(F.lit(i % 2 == 1))
        return df.withColumn(name, answer).select(*columns, name)


# Rules over hosts and paths ----------------------------------------------------------------------


def judge(pages: DataFrame, blocked: Column, rules: tuple[tuple[str, str, str], ...] = RULES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page row.

    The longest rule that fits decides (at one length, allow before block). Where none fits, a page is blocked if
    its host and path are listed, as they are when ``blocked`` holds for any page that has them. Rules of both
    kinds and the list are in one cascade, over the keys that the pages can ask for. Null urls and those without
    ``://`` have empty host and path, fit no rule and are not listed, so they are allowed. Repeated rows stay.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(blocked, F.lit(False)).alias("blocked"))
    labels, lengths = sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(p) for _, _, p in rules})
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    tails = {n: F.substring_index("host", ".", -n) for n in labels}
    # A rule's host has so many labels and its path so many characters: only such keys are asked for.
    fits = [(F.concat(tails[n], F.substring("path", 1, m)), (dots >= n - 1) & (F.length("path") >= m)) for n in labels for m in lengths]
    asked = F.filter(F.array(*[F.when(ok, key) for key, ok in fits]), lambda k: k.isNotNull())
    rows = rows.withColumn("asked", asked).withColumn("own", F.concat(F.lit("list "), F.col("host"), F.col("path")))

    spark = pages.sparkSession
    listed = spark.createDataFrame([(f"{verdict} {h}{p}", True) for verdict, h, p in rules], "key string, listed boolean")
    kinds = F.flatten(F.transform("asked", lambda k: F.array(F.concat(F.lit("allow "), k), F.concat(F.lit("block "), k))))
    candidates = rows.select(F.explode(kinds).alias("key"), F.lit(False).alias("listed"))
    own = rows.select(F.col("own").alias("key"), (F.col("blocked") & (F.col("host") != "")).alias("listed"))
    cascade = Cascade(candidates.unionByName(own).unionByName(listed), filter_bits)

    found = cascade.add_listed(rows, F.col("own"), "in_list")
    rules_found = []
    for i in range(len(fits)):
        for verdict in ("allow", "block"):
            key, name = F.concat(F.lit(f"{verdict} "), F.get("asked", F.lit(i))), f"is_{verdict}_{i}"
            found = cascade.add_listed(found, F.coalesce(key, F.lit("")), name)
            hit = F.col(name) & key.isNotNull()
            rules_found.append(F.when(hit, F.struct(F.length(F.get("asked", F.lit(i))).alias("n"), F.lit(verdict == "allow").alias("allow"), F.get("asked", F.lit(i)).alias("rule"))))
    best = F.array_max(F.array(*rules_found))
    verdict = F.when(F.col("best").isNull(), F.when(F.col("in_list"), "block").otherwise("allow")).otherwise(F.when(F.col("best.allow"), "allow").otherwise("block"))
    return found.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
