"""URL verdicts by Bloom filter cascades.

A rule is a host and a path prefix, written together (``example.net/en/``); it fits its host and all
subdomains where the url's path starts with the rule's. What rules can match of a url are a few keys:
for each shape that rules have (labels of the host, characters of the path) the host's last labels and
the path's first characters. All keys of all urls are the complete universe.

A cascade encodes a list over that universe. Level 1 is a Bloom filter of the listed keys; level 2 holds
the universe's unlisted keys that pass level 1, level 3 the listed keys that pass level 2, and so on until
no false positive is left. The first level that rejects a key tells whether it is listed; the answer is
exact for every key of the universe, without a join. Level 1 has a false positive rate in proportion to
listed keys per key of the universe, the others one half, so the filters grow with the list and only with
the logarithm of the universe; their size is checked before they become constants of the plan.

Results: a null url, or one without ``://``, has an empty host and path and fits no rule. Very long urls are
judged whole. Of rules as long, the one with the longer host decides. Repeated rows
are judged each. An empty table gives no rows. Columns of the input other than the url and those asked for
are not read, so their names cannot clash. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.runtime import materialize

#: Bits of all levels of a cascade, at most (8 MB); more listed keys than that are an error, not a loss.
MOST_BITS = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        """Whether the filter may hold the key."""
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant, which stands once
        places = F.array(*[_position(key, self.seed, i, self.bits) for i in range(self.hashes)])
        return F.forall(places, lambda at: self._bit(held, at))

    @staticmethod
    def _bit(words: Column, at: Column) -> Column:
        word = F.element_at(words, F.shiftright(at, 6).cast("int") + 1)
        return F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int"))) == 1


def _position(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long"))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact membership for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[n].passes(key), F.lit(n % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def _level(keys: DataFrame, count: int, rate: float, seed: int, room: int = MOST_BITS) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(count * -math.log2(rate) / math.log(2) / 64))
    if bits > room:
        raise ValueError(f"the list needs filters of over {MOST_BITS} bits in all")
    at = F.explode(F.array(*[_position(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word"))
    rows = words.agg(F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("set")).collect()  # bits / 64 rows at most
    held = [0] * (bits // 64)
    for r in rows:
        held[r["word"]] = r["set"]
    return Level(seed, bits, hashes, tuple(held))


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` (key) over ``universe`` (key), both without nulls and each key once."""
    listed = materialize(listed.select("key"), "listed")
    n = listed.count()
    if not n:
        return Cascade((Level(1, 64, 1, (0,)),))
    total = max(universe.count(), 1)
    levels = [_level(listed, n, min(0.5, math.sqrt(0.5) * n / total), 1)]
    passing = universe.where(levels[0].passes(F.col("key"))).select("key", F.lit(0).alias("own"))
    both = passing.unionByName(listed.withColumn("own", F.lit(1)))
    wrong = both.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key")
    encoded, other = listed, materialize(wrong, "wrong")
    while (count := other.count()) > 0:
        levels.append(_level(other, count, 0.5, len(levels) + 1, MOST_BITS - sum(x.bits for x in levels)))
        encoded, other = other, materialize(encoded.where(levels[-1].passes(F.col("key"))), "wrong")
    return Cascade(tuple(levels))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shape(rule: str) -> tuple[int, int]:
    name, slash, rest = rule.partition("/")
    return name.count(".") + 1, len(slash + rest)


def _key(shape: tuple[int, int], name: Column, rest: Column) -> Column:
    """The url's key of a shape; null if its host or path is too short."""
    labels, n = shape
    suffix = F.substring_index(name, ".", -labels)
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    return F.when((dots >= labels - 1) & (F.length(rest) >= n) & (name != ""), F.concat(suffix, F.substring(rest, 1, n)))


def judge(pages: DataFrame, block: list[str], allow: list[str], listed: list[str], keep: list[str], url: str = "url") -> DataFrame:
    """``keep`` columns with host, path, rule, verdict and ``listed``.

    The longest of the rules ``block`` and ``allow`` that fits decides (of equal ones, the one with the longer host).
    Where none fits, ``listed`` keys (hosts to block, a path may follow) decide; else the url is allowed.
    """
    spark = pages.sparkSession
    lists = {"block": block, "allow": allow, "listed": listed}
    parts = pages.select(*[F.col(f"`{c}`") for c in keep], host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    shapes = sorted({_shape(r) for rules in lists.values() for r in rules})
    keys = {s: _key(s, F.col("host"), F.col("path")) for s in shapes}
    found = parts.select(F.explode(F.array(*keys.values()) if keys else F.array().cast("array<string>")).alias("key")).where("key is not null").distinct()
    universe = materialize(found, "universe")
    hits = {}
    for name, rules in lists.items():
        known = F.array(*[F.lit(r) for r in sorted(set(rules))]).cast("array<string>")
        cascade = build(spark.range(1).select(F.explode(known).alias("key")), universe)
        hits[name] = [F.when(cascade.holds(keys[s]), keys[s]) for s in sorted({_shape(r) for r in rules})]

    def entry(key: Column, verdict: str) -> Column:
        return F.when(key.isNotNull(), F.struct(F.length(key).alias("n"), F.instr(F.concat(key, F.lit("/")), "/").alias("h"), key.alias("rule"), F.lit(verdict).alias("verdict")))

    rules = [entry(k, v) for v in ("allow", "block") for k in hits[v]]
    best = F.array_max(F.array(*rules)) if rules else F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>")
    by_list = F.coalesce(*hits["listed"], F.lit(None).cast("string")) if hits["listed"] else F.lit(None).cast("string")
    judged = parts.withColumn("__best", best).withColumn("listed", by_list)
    own = F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", own).alias("verdict"), "listed")
