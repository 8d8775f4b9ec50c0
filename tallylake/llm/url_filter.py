"""URL filtering by a cascade of Bloom filters: exact membership of listed keys without a join.

A rule is a host and a path prefix, written together (``example.com/en/``). It fits its host and all subdomains where the url's path starts with its
path. Every url has few candidate keys: its host's suffixes of as many labels as some rule has, each with its path's prefixes of as many
characters as some rule's path has. Level 1 of a cascade encodes the listed keys; level 2 the candidate keys of the whole corpus
that pass level 1 without being listed; level 3 the listed keys that pass level 2; and so on until a level passes no key wrongly.
A key is listed if the first level that rejects it is an even one. This is exact for every key of the corpus.

Only what wrongly passes level 1 is ever materialised, never the corpus's keys. The size of a cascade follows the list: level 1 has about
1.44 * log2(corpus keys / listed keys) bits a listed key, and its false positives are then about as many as the list. Bits are set in blocks of
``BLOCK`` bytes on the executors, and only finished blocks come to the driver. The levels go into the plan as binary literals of at most ``MOST_BYTES``
each. A list whose level 1 would need more than ``MOST_SEGMENTS`` of them (256 MB, some 100 million keys) is split by a hash of its keys, and the pages are judged
in as many passes: any list is taken whole, and what is sent to the executors at a time is bounded.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; A-Z in hosts are lower-cased; repeated rows
are judged each; among rules of equal length the one with the longer host wins; a rule both blocked and allowed is refused; no rules: all is allowed.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes of a literal (a power of two), literals of a level, and bytes of a block that an executor fills.
MOST_BYTES, MOST_SEGMENTS, BLOCK = 1 << 24, 16, 1 << 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """An array of the keys that may be listed, the longest first (among equals, the longer host)."""
    parts = F.split(host, "\\.")
    suffix = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    keys = [
        F.when(
            (F.size(parts) >= n) & (F.length(path) >= size),
            F.struct((F.length(suffix(n)) + size).alias("size"), F.length(suffix(n)).alias("host_size"), F.concat(suffix(n), F.substring(path, 1, size)).alias("key")),
        )
        for n in labels
        for size in lengths
    ]
    return F.transform(F.sort_array(F.array_compact(F.array(*keys)), asc=False), lambda s: s["key"])


def hashed_bits(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """Double hashing: the level's bit positions of a key. Hashes of 32 bits, so that sums of products stay within a long."""
    one, two = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * level + i)), 32) for i in (0, 1))
    return [F.pmod(one + F.lit(j).cast("long") * two, F.lit(bits).cast("long")) for j in range(hashes)]


def sized(count: int, wrong: float) -> tuple[int, int]:
    """Hashes and bits of a Bloom filter for ``count`` keys and a share ``wrong`` of false positives."""
    hashes = max(1, round(-math.log2(wrong)))
    return hashes, 64 * max(1, math.ceil(count * hashes / math.log(2) / 64))


def first_share(count: int, others: int) -> float:
    """Share of false positives of level 1: they are then about half as many as the list."""
    return min(0.5, count / (2 * max(1, others)))


class Level:
    def __init__(self, keys: DataFrame, level: int, count: int, wrong: float):
        """A Bloom filter over ``keys`` (column ``key``), sized for ``count`` keys and a share ``wrong`` of false positives."""
        self.level = level
        self.hashes, self.bits = sized(count, wrong)
        at = F.explode(F.array(*hashed_bits(F.col("key"), level, self.hashes, self.bits)))
        byte = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at").bitwiseAND(F.lit(7)).cast("int")))
        bytes_set = keys.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(byte.alias("set"))
        placed = F.map_from_entries(F.collect_list(F.struct(F.col("byte").bitwiseAND(F.lit(BLOCK - 1)).cast("int"), F.hex(F.col("set").cast("long")))))
        digits = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.lpad(F.coalesce(F.try_element_at(F.col("placed"), i), F.lit("0")), 2, "0"))
        blocks = bytes_set.groupBy(F.floor(F.col("byte") / BLOCK).alias("block")).agg(placed.alias("placed")).select("block", F.unhex(F.array_join(digits, "")).alias("bytes"))
        table = bytearray(-(-self.bits // 8 // BLOCK) * BLOCK)
        for row in blocks.toLocalIterator():  # the filter's own size, block by block
            table[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["bytes"]
        self.segments = [F.lit(table[i : i + MOST_BYTES]) for i in range(0, len(table), MOST_BYTES)]

    def passes(self, key: Column) -> Column:
        def bit(at: Column) -> Column:
            byte = F.shiftright(at, 3)
            one = lambda table: F.substring(table, (byte.bitwiseAND(F.lit(MOST_BYTES - 1)) + 1).cast("int"), F.lit(1))
            found = one(self.segments[-1])
            for i in range(len(self.segments) - 2, -1, -1):
                found = F.when(byte < (i + 1) * MOST_BYTES, one(self.segments[i])).otherwise(found)
            return F.getbit(F.conv(F.hex(found), 16, 10).cast("int"), at.bitwiseAND(F.lit(7)).cast("int")) == 1

        out = F.lit(True)
        for at in hashed_bits(key, self.level, self.hashes, self.bits):
            out = out & bit(at)
        return out


def distinct_keys(universe: DataFrame) -> int:
    return universe.agg(F.approx_count_distinct("key")).first()[0]


class Cascade:
    """Exact membership of ``listed`` (column ``key``) for every key of ``universe`` (column ``key``, repeats allowed).

    ``size``: about how many keys the universe has; it only sizes level 1.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, size: int | None = None):
        self.levels: list[Level] = []
        inside = checkpointed(listed.select("key").distinct())
        n = inside.count()
        if not n:
            return
        others = max(1, distinct_keys(universe) if size is None else size)
        first = Level(inside, 0, n, first_share(n, others))
        self.levels.append(first)
        passed = universe.select("key").where(first.passes(F.col("key"))).distinct()
        outside = checkpointed(passed.join(inside, "key", "left_anti"))
        included, excluded = inside, outside
        while m := excluded.count():
            level = Level(excluded, len(self.levels), m, 0.5 if len(self.levels) > 1 else 0.25)
            self.levels.append(level)
            included, excluded = excluded, checkpointed(included.where(level.passes(F.col("key"))))

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def in_pass(n: int, passes: int):
    """Whether a key belongs to a pass, as a function of one column."""
    return lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(passes)) == n


def found_in(keys: Column, allowed: Cascade, blocked: Cascade) -> Column:
    """The listed ones of an array of keys, in order, as ``array<struct<key, blocked>>``."""
    told = F.transform(keys, lambda k: F.struct(k.alias("key"), blocked.contains(k).alias("blocked")))
    return F.filter(told, lambda s: s["blocked"] | allowed.contains(s["key"]))


def judged(pages: DataFrame, allow: DataFrame, block: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest one that fits, else null) and ``verdict`` (allow or block).

    ``allow`` and ``block`` have the columns ``host`` and ``path`` of their rules.
    """
    rules = allow.select("host", "path").unionByName(block.select("host", "path"))
    shape = rules.select(F.collect_set(F.size(F.split("host", "\\."))), F.collect_set(F.length("path"))).first()
    host, path = host_and_path(F.col(url).cast("string"))
    cut = pages.withColumns({"host": host, "path": path})
    if not shape[0]:
        return cut.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys = candidates(F.col("host"), F.col("path"), sorted(shape[0]), sorted(shape[1]))
    universe = cut.select(F.explode(keys).alias("key"))
    as_keys = lambda df: df.select(F.concat("host", "path").alias("key"))
    both = as_keys(allow).join(as_keys(block), "key", "left_semi")
    if not both.isEmpty():
        raise ValueError("a rule is both allowed and blocked")
    size = distinct_keys(universe)
    listed = rules.select(F.concat("host", "path")).distinct().count()
    passes = -(-sized(listed, first_share(listed, size))[1] // (8 * MOST_BYTES * MOST_SEGMENTS))
    hits = "url_filter_hits"
    while hits in pages.columns:
        hits += "_"
    out = cut.withColumn(hits, F.lit([]).cast("array<struct<key:string,blocked:boolean>>"))
    for n in range(passes):
        mine = in_pass(n, passes)
        of = lambda df: df.where(mine(F.col("key")))  # noqa: B023, E731
        allowed, blocked = (Cascade(of(as_keys(x)), of(universe), size // passes) for x in (allow, block))
        found = found_in(F.filter(keys, mine), allowed, blocked)
        out = out.withColumn(hits, F.concat(hits, found))
        out = checkpointed(out) if n + 1 < passes else out
    # The longest key first, as ``keys`` has them; with several passes each of them found its own.
    ordered = F.col(hits) if passes == 1 else F.filter(F.transform(keys, lambda k: F.get(F.filter(hits, lambda s: s["key"] == k), 0)), lambda s: s.isNotNull())
    out = out.withColumn(hits, F.try_element_at(ordered, F.lit(1)))
    return out.withColumns({"rule": F.col(hits)["key"], "verdict": F.when(F.col(hits)["blocked"], "block").otherwise("allow")}).drop(hits)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string")
