"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ, and their connected components.

Candidate pairs come from pigeonring filtering. The 64 bits form a ring of 4 segments of 16 bits. If two fingerprints
differ in at most 3 bits, some segment starts a chain whose first l segments differ in at most 3 * l / 4 bits for every l:
0 bits in the first, at most 1 in the first two, at most 2 in the first three. So fingerprints are indexed by each pair of
consecutive segments, and probe that index with the first segment as it is and the second one with at most one bit cleared (of two
fingerprints that differ in one bit there, one has it set and meets the other by clearing it);
the chain of three and the full Hamming distance are checked on what meets.

A group of many fingerprints that share two segments is never expanded into pairs. Its members and probes are linked
through common neighbours instead: each emits the codes within one flipped bit of the other 32 bits (members also those within two),
and those that share a code are linked to one of them, the centre, which has the code within one bit. So a member is within 2 + 1 bits of the centre
and a probe, whose key differs in one bit, within 1 + 1 + 1: every link made is a true one. And two members within 3 bits share a code that lies one bit from
one and two from the other, a member and a probe within 3 bits one that lies one bit from both: every true link is made, by way of the
centre. So the components are the same on both ways, and the work grows with the group, not with its square.

Cases: a text without words (null or empty too) has fingerprint zero and links like any other; equal texts share a
fingerprint and so a component; repeated rows of a doc_id are kept each; rows with a null doc_id get a component too (null where it
holds no other id); an empty table gives an empty table; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_skewed

SEGMENTS, WIDTH, BITS = 4, 16, 3
LOW32, LOW16 = (1 << 32) - 1, (1 << 16) - 1
#: Fingerprints that may share an index key and still be compared pair by pair.
DENSE = 64


def simhash(text: str, shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half the shingles' XXH64 hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    last = min(shingle, len(words)) - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        to = min(n, at + block)
        pairs = zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)
        hashes = np.fromiter([digest(line[a:b], seed) for a, b in pairs], "<u8", to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("bigint")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t, shingle, seed) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return hashed(F.coalesce(text, F.lit("")))


def turned(fp: Column, segment: int) -> Column:
    """``fp`` rotated so that ``segment`` is the lowest one."""
    by = segment * WIDTH
    return fp if not by else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by))


def low(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def ring(fp: Column) -> Column:
    """An array with one struct per segment: its number and the fingerprint turned to it."""
    return F.array(*(F.struct(F.lit(i).alias("segment"), turned(fp, i).alias("turned")) for i in range(SEGMENTS)))


def flips(lowest: int, highest: int, times: int) -> list[int]:
    """Masks of at most ``times`` bits out of ``lowest`` .. ``highest - 1``, as signed longs."""
    masks = {0}
    for _ in range(times):
        masks |= {m | 1 << b for m in masks for b in range(lowest, highest)}
    return sorted(m - (1 << 64) if m >> 63 else m for m in masks)


def exploded_flips(rows: DataFrame, source: str, out: str, masks: list[int]) -> DataFrame:
    """``rows`` once for each mask, with ``source`` xor the mask in ``out``."""
    mask = F.explode(F.lit(masks))
    return rows.withColumn("mask", mask).withColumn(out, F.col(source).bitwiseXOR(F.col("mask").cast("long"))).drop("mask")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges ``(a, b)`` over the distinct fingerprints ``fp``: they join exactly what chains of links within 3 bits join.

    Every pair of fingerprints within 3 bits is an edge, but for pairs inside a dense group, which are joined through a common third.
    """
    turned_rows = fps.select("fp", F.explode(ring(F.col("fp"))).alias("r")).select("fp", "r.segment", "r.turned")
    index = turned_rows.withColumn("key", low(F.col("turned"), LOW32))
    sizes = index.groupBy("segment", "key").agg(F.count("*").alias("size"))
    crowded = checkpointed(sizes.where(F.col("size") > dense).select("segment", "key"))
    flipped = exploded_flips(turned_rows, "turned", "flipped", flips(WIDTH, 2 * WIDTH, 1)).where(F.col("flipped").bitwiseAND(F.col("turned")) == F.col("flipped"))
    probes = flipped.withColumn("key", low(F.col("flipped"), LOW32)).drop("flipped")
    if crowded.isEmpty():
        return close_pairs(index, probes)
    sparse_index, dense_index = index.join(crowded, ["segment", "key"], "left_anti"), index.join(crowded, ["segment", "key"], "left_semi")
    dense_probes = probes.where(F.col("key") != low(F.col("turned"), LOW32)).join(crowded, ["segment", "key"], "left_semi")
    return close_pairs(sparse_index, probes).unionByName(dense_links(dense_index, dense_probes)).distinct()


def close_pairs(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs that meet in the index, whose chain of three segments differs in at most 2 bits, and all of it in at most 3."""
    met = index.select("segment", "key", F.col("fp").alias("b"), F.col("turned").alias("other")).join(probes.select("segment", "key", F.col("fp").alias("a"), "turned"), ["segment", "key"])
    differ = F.col("turned").bitwiseXOR(F.col("other"))
    met = met.where(F.col("a") != F.col("b")).where(F.bit_count(low(differ, (1 << 48) - 1)) <= BITS - 1).where(F.bit_count(differ) <= BITS)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def dense_links(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Links within groups of fingerprints that share a key, through codes near their other 32 bits.

    Members that share a code with a member one flip away are within 3 bits of it; a probe, which already differs in one bit of the key,
    is so if it is one flip away too. Two members within 3 bits, or a member and a probe, always share such a code.
    """
    rest = [m for m in flips(32, 64, 1)]
    two = sorted(set(flips(32, 64, 2)) - set(rest))
    high = lambda df: df.withColumn("high", F.col("turned").bitwiseAND(F.lit(~LOW32).cast("long")))
    members, probes = high(members), high(probes)
    near = exploded_flips(members, "high", "code", rest).withColumn("near", F.lit(True))
    coded = near.unionByName(exploded_flips(members, "high", "code", two).withColumn("near", F.lit(False)))
    centre = near.groupBy("segment", "key", "code").agg(F.min("fp").alias("a"))
    at_probe = exploded_flips(probes, "high", "code", rest)
    ends = coded.select("segment", "key", "code", "fp").unionByName(at_probe.select("segment", "key", "code", "fp"))
    out = ends.join(centre, ["segment", "key", "code"]).where(F.col("a") != F.col("fp"))
    return out.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: root is the smallest node of its component.

    Large-star and small-star steps in turn until the edges stay as they are; each round is checkpointed.
    """
    edges = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = signature(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = join_skewed(both.where(F.col("b") > F.col("a")), least, "a").select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        lower = join_skewed(edges, least, "b").where(F.col("a") != F.col("m")).select(F.col("m"), F.col("a").alias("b"))
        edges = checkpointed(lower.unionByName(least.select("m", "b")).select(F.col("m").alias("a"), "b").distinct())
        before, state = state, signature(edges)
        if before == state:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", dense: int = DENSE) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id it reaches."""
    rows = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text).cast("string")).alias("fp")))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps.select("fp"), dense))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = join_skewed(rooted.select("fp", "root"), smallest, "root").select("fp", "component_id")
    return join_skewed(rows, table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
