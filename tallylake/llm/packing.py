"""Best-fit packing of token pieces into sequences of a fixed capacity, by a linear grouping scheme.

1. Documents become pieces: ids of the whole text and an end id; only documents over the capacity are cut.
2. A histogram of piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver, where the packing is planned:
   large lengths are split into groups of equal cardinality and rounded up to the largest of their group, the best configurations of
   these few sizes are found by column generation, the configurations' slots are given to the actual lengths of each group, and small lengths go
   best-fit into the room that is left. Of a few bounds between large and small the one with the fewest sequences is taken. Runs of alike sequences are planned as one, so the plan's size depends on the capacity alone.
3. Every piece is ranked among the pieces of its length, in groups of about ``RANKED`` whose offsets come from running sums over groups of groups, and reads its
   place off the broadcast plan.

Cases: a null or empty text is one piece of one token (the end id); pieces of equal length take their places in an order that a hash of their row fixes; repeated
rows are packed each; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BoundedCache, checkpointed
from .pretokens import spelled, word_splitter

CAPACITY = 2048
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 48
#: Lengths up to such a part of the capacity are small; the plan with the fewest sequences is taken.
SMALL = (1 / 4, 1 / 3, 1 / 2)
#: Pieces that are ranked together, and groups of them whose sizes are summed together.
RANKED, SUMMED = 1_000, 1_000


# ---- pieces ------------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of whole texts by a tokenizers .json vocabulary; pre-tokens that are not in the bounded cache go to the library's model."""

    def __init__(self, path: str):
        self.splitter = word_splitter(path)
        self.model = self.splitter.tokenizer.model
        self.packed = BoundedCache(self.pack)

    def pack(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(spelled(word))], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        parts = []
        for words, special in self.splitter.segments(text):
            parts.extend(map(self.packed.__getitem__, words))
            if special is not None:
                parts.append(np.array([special], "<u4").tobytes())
        return b"".join(parts)


@lru_cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def pieces(text: Column, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> Column:
    """The pieces of a text column, as an array of structs: number, ids before it, length and CRC-32 of its ids."""

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        of, end, step = encoder(vocabulary), end_id.to_bytes(4, "little"), 4 * capacity
        ns, rows = [0], []
        for t in texts.to_pylist():
            ids = of(t) + end
            rows += [(i, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]
            ns.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ns, pa.int32()), values)

    return cut(F.coalesce(text, F.lit("")))


# ---- the plan, on histograms ------------------------------------------------------------------------------------------


def grouped(lengths: list[int], counts: list[int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping of ``lengths`` (descending): groups of equal cardinality, each with its largest length and its (length, count) runs."""
    per = -(-sum(counts) // max(1, groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, n in zip(lengths, counts, strict=True):
        while n:
            if not room:
                out.append((length, []))
                room = per
            take = min(n, room)
            out[-1][1].append((length, take))
            n, room = n - take, room - take
    merged: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for top, runs in out:  # groups that begin with the same length are one size
        merged[top] += runs
    return list(merged.items())


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value that fits: an unbounded knapsack over few sizes."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        got = best[c - sizes[fits]] + values[fits]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], last[c] = got[i], fits[i]
        else:
            best[c] = best[c - 1]
    chosen, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        chosen[last[c]] += 1
        c -= int(sizes[last[c]])
    return float(best[capacity]), chosen


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how often to use each, meeting the demand exactly or with slots to spare.

    Column generation on the relaxed covering problem, rounded down; the rest is packed by first-fit decreasing.
    """
    size, need = np.array(sizes, np.int64), np.array(demand, float)
    k = len(size)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use, price = inverse @ need, inverse.sum(0)
        value, column = best_configuration(size, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.floor(np.linalg.inv(basis) @ need + 1e-9)
    out = [(basis[:, i].astype(np.int64), int(use[i])) for i in range(k) if use[i] >= 1]
    left = need.astype(np.int64) - sum((c * n for c, n in out), np.zeros(k, np.int64))
    left = np.maximum(left, 0)
    while left.any():  # few: less than one sequence for each basis column
        c, room = np.zeros(k, np.int64), capacity
        for i in np.argsort(-size, kind="stable"):
            take = min(int(left[i]), room // int(size[i]))
            c[i], room = take, room - take * int(size[i])
        times = int((left[c > 0] // c[c > 0]).min())
        out.append((c, times))
        left -= c * times
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The best of the plans with each of the given bounds of small lengths."""
    return min((plan_at(histogram, capacity, groups, s) for s in small), key=lambda p: p[1])


def plan_at(histogram: dict[int, int], capacity: int, groups: int, small: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for all pieces of a length histogram, as runs ``(length, count, first sequence, per sequence, offset)``, and the number of sequences.

    Run by run, in order, the pieces of a length fill ``count`` places: ``per sequence`` in each sequence from the first one on,
    the first of them at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first sequence, count)
    sequences = 0
    large = sorted((x for x in histogram if x > small * capacity and x < capacity), reverse=True)
    if n := histogram.get(capacity, 0):
        runs.append((capacity, n, sequences, 1, 0))
        sequences += n
    if large:
        classes = grouped(large, [histogram[x] for x in large], groups)
        queues = [list(items) for _, items in classes]
        for chosen, times in configurations([top for top, _ in classes], [sum(n for _, n in items) for _, items in classes], capacity):
            slots = [g for g in range(len(classes)) for _ in range(int(chosen[g]))]
            segments = [(sequences, times, 0)]
            sequences += times
            for g in slots:  # actual lengths take the slots; a segment splits where the length changes
                after = []
                for first, count, used in segments:
                    while count and queues[g]:
                        length, n = queues[g][0]
                        take = min(n, count)
                        runs.append((length, take, first, 1, used))
                        after.append((first, take, used + length))
                        first, count = first + take, count - take
                        queues[g][0] = (length, n - take)
                        if n == take:
                            queues[g].pop(0)
                    if count:
                        after.append((first, count, used))
                segments = after
            for first, count, used in segments:
                open_at[capacity - used].append((first, count))
    for length in sorted((x for x in histogram if x <= small * capacity), reverse=True):
        n = histogram[length]
        while n:
            free = min((f for f in open_at if f >= length), default=None)
            if free is None:
                count = -(-n // (capacity // length))
                free = capacity
                open_at[free].append((sequences, count))
                sequences += count
            first, count = open_at[free].pop()
            if not open_at[free]:
                del open_at[free]
            each = min(free // length, n)  # best fit goes on filling the same sequence while it fits
            full = min(count, n // each)
            runs.append((length, full * each, first, each, capacity - free))
            n -= full * each
            for f, a, c in ((free - each * length, first, full), (free, first + full, count - full)):
                if f and c:
                    open_at[f].append((a, c))
    return runs, sequences


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of pieces (``length``, more) with ``sequence_id`` and ``offset``: gapless from 0 in each sequence."""
    numbered = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))  # the numbers are fixed by the checkpoint
    by_group = numbered.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {int(r["length"]): r["count"] for r in by_group}
    runs, _ = plan(histogram, capacity)
    by_length = sorted(runs, key=lambda r: r[0])  # stable: the runs of a length keep their order
    starts = np.concatenate(([0], np.cumsum([r[1] for r in by_length]))).astype(np.int64)
    table = np.array(by_length, np.int64).reshape(-1, 5)
    base, total = {}, 0
    for length in sorted(histogram):
        base[length], total = total, total + histogram[length]

    # A length is ranked in groups of some RANKED pieces each: rank within the group, plus the sizes of the groups before it.
    splits = F.lit(np.array([-(-histogram.get(x, 0) // RANKED) or 1 for x in range(capacity + 1)]).tolist())
    bases = F.lit([base.get(x, 0) for x in range(capacity + 1)])
    at = lambda a: F.element_at(a, (F.col("length") + 1).cast("int"))
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("row"), at(splits).cast("long")))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("salt") / SUMMED))
    earlier = lambda n, *keys: F.coalesce(F.sum(n).over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", earlier("n", "length", "block").alias("blocks_before"))
    inside = sizes.select("length", "block", "salt", earlier("n", "length", "block", "salt").alias("inside"))
    offsets = inside.join(blocks, ["length", "block"]).select("length", "salt", (F.col("inside") + F.col("blocks_before")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1).join(offsets, ["length", "salt"])
    position = F.col("rank") + F.col("before") + at(bases)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(positions: pa.Array) -> pa.Array:
        p = positions.to_numpy(zero_copy_only=False).astype(np.int64)
        i = np.searchsorted(starts, p, "right") - 1
        length, _, first, each, offset = table[i].T
        k = p - starts[i]
        return pa.StructArray.from_arrays([pa.array(first + k // each), pa.array(offset + k % each * length)], ["sequence_id", "offset"])

    return ranked.withColumn("place", place(position)).select(*rows.columns, "place.sequence_id", "place.offset")


def packed_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: where it lies in which sequence."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.explode(pieces(F.col(text).cast("string"), vocabulary, capacity)).alias("p")).select("doc_id", "p.*")
    return pack(cut, capacity)
