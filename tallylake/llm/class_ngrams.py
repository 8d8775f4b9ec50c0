"""Class-based n-grams after Brown: exchange clustering gives words their classes, and a text's probability is that of its classes in their order times that of each word in its class.

Words are counted over all training texts. The ``DICTIONARY`` most frequent ones are numbered, and texts are stored as numbers, with rare words beside them. The exchange goes in rounds over these
numbers: each task counts, for each of the ``TOP`` most frequent words, the classes before and behind it; the sums, blocks of fixed size, meet in one task a block, which moves
its words, one after the other, to the class where the likelihood of the class bigrams gains most (half of the words in each round, since other blocks move theirs at the same time). All other words
are then placed once, by the same gain to the first order, from the classes around each of their occurrences: their counts meet by word, so the vocabulary and its classes grow with the input and
never come together anywhere. What the driver and the tasks hold is bounded by ``DICTIONARY``, ``TOP`` and ``CLASSES``.

Classes follow each other by trigrams, with absolute discounting down to bigrams and single classes. A word's share of its class is discounted as well, and the sum of the discounts is
the probability of the unknown word, in each class and so in each context; the probabilities after any context add up to one. After an unknown word the context is what is known of it.

Cases: a null or empty text is its end alone; a null doc_id belongs to the training texts; rows that repeat count each; ties of frequency go by the word; without training texts every score is 0; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, deleted, shared_folder, text_or_empty

#: Classes, the end's own (0) among them; words that take part in the exchange; words that are numbered; rounds.
CLASSES, TOP, DICTIONARY, ROUNDS = 64, 16_384, 262_144, 5
#: Words of a block; different words, or tokens, that a task takes together before it hands them on.
BLOCK, HELD, TOKENS = 256, 400_000, 2_000_000
#: Tokens that are computed at once.
SLICE = 1 << 20
#: Parts in which the sums of a block are taken before they meet.
PARTS = 64


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df``, written and read again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 10 == 0, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """White space and capitals of ASCII alone count, as bytes have it."""
    return text.encode().lower().split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of a task's texts; ``''`` is the end."""
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([*total], pa.binary()).cast(pa.string()), "n": pa.array(total.values(), pa.int64())})

    for batch in batches:
        for text in batch["text"]:
            total.update(words_of(text.as_py()))
            total[b""] += 1
            if len(total) >= HELD:
                yield out()
                total.clear()
    yield out()


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words and their counts, the most frequent first: those beyond a threshold, which a histogram of the counts' logarithms gives."""
    level = F.floor(F.log2("n") * 128).cast("int")
    sizes = counts.where("word <> ''").groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    room, least = most, None
    for r in sizes:
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return []
    found = counts.where("word <> ''").where(level >= least).select("word", "n").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


class Numbers(dict):
    """Numbers of words, from 1; ``rare`` for all others."""

    def __init__(self, words: list[str], rare: int):
        super().__init__((w.encode(), i + 1) for i, w in enumerate(words))
        self.rare = rare

    def __missing__(self, word: bytes) -> int:
        return self.rare


def numbered(docs: DataFrame, words) -> DataFrame:
    """``key, doc_id, held_out, ids, rare``: the numbers of a text's tokens, little-endian in 4 bytes, 0 for the end, and its rare words in their order. ``words``: a broadcast list."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = len(words.value) + 1
        number = Numbers(words.value, rare)
        for batch in batches:
            ids, others = [], []
            for text in batch["text"]:
                tokens = words_of(text.as_py())
                own = [*map(number.__getitem__, tokens), 0]
                ids.append(np.array(own, "<u4").tobytes())
                others.append([t for t, i in zip(tokens, own, strict=False) if i == rare])
            cut = np.cumsum([0, *map(len, others)])
            flat = pa.array([w for o in others for w in o], pa.binary()).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)
            rest = {c: batch[c] for c in ("key", "doc_id", "held_out")}
            yield pa.RecordBatch.from_pydict({**rest, "ids": pa.array(ids, pa.binary()), "rare": lists})

    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))).alias("key")
    rows = docs.select(key, "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(encoded, f"key binary, doc_id {kind}, held_out boolean, ids binary, rare array<string>")


def slices(batch: pa.RecordBatch, column: str = "ids", width: int = 4) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some ``SLICE`` tokens, so that what is computed for each of them stays small."""
    sizes = pc.binary_length(batch[column]).to_numpy(zero_copy_only=False) // width
    part = (np.cumsum(sizes) - sizes) // SLICE
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def flat_ids(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    """The numbers of all texts of a batch, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def statistics(texts: DataFrame, classes, top: int, k: int) -> DataFrame:
    """``block, counts``: of each of the first ``top`` words how often each class stands before it and behind it (int64, ``BLOCK`` rows of ``2 * k``), and as block -1 the class bigrams.

    ``classes``: a broadcast array, the class of each number or -1. The end before a text's first token is the end of another text, so one class stands for both.
    """
    blocks = -(-top // BLOCK)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classes.value
        sums, bigrams = np.zeros((2, blocks * BLOCK * k), np.int64), np.zeros(k * k, np.int64)
        for part in (x for batch in batches for x in slices(batch)):
            ids = flat_ids(part["ids"])
            here, cls = ids.astype(np.int64), of[ids].astype(np.int64)
            before, cls_before = np.concatenate(([0], here[:-1])), np.concatenate(([of[0]], cls[:-1])).astype(np.int64)
            both = (cls >= 0) & (cls_before >= 0)
            bigrams += np.bincount(cls_before[both] * k + cls[both], minlength=k * k)
            ok = (here > 0) & (here <= top) & (cls_before >= 0)
            sums[0] += np.bincount((here[ok] - 1) * k + cls_before[ok], minlength=sums.shape[1])
            ok = (before > 0) & (before <= top) & (cls >= 0)
            sums[1] += np.bincount((before[ok] - 1) * k + cls[ok], minlength=sums.shape[1])
        wide = np.concatenate((sums[0].reshape(-1, k), sums[1].reshape(-1, k)), 1).reshape(blocks, -1) if blocks else np.zeros((0, 0), np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array([*range(blocks), -1], pa.int32()), "counts": pa.array([*(b.tobytes() for b in wide), bigrams.tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                sums[block] = sums[block] + own if block in sums else own
        yield pa.RecordBatch.from_pydict({"block": pa.array([*sums], pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    parts = texts.select("ids").mapInArrow(counts, "block int, counts binary").withColumn("part", F.spark_partition_id() % PARTS)
    some = parts.repartition("block", "part").mapInArrow(added, "block int, counts binary")
    return some.repartition("block").mapInArrow(added, "block int, counts binary")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def placing_weights(bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each class before a word, and each behind it, adds to the gain of each class for it, to the first order, and the gain without any; -inf for the end's class and those without words."""
    n = bigrams + 0.5
    before, behind = np.log(n / n.sum(0, keepdims=True)), np.log(n / n.sum(1, keepdims=True)).T
    size = bigrams.sum(0)
    prior = np.where(size > 0, np.log(np.maximum(size, 1)), -np.inf)
    prior[0] = -np.inf
    return before, behind, prior


def moved(counts: np.ndarray, own: np.ndarray, bigrams: np.ndarray, turn: int) -> np.ndarray:
    """The classes of a block's words after its moves. ``counts``: its statistics, ``own``: its classes (-1: not placed yet)."""
    k = len(bigrams)
    out = own.copy()
    if (own < 0).any():  # the first round places all words
        before, behind, prior = placing_weights(bigrams)
        gains = counts[:, :k] @ before + counts[:, k:] @ behind + prior
        return np.where(own < 0, gains.argmax(1), own)
    m = bigrams.astype(np.float64)
    for i in range(turn % 2, len(own), 2):
        left, right, a = counts[i, :k].astype(np.float64), counts[i, k:].astype(np.float64), out[i]
        if not left.any() and not right.any():
            continue
        m[:, a] = np.maximum(m[:, a] - left, 0)
        m[a, :] = np.maximum(m[a, :] - right, 0)
        f, cols, rows = xlogx(m), m.sum(0), m.sum(1)
        gain = (xlogx(m + left[:, None]) - f).sum(0) + (xlogx(m + right[None, :]) - f).sum(1)
        gain -= xlogx(cols + left.sum()) - xlogx(cols) + xlogx(rows + right.sum()) - xlogx(rows)
        gain[0] = -np.inf
        b = int(gain.argmax())
        m[:, b] += left
        m[b, :] += right
        out[i] = b
    return out


def bigrams_of(sums: DataFrame, k: int) -> np.ndarray:
    row = sums.where("block = -1").first()
    return np.frombuffer(row["counts"], np.int64).reshape(k, k) if row else np.zeros((k, k), np.int64)


def exchanged(texts: DataFrame, n_words: int, top: int = TOP, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each number (-1: beyond ``top``, or rare) and the class bigrams, after ``rounds`` of exchanges. The first one starts from a class for each of the most frequent words."""
    spark = texts.sparkSession
    top = min(top, n_words)
    of = np.full(n_words + 2, -1, np.int16)
    of[0] = 0
    of[1 : min(k, top + 1)] = np.arange(1, min(k, top + 1))
    for turn in range(rounds):
        classes = spark.sparkContext.broadcast(of)
        sums = checkpointed(statistics(texts, classes, top, k))
        bigrams = bigrams_of(sums, k)

        def move(batches: Iterator[pa.RecordBatch], of=of, bigrams=bigrams, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, raw in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                    first, size = 1 + block * BLOCK, min(BLOCK, top - block * BLOCK)
                    new = moved(np.frombuffer(raw, np.int64).reshape(BLOCK, -1)[:size], of[first : first + size], bigrams, turn)
                    yield pa.RecordBatch.from_pydict({"number": pa.array(np.arange(first, first + size), pa.int32()), "class": pa.array(new, pa.int32())})

        rows = sums.where("block >= 0").mapInArrow(move, "number int, class int").toArrow()  # TOP rows
        of = of.copy()
        of[rows["number"].to_numpy()] = rows["class"].to_numpy()
        classes.unpersist()
    classes = spark.sparkContext.broadcast(of)
    bigrams = bigrams_of(statistics(texts, classes, 0, k), k)
    return of, bigrams


def placed(texts: DataFrame, words, of: np.ndarray, bigrams: np.ndarray, top: int = TOP) -> DataFrame:
    """``word, class, n`` of all words beyond the first ``top``: of each the classes around its occurrences are counted, and give its class.

    A class around a word is a code of two bytes, and so is each of its occurrences; a word's codes in a part of the texts are one row.
    """
    k = len(bigrams)
    wide = 2 * k + 1
    top = min(top, len(of) - 2)
    before, behind, prior = placing_weights(bigrams)

    def gathered(tokens: list[np.ndarray], rare: list[pa.Array]) -> pa.RecordBatch:
        ids = np.concatenate(tokens).astype(np.int64)
        coded = pa.concat_arrays(rare).dictionary_encode()
        cls = of[ids].astype(np.int64)
        first = len(of) - 1  # the number that stands for rare words
        ids[ids == first] = first + coded.indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(ids > top)
        left, right = np.where(at > 0, cls[at - 1], of[0]), cls[at + 1]  # a text's end comes last
        codes = np.sort(np.concatenate((ids[at] * wide + 2 * k, (ids[at] * wide + left)[left >= 0], (ids[at] * wide + k + right)[right >= 0])))
        numbers, starts = np.unique(codes // wide, return_index=True)
        names = [words.value[i - 1] if i < first else None for i in numbers.tolist()]
        others = coded.dictionary.take(pa.array(numbers[numbers >= first] - first)).to_pylist()
        names[len(names) - len(others) :] = others
        offsets = pa.array(2 * np.append(starts, len(codes)), pa.int32())
        raw = pa.Array.from_buffers(pa.binary(), len(names), [None, offsets.buffers()[1], pa.py_buffer((codes % wide).astype("<u2").tobytes())])
        return pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "codes": raw})

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rare, size = [], [], 0
        for part in (x for batch in batches for x in slices(batch)):
            tokens.append(flat_ids(part["ids"]))
            rare.append(part["rare"].flatten().cast(pa.string()))
            size += len(tokens[-1])
            if size >= TOKENS:
                yield gathered(tokens, rare)
                tokens, rare, size = [], [], 0
        if size:
            yield gathered(tokens, rare)

    def chosen(names: list[str], sums: np.ndarray) -> pa.RecordBatch:
        gains = sums[:, :k] @ before + sums[:, k : 2 * k] @ behind + prior
        return pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "class": pa.array(np.where(np.isfinite(gains).any(1), gains.argmax(1), 1), pa.int32()), "n": pa.array(sums[:, -1].astype(np.int64), pa.int64())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by word; the last word of a batch may go on in the next."""
        last, carried = None, np.zeros(wide)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch["word"].dictionary_encode()
            names, run = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(run.astype(np.int64), pc.binary_length(batch["codes"]).to_numpy(zero_copy_only=False) // 2)
            sums = np.bincount(row * wide + flat_ids(batch["codes"], "<u2"), minlength=len(names) * wide).reshape(-1, wide).astype(np.float64)
            if last == names[0]:
                sums[0] += carried
            elif last is not None:
                yield chosen([last], carried[None])
            if len(names) > 1:
                yield chosen(names[:-1], sums[:-1])
            last, carried = names[-1], sums[-1].copy()
        if last is not None:
            yield chosen([last], carried[None])

    rows = texts.select("ids", "rare").mapInArrow(contexts, "word string, codes binary")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word string, class int, n bigint")


def classed(texts: DataFrame, info: DataFrame, tokens) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, words_score, classes``: what a text's single tokens add to its scores, and their classes, a byte each (the last one for unknown words).

    ``tokens``: a broadcast of arrays over numbers (class, what a token adds to either score), the same of unknown words, and the function that gives it for rare ones; ``info``: class and count of rare words.
    A text's rare words come to it by its key.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, base, score, unknown, unknown_base, of_rare = tokens.value
        rare = len(cls)
        cls, base, score = np.append(cls, unknown).astype(np.uint8), np.append(base, unknown_base), np.append(score, 0.0)
        for part in (x for batch in batches for x in slices(batch)):
            ids = flat_ids(part["ids"])
            sizes = pc.binary_length(part["ids"]).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            starts = np.cumsum(sizes) - sizes
            classes, bases, scores = cls[ids], base[ids], score[ids]
            # What is known of rare words goes to their places: a text's are numbered in their order.
            at = np.flatnonzero(ids == rare)
            own = np.repeat(np.arange(len(sizes)), part["found"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            pos, found, n = (x.to_numpy(zero_copy_only=False) for x in part["found"].flatten().flatten())
            place = at[np.searchsorted(at, starts)[own] + pos]
            classes[place] = found
            bases[place], scores[place] = of_rare(found, n)
            raw = [classes[i : i + m].tobytes() for i, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
            known, bases, scores = (np.add.reduceat(x, starts) for x in ((classes != unknown).astype(np.int64), bases, scores))  # a text has one token at least
            sums = {"n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(bases), "words_score": pa.array(scores)}
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "held_out": part["held_out"], **sums, "classes": pa.array(raw, pa.binary())})

    # Texts with rare words, once a key: rows that repeat share them.
    wanted = texts.where(F.size("rare") > 0).groupBy("key").agg(F.first("rare").alias("rare")).select("key", F.posexplode("rare").alias("pos", "word"))
    found = wanted.join(info, "word").groupBy("key").agg(F.collect_list(F.struct("pos", "class", "n")).alias("found"))
    rows = texts.select("key", "doc_id", "held_out", "ids").join(found, "key", "left").drop("key")
    kind = dict(texts.dtypes)["doc_id"]
    return rows.mapInArrow(summed, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, words_score double, classes binary")


def contexts_of(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the classes of texts, one after the other, the two before each. Before a text's beginning there are ends only."""
    first = np.concatenate(([0], classes[:-1]))
    second = np.concatenate(([0], first[:-1]))
    return np.where(first == 0, 0, second), first


def trigrams(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of three classes in a row. ``k ** 3`` numbers at most come to the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k**3, np.int64)
        for part in (x for batch in batches for x in slices(batch, "classes", 1)):
            own = flat_ids(part["classes"], np.uint8).astype(np.int64)
            second, first = contexts_of(own)
            sums += np.bincount((second * k + first) * k + own, minlength=k**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    rows = texts.select("classes").mapInArrow(counts, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k**3, np.int64)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k, k, k)


def discount(counts: np.ndarray) -> float:
    """How much is taken from each count, by how many are one and how many are two."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return (once + 0.5) / (once + 2 * twice + 1)


def transitions(counts: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """``log10`` of the probability of each class, or of the unknown word, after each two: ``k + 1`` in each direction, the last for unknown. ``unknown``: the share of each class that it has."""
    k = len(counts)
    two, one = counts.sum(0), counts.sum((0, 1)).astype(np.float64)
    one = np.where(one > 0, one + 0.5, 0)
    p1 = one / one.sum() if one.sum() else one

    def backed(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d, total = discount(n), n.sum(-1, keepdims=True)
        spread = d * (n > 0).sum(-1, keepdims=True) * lower
        return np.where(total > 0, (np.maximum(n - d, 0) + spread) / np.maximum(total, 1), lower)

    p2 = backed(two, np.broadcast_to(p1, two.shape))
    p3 = backed(counts, np.broadcast_to(p2, counts.shape))
    full = np.zeros((k + 1, k + 1, k))
    full[:k, :k], full[k, :k], full[:, k] = p3, p2, p1
    every = np.concatenate((full, (full @ unknown)[..., None]), -1)
    if not one.sum():
        every[..., k] = 1.0  # nothing is known
    return np.log10(np.maximum(every, 1e-300))


@dataclass
class RareWords:
    """What a rare word adds to either score, by its class and count: the base's logarithm, and that of its discounted share of its class."""

    total: float
    discount: float
    sizes: np.ndarray

    def __call__(self, classes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.log10(n + 0.1) - self.total, np.log10((n - self.discount) / self.sizes[classes])


@dataclass
class Fit:
    """Texts as numbers, and the words of the training texts: ``known``, the dictionary with counts, ``of``, the classes of its first words, and ``others``, a frame of all beyond them."""

    ids: DataFrame
    known: list[tuple[str, int]]
    of: np.ndarray
    others: DataFrame
    top: int
    tokens: int
    types: int
    ends: int
    discount: float


def fitted(docs: DataFrame, folder: str, k: int = CLASSES, top: int = TOP, dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> Fit:
    """Count, number, exchange and place. Tables between the steps go to ``folder``, which the cluster shares."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    training = texts.where(~held_out(F.col("doc_id"))).select("text")
    counts = stored(training.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), f"{folder}/counts")
    n, types, ends, once, twice = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("n"))), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    known = frequent(counts, dictionary)
    words = spark.sparkContext.broadcast([w for w, _ in known])
    top = min(top, len(known))
    ids = stored(numbered(texts, words), f"{folder}/ids")
    of, bigrams = exchanged(ids.where(~F.col("held_out")), len(known), top, k, rounds)
    others = stored(placed(ids.where(~F.col("held_out")), words, of, bigrams, top), f"{folder}/words")
    return Fit(ids, known, of, others, top, n or 0, types, ends or 0, (once + 0.5) / (once + 2 * twice + 1))


def clusters(docs: DataFrame, folder: str, **options: int) -> DataFrame:
    """``word, class, n`` of every word of the training texts."""
    fit = fitted(docs, folder, **options)
    first = [(w, int(fit.of[i + 1]), n) for i, (w, n) in enumerate(fit.known[: fit.top])]
    return fit.others.unionByName(docs.sparkSession.createDataFrame(first, "word string, class int, n bigint"))


def scored(docs: DataFrame, k: int = CLASSES, top: int = TOP, dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text. What is kept between steps lies in a folder that the cluster shares, and goes in the end."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/classes-{uuid.uuid4().hex}"
    fit = fitted(docs, folder, k, top, dictionary, rounds)
    known, d, others = fit.known, fit.discount, fit.others
    of, sizes, n_top = fit.of[: len(known) + 1].copy(), np.zeros((2, k)), [n for _, n in known[: fit.top]]
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        sizes[:, r["class"]] += r["n"], r["types"]
    sizes[0] += np.bincount(of[1 : fit.top + 1], weights=n_top, minlength=k)
    sizes[1] += np.bincount(of[1 : fit.top + 1], minlength=k)
    share = d * sizes[1] / np.maximum(sizes[0], 1)

    # What a word adds: the base's logarithm, and that of its discounted share of its class.
    total = np.log10(fit.tokens + 0.1 * (fit.types + 1))
    least = known[-1][1] if known else 0
    numbered_others = others.where(F.col("n") >= least).toArrow()  # within the dictionary
    place = {w: i + 1 for i, (w, _) in enumerate(known)}
    of[[place[w] for w in numbered_others["word"].to_pylist()]] = numbered_others["class"].to_numpy()
    n = np.array([fit.ends, *(n for _, n in known)], np.float64)
    score = np.concatenate(([0.0], np.log10((n[1:] - d) / np.maximum(sizes[0], 1)[of[1:]])))
    of[0] = 0 if fit.ends else k
    every = np.maximum(sizes[0], 1)
    tokens = spark.sparkContext.broadcast((of, np.log10(n + 0.1) - total, score, k, np.log10(0.1) - total, RareWords(total, d, every)))
    info = others.where(F.col("n") < least).select("word", "class", "n")
    parts = stored(classed(fit.ids, info, tokens), f"{folder}/classes")

    table = spark.sparkContext.broadcast(transitions(trigrams(parts.where(~F.col("held_out")), k), share))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, "classes", 1)):
            classes = flat_ids(part["classes"], np.uint8).astype(np.int64)
            sizes = part["n_tokens"].to_numpy()
            second, first = contexts_of(classes)
            own = np.add.reduceat(table.value[second, first, classes], np.cumsum(sizes) - sizes)
            scores = pa.array(own + part["words_score"].to_numpy(), pa.float64())
            yield pa.RecordBatch.from_pydict({**{c: part[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}, "score": scores})

    kind = dict(docs.dtypes)["doc_id"]
    out = parts.mapInArrow(summed, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(fit.tokens)).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
    out = checkpointed(out)
    deleted(spark, folder)
    return out
