"""Spelling variants: words that differ by one edit, found by dense tiles of code points, and the form that each variant goes back to.

Two words with one edit between them share all before it or all behind it, so they share their first half or the rest of their halves. Each word goes into the buckets
of these keys, as the shorter and as the longer of a pair: four rows a word. Keys are dealt to buckets of about ``TILE`` words; a bucket that a frequent beginning or ending
makes larger is cut into blocks by a hash, and every two of its blocks meet in a tile of their own, so no tile holds more than some two blocks and no pair is left out. A tile is a pair of padded matrices, one row a word
and one column a code point. Columns are compared all against all, from the left for the length of the common prefix and from the right for the common suffix; words of
lengths that differ by one at most, whose prefix and suffix together reach the longer length less one, are a single edit apart.

A word's form is the most frequent of its near words, if at least ``RATIO`` times as frequent as itself. Frequencies then double along forms, so the chain to the
root is as long as the logarithm of the largest, and pointers double over it in a few rounds.

Cases: a null or empty text has no runs; a null doc_id is written as nothing before the colon; rows that repeat count each; a word without near words has no form and is its own root; ties go to the
word that is first by code points; a table without words gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Code points that a word needs, occurrences that it needs, and how many times as frequent its form is.
SHORTEST, LEAST, RATIO = 5, 3, 2
#: One run of so many hashes has a code point deleted.
SLIPS = 97
#: Words of a bucket, about, and of a block.
TILE = 1024
#: Lengths between which words of a tile are compared together.
LENGTHS = (0, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 64, 128, 1024, 16384, 1 << 40)
#: Different words that a task counts before it hands them on.
HELD = 1_000_000
#: ASCII letters in lower case and U+00C0 to U+00FF stay, everything else ends a run. In Latin-1 all of them are single bytes.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def slipped(doc_id: int | None, run: bytes) -> bytes:
    """The run (Latin-1) as it is written: one in ``SLIPS`` lacks a code point."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    return run if h % SLIPS else run[: (at := h % len(run))] + run[at + 1 :]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of a task's texts; a word comes again after ``HELD`` others."""
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_pydict({"word": words, "n": pa.array(total.values(), pa.int64())})

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
            for run, n in runs.items():
                if len(run) >= SHORTEST and len(w := slipped(doc_id, run)) >= SHORTEST:
                    total[w] += n
            if len(total) >= HELD:
                yield out()
                total.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def keyed(words: DataFrame) -> DataFrame:
    """``key, word, n``: each word under the halves that it can share, as the shorter word of a pair and as the longer one."""
    size = F.length("word")

    def halves(short) -> list:
        """Keys of pairs whose shorter word has ``short`` code points: the first ``short / 2``, and the last of the rest."""
        first = F.floor(short / 2).cast("int")
        return [F.concat_ws(":", F.lit("a"), short, F.left("word", first)), F.concat_ws(":", F.lit("b"), short, F.right("word", short - first))]

    return words.select(F.explode(F.array(*halves(size), *halves(size - 1))).alias("key"), "word", "n")


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``bucket, low, high, block, word, n``: the blocks of each tile, ``low`` and ``high`` (the same, for a block with itself)."""
    rows = keyed(words)
    buckets = max(1, -(-4 * words.count() // tile))
    placed = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "word", "n").distinct()
    blocks = checkpointed(placed.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(2 * tile)).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = placed.join(blocks, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "word", "n")


def columns(words: list[str], width: int, kind: str) -> np.ndarray:
    """Code points, a row for each place and a column for each word, padded by zeros."""
    return np.ascontiguousarray(np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).T.astype(kind))


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places at the start that each word of ``a`` shares with each of ``b``."""
    same = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.zeros(same.shape, np.uint8 if len(a) < 256 else np.int32)
    for x, y in zip(a, b, strict=True):
        same &= x[:, None] == y[None, :]
        if not same.any():
            break
        out += same.view(np.uint8)
    return out


def near_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in ``a`` and ``b`` that are one edit apart. Words go by length, so that long ones do not widen all matrices."""
    sizes_a, sizes_b = np.array([len(w) for w in a], np.int64), np.array([len(w) for w in b], np.int64)
    kind = "uint8" if all(w.isascii() or max(w) < "\u0100" for w in (*a, *b)) else "uint32"
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low, high in zip(LENGTHS, LENGTHS[1:], strict=False):
        i, j = np.flatnonzero((sizes_a >= low) & (sizes_a < high)), np.flatnonzero((sizes_b >= low - 1) & (sizes_b <= high))
        if not len(i) or not len(j):
            continue
        some_a, some_b, na, nb = [a[x] for x in i], [b[x] for x in j], sizes_a[i], sizes_b[j]
        width = int(max(na.max(), nb.max()))
        shorter, longer = np.minimum.outer(na, nb), np.maximum.outer(na, nb)
        prefix = np.minimum(common(columns(some_a, width, kind), columns(some_b, width, kind)), shorter)
        suffix = np.minimum(common(columns([w[::-1] for w in some_a], width, kind), columns([w[::-1] for w in some_b], width, kind)), shorter)
        # Equal words share twice their length, other words of one length at most that length less one.
        x, y = np.nonzero((longer - shorter <= 1) & (prefix + suffix >= longer - 1) & ((longer != shorter) | (prefix < longer)))
        found.append((i[x], j[y]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def compared(frame: pd.DataFrame) -> pd.DataFrame:
    """``word, near, near_n`` of a tile, in both directions."""
    low, high = frame["low"].iat[0], frame["high"].iat[0]
    a, b = frame[frame["block"] == low], frame[frame["block"] == high]
    i, j = near_pairs(a["word"].tolist(), b["word"].tolist())
    wa, wb, na, nb = a["word"].to_numpy(), b["word"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
    back = low != high  # a block with itself has both directions
    return pd.DataFrame({"word": np.concatenate((wa[i], wb[j] if back else wb[:0])), "near": np.concatenate((wb[j], wa[i] if back else wa[:0])), "near_n": np.concatenate((nb[j], na[i] if back else na[:0]))})


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, near, near_n``: every pair of words that are one edit apart, in both directions, once."""
    pairs = tiles(words, tile).groupBy("bucket", "low", "high").applyInPandas(compared, "word string, near string, near_n bigint")
    return pairs.repartition("word").distinct()


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (``word, n, form, ...``) with ``root``: pointers double until every one is at a word without a form. Counts double along forms, so their logarithm bounds the chain."""
    most = words.agg(F.max("n")).first()[0] or 1
    at = checkpointed(words.select("word", F.coalesce("form", "word").alias("root")))
    for _ in range(max(0, (most.bit_length() - 1).bit_length())):
        step = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = checkpointed(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return words.join(at, "word")


def variants(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of all texts."""
    words = checkpointed(word_counts(docs))
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    near = near_words(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = F.col("best.near_n") >= RATIO * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n"))
    return with_roots(checkpointed(out)).select("word", "form", "root", "n", "n_near", "form_n")
