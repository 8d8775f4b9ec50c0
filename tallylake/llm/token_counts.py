"""Token counts of whole texts under a word-end BPE vocabulary.

Each pre-token is merged by a heap of adjacent pairs over a doubly linked list: the pair of lowest rank (leftmost among
equals) is popped and merged until none is left. The count is the number of initial symbols minus the merges; identifiers are never made.
Counts of pre-tokens are kept in a bounded cache per Python worker.

Cases: a null or empty text has 0 tokens; special strings inside a text count one each; repeated rows are counted each;
an empty table gives an empty table; an existing column of the same name as the output is replaced.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, text_or_empty
from .pretokens import spelled, word_splitter


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left of ``symbols`` when no adjacent pair has a rank any more."""
    n = len(symbols)
    if n < 2:
        return n
    right, left, symbol = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # one of the two was merged meanwhile
        merges += 1
        symbol[i], symbol[j] = a + b, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                heappush(heap, (r, i, symbol[i], symbol[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
            heappush(heap, (r, h, symbol[h], symbol[i]))
    return n - merges


class TokenCounter:
    def __init__(self, path: str):
        self.splitter = word_splitter(path)
        self.ranks = {tuple(m): i for i, m in enumerate(self.splitter.merges)}
        self.of_word = BoundedCache(self.count_word)

    def count_word(self, word: str) -> int:
        symbols = list(spelled(word))
        symbols[-1] += self.splitter.suffix
        return merged_count(symbols, self.ranks)

    def __call__(self, text: str) -> int:
        total = 0
        for words, special in self.splitter.segments(text):
            total += sum(map(self.of_word.__getitem__, words)) + (special is not None)
        return total


@lru_cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """The number of tokens of a text column; ``vocabulary`` is the path of a tokenizers .json file on every worker."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        of = counter(vocabulary)
        return pa.array([of(t) for t in texts.to_pylist()], pa.int64())

    return count(F.coalesce(text, F.lit("")))


def with_token_counts(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", limit: int = 2048) -> DataFrame:
    """``df`` with the columns ``n_bytes``, ``out`` and ``over_limit``."""
    t = text_or_empty(text)
    return df.withColumns({"n_bytes": F.octet_length(t).cast("long"), out: token_count(t, vocabulary)}).withColumn("over_limit", F.col(out) > limit)
