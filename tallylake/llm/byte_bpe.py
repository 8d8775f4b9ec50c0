"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves; the others are merged
by a heap of adjacent pairs over linked bytes. Encoded pre-tokens are kept in a bounded cache per Python worker.

Cases: a null or empty text encodes to no ids and decodes to no bytes; decoding gives back the UTF-8 bytes of the text;
repeated rows are encoded each; an empty table gives an empty table; output columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from public_tokenizers import PATTERN
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import BoundedCache
from .pretokens import Splitter


class MinimalPerfectHash:
    """Hash and displace: n keys take exactly n slots; each bucket of keys stores the seed that sends its keys to free slots.

    ``get(key)`` gives the key's value or None: one hash, one displacement, one comparison.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        taken, self.seed, self.slot = bytearray(n), [0] * self.buckets, [0] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            group = [hashes[i] for i in members[b]]
            if len(group) == 1:
                break
            seed = 0
            while group:
                seed += 1
                to = [self.place(h, seed) for h in group]
                if len({*to}) == len(to) and not any(taken[s] for s in to):
                    break
            self.seed[b] = seed
            for i, s in zip(members[b], to if group else (), strict=True):
                taken[s], self.slot[s] = 1, i
        free = (s for s in range(n) if not taken[s])
        for b in range(self.buckets):  # buckets of one key take what is left; a negative seed is the slot itself
            if len(members[b]) == 1:
                s = next(free)
                self.seed[b], self.slot[s] = -1 - s, members[b][0]
        self.keys = keys

    def place(self, h: int, seed: int) -> int:
        return ((h >> 17) * (2 * seed + 1) + (h & 0xFFFFFFFF) * seed % 0xFFFFFFFB) % 0xFFFFFFFFFFC5 % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        seed = self.seed[h % self.buckets]
        i = self.slot[-1 - seed if seed < 0 else self.place(h, seed)]
        return i if i < len(self.keys) and self.keys[i] == key else None


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens that ``piece`` merges into: always the adjacent pair of lowest rank, the leftmost among equals."""
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; end[i] is where the next one starts
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, j, k = heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
            continue
        alive[j], end[i] = 0, k
        if k < n:
            left[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heappush(heap, (r, i, k, end[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get(piece[h:k])) is not None:
            heappush(heap, (r, h, i, k))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class ByteBpe:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.ranks = dict(pairs)
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in pairs:
            self.vocabulary[rank] = token
        self.whole = MinimalPerfectHash([a for a, _ in pairs])
        self.rank_at = [b for _, b in pairs]
        self.split = Splitter(pattern)
        self.packed = BoundedCache(self.pack)

    def pack(self, word: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit integers."""
        piece = word.encode("utf-8", "surrogatepass")
        i = self.whole.get(piece)
        ids = [self.rank_at[i]] if i is not None else heap_merge(piece, self.ranks)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def in_slices(values: pa.Array, f, kind: pa.DataType, rows: int = 512) -> pa.Array:
    """``f`` of a few rows at a time, so that Python objects never exist for a whole batch."""
    parts = [f(values.slice(at, rows)) for at in range(0, len(values), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encoded(text: Column, vocabulary: str) -> Column:
    """``array<int>``: the ids of a text column. ``vocabulary``: the path of a .tiktoken file on every worker."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        of = codec(vocabulary)
        return in_slices(texts, lambda part: id_lists([of.encode(t) for t in part.to_pylist()]), pa.list_(pa.int32()))

    return encode(F.coalesce(text, F.lit("")))


def round_trip(text: Column, vocabulary: str) -> Column:
    """``struct<ids array<int>, ids_sha256 string, bytes binary>``: a text encoded once, its ids' digest, and what the ids decode to.

    One function, because the optimizer would run ``encoded`` anew for every function of its result.
    """

    def part_of(texts: pa.Array) -> pa.Array:
        of = codec(vocabulary)
        packed = [of.encode(t) for t in texts.to_pylist()]
        digests = [hashlib.sha256(p).hexdigest() for p in packed]
        back = [of.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
        return pa.StructArray.from_arrays([id_lists(packed), pa.array(digests, pa.string()), pa.array(back, pa.binary())], ["ids", "ids_sha256", "bytes"])

    @F.arrow_udf("struct<ids:array<int>,ids_sha256:string,bytes:binary>")
    def convert(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("bytes", pa.binary())])
        return in_slices(texts, part_of, kind)

    return convert(F.coalesce(text, F.lit("")))


def each(lists: pa.Array) -> Iterator[np.ndarray | None]:
    """The lists of an id column, as views of its buffer."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for a, b, null in zip(offsets[:-1], offsets[1:], lists.is_null().to_pylist(), strict=True):
        yield None if null else values[a:b]


def decoded(ids: Column, vocabulary: str) -> Column:
    """``binary``: the bytes of an id column."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        of = codec(vocabulary)
        return pa.array([None if x is None else of.decode(x.tolist()) for x in each(lists)], pa.binary())

    return decode(ids)


def ids_sha256(ids: Column) -> Column:
    """Lowercase hex SHA-256 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def digest(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each(lists)], pa.string())

    return digest(ids)
