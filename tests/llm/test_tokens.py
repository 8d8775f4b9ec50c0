"""Token counts, byte-level BPE and packing, against the public libraries."""

import base64
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallylake.llm import byte_bpe, packing, token_counts
from tallylake.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

TEXTS = ["", " ", "a", "The cat's DON'T  x\n\ny", "<|endoftext|>in<|startoftext|>side", "ÀÉ ñß 12 3½²", "ΣΑΣ İstanbul 中文 😀 ́é", "!" * 3000, "ab" * 4000, "x" * 5000, "\x1c\x1d\x85\xa0  z", "word " * 6000]
LIBRARY = Tokenizer.from_file(WORD_VOCABULARY)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_and_ids_equal_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert token_counts.counter(WORD_VOCABULARY)(text) == len(ids)
    assert np.frombuffer(packing.encoder(WORD_VOCABULARY)(text), "<u4").tolist() == ids


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(text, tik):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert token_counts.counter(WORD_VOCABULARY)(text) == len(ids)
    codec = byte_bpe.codec(BYTE_VOCABULARY)
    mine = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert mine == tik.encode_ordinary(text)
    assert codec.decode(mine) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    codec = byte_bpe.codec(BYTE_VOCABULARY)
    assert codec.decode(np.frombuffer(codec.encode(text), "<u4").tolist()) == text.encode()


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key{i}".encode() for i in range(500)]
    table = byte_bpe.MinimalPerfectHash(keys)
    assert sorted(table.slot) == list(range(500))
    assert [table.get(k) for k in keys] == list(range(500))
    assert table.get(b"other") is None
    assert byte_bpe.MinimalPerfectHash([]).get(b"x") is None


def rows(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(100, None, 1, "x"), (1, TEXTS[1], 2, "y")], "doc_id long, text string, n_tokens int, ids string")


def test_columns(spark, tik):
    out = token_counts.with_token_counts(rows(spark), WORD_VOCABULARY).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        t = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(LIBRARY.encode(t, add_special_tokens=False).ids), len(t.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    ids = rows(spark).withColumn("ids", byte_bpe.encoded(F.col("text"), BYTE_VOCABULARY))
    whole = {(r["text"], tuple(r["r"]["ids"]), r["r"]["ids_sha256"], bytes(r["r"]["bytes"])) for r in rows(spark).select("text", byte_bpe.round_trip(F.col("text"), BYTE_VOCABULARY).alias("r")).collect()}
    both = ids.select("text", "ids", byte_bpe.decoded(F.col("ids"), BYTE_VOCABULARY).alias("back"), byte_bpe.ids_sha256(F.col("ids")).alias("digest")).collect()
    import hashlib

    for r in both:
        assert r["ids"] == tik.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == (r["text"] or "").encode()
        assert r["digest"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert (r["text"], tuple(r["ids"]), r["digest"], bytes(r["back"])) in whole


def test_empty_tables(spark):
    none = rows(spark).where("false")
    assert token_counts.with_token_counts(none, WORD_VOCABULARY).count() == 0
    assert none.select(byte_bpe.encoded(F.col("text"), BYTE_VOCABULARY), byte_bpe.round_trip(F.col("text"), BYTE_VOCABULARY)).collect() == []
    assert packing.packed_documents(none, WORD_VOCABULARY).count() == 0


def check_packing(placed, capacity=2048):
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("ranked", [2, 1000])
def test_packed_documents(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    monkeypatch.setattr(packing, "SUMMED", ranked)
    texts = TEXTS + [f"word{i} " * (i % 60 + 1) for i in range(400)] + [None, TEXTS[3]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, TEXTS[0])] + [(None, TEXTS[3])] * 60, "doc_id long, text string")
    placed = packing.packed_documents(df, WORD_VOCABULARY).collect()
    used = check_packing(placed)
    expected = []
    for i, t in [*enumerate(texts), (0, TEXTS[0]), *[(None, TEXTS[3])] * 60]:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        expected += [(i, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed), key=repr) == sorted(expected, key=repr)
    assert used <= 1.25 * -(-sum(e[3] for e in expected) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_near_the_lower_bound(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 2049, 20_000) if seed % 2 else r.lognormal(6.5, 1, 20_000).astype(int) % 2048 + 1
    histogram = dict(Counter(lengths.tolist()))
    runs, sequences = packing.plan(histogram)
    got = Counter()
    fill = defaultdict(list)
    for length, count, first, each, offset in runs:
        got[length] += count
        for k in range(count):
            fill[first + k // each].append((offset + k % each * length, length))
    assert got == histogram
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) == sequences <= 1.03 * -(-int(lengths.sum()) // 2048)


@pytest.mark.parametrize("histogram", [{}, {2048: 7}, {1: 1}, {1: 5000}, {1025: 10}, {682: 9}, {2047: 3, 1: 2, 2: 1}, {512: 4}])
def test_plan_of_special_histograms(histogram):
    runs, sequences = packing.plan(histogram)
    got = Counter()
    for length, count, *_ in runs:
        got[length] += count
    assert got == histogram
    least = -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert sequences == {1025: 10}.get(next(iter(histogram), 0), max(least, sequences if 2047 in histogram else least))
