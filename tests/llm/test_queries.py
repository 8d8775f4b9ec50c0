"""The registered corpus queries on odd tables: their columns and digests against the public libraries, the patterns and brute force."""

import base64
import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallylake.llm import media, pii, queries, toxicity
from tallylake.llm.common import shared_folder

from .test_models import labelled, plain_base, plain_score, plain_top
from .test_simhash import plain_components, plain_fingerprint
from .test_web_and_chat import plain_page, plain_replies

sys.path.insert(0, str(Path(__file__).parents[2]))

TEXTS = [None, "", " ", "One two three four", "one TWO three four", "x" * 5000, "word next " * 4000, "é ñ 中文 😀 ́é\n\nline\n", "mail a.b@c.de, 10.0.0.1 and +1 (366) 555-9807", "my name is Tom Berg .\npassword=ab12cd34ef56ab78cd", "<b> & 'q' \"w\" <!-- no -->", "4111 1111 1111 1111", "12.5." * 300, "zloser qidiotic end"]
EXTRA = ", ids string, spans int, score int, fp int, piece string, digest string, html string, bound string"


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3]), (3, "another text under this id"), (None, TEXTS[8]), (None, None), (40, TEXTS[3])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, rows):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"], *[1, 2, 3], *["y"] * 4) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long{EXTRA}")
    docs.write.parquet(f"{at}/documents.parquet")
    more = labelled(spark, 300).select((F.col("doc_id") + 1000).alias("doc_id"), "toxic")
    more.withColumn("quality", F.lit(1)).unionByName(spark.createDataFrame([(13, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")).write.parquet(f"{at}/labels.parquet")
    urls = [None, "", "x", "http://www.Example.com/en/a", "http://a.example.com/en/?q", "http://net/es/#x", "http://net/es/#x"]
    spark.createDataFrame([(i % 6, u, None, "k") for i, u in enumerate(urls)], "page_id long, url string, html string, key string").write.parquet(f"{at}/pages.parquet")
    vectors = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (50, [1.0, None]), (3, None), (None, [1.0]), (7, [float("inf")]), (8, [-1.0]), (8, [2.0, 3.0, 1.0]), (100, []), (9, [0.25, 0.25])]
    spark.createDataFrame([(*v, 1, "b") for v in vectors], "vec_id long, embedding array<float>, label int, bucket string").write.parquet(f"{at}/embeddings.parquet")
    talks = [(1, 0, "u", "hello there\nyou"), (1, 1, "b", "ok"), (1, 2, "u", "ok"), (1, 2, "u", "ok"), (2, 0, None, None), (2, 1, "b", ""), (None, 1, "b", "x"), (2, None, "b", "x")]
    spark.createDataFrame([(*t, "z") for t in talks], "conv_id long, turn long, role string, text string, quoted string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def none(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{at}/{name}.parquet")
    return at


def answer(spark, tables, name):
    return queries.queries()[name](spark, tables)


def same(df, columns, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(expected, key=key)


def test_op1(spark, tables, rows):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    counts = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    out = answer(spark, tables, "op1_token_counts")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    same(out, ["doc_id", "n_bytes", "n_tokens", "over_limit"], [(i, b, n, n > 2048) for i, b, n in counts])


def test_op2(spark, tables):
    want = [(0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (4, "a.example.com", "/en/", "example.com/en/", "block"), (5, "net", "/es/", "net/es/", "block"), (0, "net", "/es/", "net/es/", "block")]
    same(answer(spark, tables, "op2_url_filter"), ["page_id", "host", "path", "rule", "verdict"], want)


def test_op3(spark, tables, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    out = answer(spark, tables, "op3_byte_bpe")
    assert dict(out.dtypes)["n_tokens"] == "bigint"
    same(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)


def decoded(png):
    """Width, height and RGB rows of a PNG file, by the format's rules: checked chunks, and any filter of rows."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        assert int.from_bytes(png[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
        head = body if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += size + 12
    assert kind == b"IEND" and head[8:] == bytes([8, 2, 0, 0, 0])
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    raw, rows = zlib.decompress(data), []
    assert len(raw) == height * (3 * width + 1)
    for y in range(height):
        line = raw[y * (3 * width + 1) : (y + 1) * (3 * width + 1)]
        up, row = rows[-1] if rows else bytes(3 * width), bytearray()
        for x, v in enumerate(line[1:]):
            a, b, c = row[x - 3] if x > 2 else 0, up[x], up[x - 3] if x > 2 else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row.append((v + (0, a, b, (a + b) // 2, paeth)[line[0]]) % 256)
        rows.append(bytes(row))
    return width, height, rows


def plain_feature(width, height, rows):
    colours = [sum(sum(row[c::3]) for row in rows) * 1000 // (width * height) for c in range(3)]
    edges = sum(abs(row[x + 3] - row[x]) for row in rows for x in range(3 * width - 3))
    return f"{width}x{height} mean {colours[0]},{colours[1]},{colours[2]} edges {edges}"


def test_op4(spark, tables, rows):
    out = answer(spark, tables, "op4_media_sequences")
    assert [k for _, k in out.select("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes").dtypes] == ["bigint"] * 5
    _, stored, _ = media.pages_with_media(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text"))
    files = {hashlib.sha256(r["media"]).hexdigest(): r["media"] for r in stored.collect()}
    want = []
    for i, t in rows:
        items = plain_page(t)
        place, payload = next((n, x[1]) for n, x in enumerate(items) if x[-1] == f"{len((t or '').encode())} bytes")
        texts = "\n".join(f"{n}:{hashlib.sha256(x[1].encode()).hexdigest()}" for n, x in enumerate(items) if x[0] == "text")
        lines = [f"-1:texts:{hashlib.sha256(texts.encode()).hexdigest()}:", *(f"{n}:media:{hashlib.sha256(x[1]).hexdigest()}:{x[2]}" for n, x in enumerate(items) if x[0] == "media")]
        width, height = 64, len(payload) // 192
        pixels = [payload[k : k + 192] for k in range(0, len(payload), 192)]
        want.append((i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), plain_feature(width, height, pixels), place, len(items), sum(x[0] == "media" for x in items), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    same(out, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "position", "items", "n_media", "sequence_sha256"], want)
    for r in out.collect():  # the stored file, read by the rules of its format
        file = files[r["media_sha256"]]
        width, height, pixels = decoded(file)
        assert len(file) == r["media_bytes"] and hashlib.sha256(b"".join(pixels)).hexdigest() == r["payload_sha256"] and plain_feature(width, height, pixels) == r["feature"]


def test_op5(spark, tables):
    mail = {1: {0: "hello there\nyou", 1: "> hello there\n> you\nok", 2: "> > hello there\n> > you\n> ok\nok"}, 2: {0: "", 1: "> \n"}}
    want = [(c, t, *v) for c, m in mail.items() for t, v in plain_replies(m).items()]
    want += [r for r in want if r[:2] == (1, 2)] + [(None, 1, 1, None, 0, 0), (2, None, None, None, 0, 0)]  # a row that occurs twice, and rows without a place
    same(answer(spark, tables, "op5_quotation_linking"), ["conv_id", "turn", "thread_turn", "parent_turn", "depth", "quoted"], want)


def test_op6(spark, tables, rows):
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    out = {}
    for r in answer(spark, tables, "op6_pii").collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    for i, t in rows:
        base = plain_base(t or "")
        every = [(a, b, k) for a, b, k, _ in pii.all_spans([t or ""], pii.model())[0]]
        assert set(base) <= set(every)
        want = {"base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(every), "n_spans": len(every)} | {f"n_{k}": sum(x[2] == k for x in base) for k in pii.KINDS}
        assert any(all(r[c] == v for c, v in want.items()) for r in out[i]), t
    assert any("name:" in r["spans"] and "secret:" in r["spans"] for r in out[9])


def test_op7(spark, tables):
    raw = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    out = answer(spark, tables, "op7_exact_topk")
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    same(out, ["query_id", "rank", "vec_id", "score"], plain_top(raw))


def test_op8(spark, tables, rows):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    out = answer(spark, tables, "op8_best_fit_packing")
    assert dict(out.dtypes)["piece"] == "int"
    same(out, ["doc_id", "piece", "start", "length", "ids_crc32"], want)
    places = defaultdict(list)
    for r in out.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and [o for o, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist() for p in places.values())
    assert len(places) <= 1 + -(-sum(w[3] for w in want) // 2048)


def test_op9(spark, tables, rows):
    lexicon = toxicity.learn(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    out = answer(spark, tables, "op9_toxicity").collect()
    assert len(out) == len(rows) and Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    scores = defaultdict(list)
    for r in out:
        assert r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)
        scores[r["doc_id"]].append(r["score"])
    for i, t in rows:
        assert any(s == pytest.approx(plain_score(lexicon, t or "")[0]) for s in scores[i])


def test_op10(spark, tables, rows):
    fps = [plain_fingerprint(t or "") for _, t in rows]
    groups = plain_components(fps)
    least = {g: min((rows[j][0] for j, h in enumerate(groups) if h == g and rows[j][0] is not None), default=None) for g in groups}
    same(answer(spark, tables, "op10_simhash"), ["doc_id", "fingerprint", "component_id"], [(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, groups, strict=True)])


def test_empty_tables(spark, none):
    for name, f in queries.queries().items():
        assert f(spark, none).count() == 0, name


# ---- the pipeline ----------------------------------------------------------------------------------------------------


def plain_pipeline(rows, lexicon):
    """Rows ``(doc_id, text, extra)`` after toxicity, near duplicates and masking, one by one."""
    kept = [r for r in rows if plain_score(lexicon, r[1] or "")[0] < 0.7]
    groups = plain_components([plain_fingerprint(r[1] or "") for r in kept])
    first = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    out = []
    for g in sorted(set(groups)):
        out.append(min((r for r, h in zip(kept, groups, strict=True) if h == g), key=first))
    masked = []
    for i, text, extra in out:
        new, done = "", 0
        for a, b, kind, _ in pii.all_spans([text or ""], pii.model())[0]:
            if a >= done:
                new += text[done:a] + f"<{kind}>"
            done = max(done, b)
        masked.append((i, text if text is None else new + text[done:], extra))
    return masked


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    base = labelled(spark, 240)
    texts = [r["text"] for r in base.collect()]
    rows = [(r["doc_id"], r["text"], "a") for r in base.collect()]
    rows += [(1000 + i, t, "b") for i, t in enumerate(texts[:30])] + [(5, texts[7], "c"), (5, "other words under the same known id as before", "d"), (5, "other words under the same known id as before", "d")]
    rows += [(None, texts[9], "e"), (None, "nobody knows the id of this text at all", "f"), (None, "nobody knows the id of this text at all", "f"), (None, None, "g"), (77_000, None, "h"), (77_001, "", "i")]
    rows += [(78_000 + i, "write to a.b@c.de or 10.0.0.1 about number " + " ".join(rng.choices("abcdefgh", k=30)), "j") for i in range(5)] + [(79_000, "word next " * 3000, "k"), (79_001, "my name is Tom Berg .", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_duplicate_key string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "tags": F.create_map(F.lit("k"), F.lit(1))})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    base.select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = plain_pipeline(rows, lexicon)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns, name
        frame.write.parquet(f"{tmp_path}/out-{name}")
        frame = spark.read.parquet(f"{tmp_path}/out-{name}")
    same(frame, ["doc_id", "text", "near_duplicate_key"], want)
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    pieces = []
    for i, t, _ in want:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        pieces += [(i, n, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    out = corpus_pipeline.run(spark, str(tmp_path))
    same(out, ["doc_id", "piece", "length", "ids_crc32"], pieces)
    left = {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("pipeline-*/*")}
    assert left == {"3"}  # of every run only the result
