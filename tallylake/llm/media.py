"""Interleaved document sequences: text and media in reading order, media payloads resolved by digest.

HTML is parsed into ordered items, each text or a media reference (digest and caption). References are exploded with their positions and
joined with a media table on the digest; every digest with more than ``PER_SALT`` references is salted on both sides, some 256 references a salt. What was read back of the media meets the page's
texts by position again, so each page is one sequence, whose digest covers the place, kind, content and caption of all its items.
Media are stored as losslessly compressed images of 8-bit samples: rows of 64 RGB pixels, 192 bytes each.

Cases: a null or empty text or page has no text item; a reference whose digest the media table lacks keeps its place with a null payload; repeated rows
keep their own items; equal payloads are stored once; an empty table gives an empty table; extra columns of the media table are carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, text_or_empty

ROW = 192
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,items:int,kind:string,text:string,digest:string,caption:string>>"
#: References to a hot digest that one salt holds, about.
PER_SALT = 256
#: Paragraphs of a page that share a figure.
GROUP = 16

# ---- stored form: PNG, 8-bit RGB, 64 pixels wide -------------------------------------------------------------------


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def stored(payload: bytes) -> bytes:
    """The payload, a multiple of 192 bytes, as a PNG file."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # each row after its filter type, 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def read_back(png: bytes) -> bytes:
    """The samples of a stored image."""
    at, data = 8, []
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IDAT":
            data.append(png[at + 8 : at + 8 + size])
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean of each colour in 1/1000, and the edges along the rows, of the samples."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3).astype(np.int64)
    means = (1000 * pixels.sum((0, 1)) // (pixels.shape[0] * pixels.shape[1])).tolist()
    edges = int(np.abs(np.diff(pixels, axis=1)).sum())
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean {means[0]},{means[1]},{means[2]} edges {edges}"


def payload_of(text: Column) -> Column:
    """The UTF-8 bytes of a text, with spaces up to a positive multiple of 192."""
    size = F.octet_length(text)
    pad = F.when(size == 0, ROW).otherwise(F.pmod(-size, F.lit(ROW)))
    return F.encode(F.concat(text, F.repeat(F.lit(" "), pad.cast("int"))), "UTF-8")


def stored_form(payload: Column) -> Column:
    """The stored form of a payload column."""

    def store(payloads: pa.Array) -> pa.Array:
        return pa.array([None if p is None else stored(p) for p in payloads.to_pylist()], pa.binary())

    return F.arrow_udf(store, "binary")(payload)


PROBE = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def probed(media: Column) -> Column:
    """What is read back from a column of stored media."""
    return F.arrow_udf(probe, PROBE)(media)


def probe(media: pa.Array) -> pa.Array:
    rows = []
    for m in media.to_pylist():
        if m is None:
            rows.append(None)
            continue
        p = read_back(m)
        rows.append({"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": feature(p)})
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    return pa.array(rows, pa.struct(kinds))


# ---- HTML -> ordered items -------------------------------------------------------------------------------------------


class ItemParser(HTMLParser):
    """Text between block tags and media references, in order. A figure's caption goes to the media of that figure."""

    BLOCKS = frozenset("p div article section li h1 h2 h3 h4 h5 h6 br figure tr td blockquote pre".split())
    SILENT = frozenset(("script", "style"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.silent = 0

    def flush(self):
        text = "".join(self.words).strip()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            src = dict(attrs).get("src") or ""
            if src.startswith(SCHEME):
                self.flush()
                item = {"kind": "media", "text": None, "digest": src[len(SCHEME) :], "caption": dict(attrs).get("alt")}
                self.items.append(item)
                if self.figure is not None:
                    self.figure.append(item)
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            for item in self.figure or ():
                item["caption"] = "".join(self.caption).strip()
            self.caption = None
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parsed(html: str) -> list[dict]:
    parser = ItemParser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [item | {"position": i, "items": len(parser.items)} for i, item in enumerate(parser.items)]


def items_of(html: Column) -> Column:
    """The ordered items of an HTML column."""
    return F.arrow_udf(parsed_all, ITEMS)(html)


def parsed_all(pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("items", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    return pa.array([[] if p is None else parsed(p) for p in pages.to_pylist()], kind)


# ---- the sequence ----------------------------------------------------------------------------------------------------


def sequence(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per item of every page: its columns but ``html``, then ``position, items, kind, text, digest, caption``: its place, and the number of items of its page."""
    return pages.withColumn("item", F.explode(items_of(F.col(html)))).drop(html, "text").select("*", "item.*").drop("item")


def once_per_digest(media: DataFrame) -> DataFrame:
    """One row per (digest, salt): map-side first, so that a hot payload leaves each task once."""
    rest = [c for c in media.columns if c not in ("digest", "salt")]
    return media.groupBy("digest", "salt").agg(*(F.first(c).alias(c) for c in rest))


def resolved(items: DataFrame, media: DataFrame, counts: DataFrame) -> DataFrame:
    """``items`` with the columns of ``media`` (column ``digest``, repeats allowed) at every reference, in place.

    ``counts``: ``digest, n``, the number of references to each digest, from which hot ones are told.
    """
    hot = checkpointed(counts.where(F.col("n") > PER_SALT).select("digest", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    refs = items.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64(*[c for c in items.columns if c != "caption"]), salts).cast("int")).drop("salts")
    copies = media.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return refs.join(once_per_digest(copies), ["digest", "salt"], "left").drop("salt")


def pages_with_media(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents`` as interleaved pages and their media: ``(pages, media, counts)``.

    Every document becomes a page with each line of its text as a paragraph. After each ``GROUP`` of them comes a figure of the first of these, and after the first half of the groups one whose media holds
    the whole text. A digest that many documents share is stored by one of them alone.
    """
    t = text_or_empty(text)
    whole = docs.select("doc_id", t.alias("text")).withColumn("payload", payload_of(F.col("text")))
    whole = whole.withColumn("digest", F.sha2("payload", 256))
    lines = F.split("text", "\n")
    firsts = F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(GROUP)), lambda i: F.get(lines, i))
    digests = F.transform(firsts, lambda x: F.sha2(payload_of(x), 256))
    escaped = F.transform(lines, lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    figure = lambda digest, *caption: F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>'), F.concat_ws(" ", *caption), F.lit("</figcaption></figure>"))
    laid = whole.select("doc_id", "digest", F.octet_length("text").alias("n_bytes"), escaped.alias("lines"), digests.alias("digests"))
    group = lambda d, i: F.concat(F.lit("<p>"), F.array_join(F.slice("lines", i * GROUP + 1, F.lit(GROUP)), "</p><p>"), F.lit("</p>"), figure(d, F.lit("paragraph"), i * GROUP + 1))
    half = F.ceil(F.size("digests") / 2).cast("int")
    laid = laid.select("doc_id", "digest", "n_bytes", half.alias("half"), F.transform("digests", group).alias("groups"))
    html = F.concat(F.lit("<article>"), F.array_join(F.slice("groups", F.lit(1), F.col("half")), ""), figure(F.col("digest"), "n_bytes", F.lit("bytes")), F.array_join(F.slice("groups", F.col("half") + 1, F.size("groups")), ""), F.lit("</article>"))
    pages = laid.select("doc_id", html.alias("html"))
    counts = whole.select("doc_id", F.explode(F.concat(F.array("digest"), digests)).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
    counts = checkpointed(counts.where(F.col("n") > 1))
    kept = F.broadcast(hot_keys(counts, "n").select("digest", "keeper"))
    own = F.array(F.struct("digest", "payload"))
    small = F.transform(F.array_distinct(firsts), lambda x: F.struct(F.sha2(payload_of(x), 256).alias("digest"), payload_of(x).alias("payload")))
    stored_by = whole.select("doc_id", F.explode(F.concat(own, small)).alias("m")).select("doc_id", "m.*").join(kept, "digest", "left").where(F.col("keeper").isNull() | (F.col("keeper") == F.col("doc_id")))
    media = stored_by.select("digest", stored_form(F.col("payload")).alias("media"))
    return pages, media, counts.select("digest", "n")


def page_sequences(pages: DataFrame, media: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per page: ``doc_id``, what is read back of the figure of its whole text (caption ``n bytes``) with its ``position``, and ``items, n_media, sequence_sha256`` of all its items.

    The page's texts are one digest of their places and contents from the start; each of its media is a line of place, payload read back (none, where it is missing) and caption. ``sequence_sha256`` covers them in order.
    """
    named = pages.withColumn("page", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "html")))
    listed = named.select("doc_id", "page", items_of(F.col("html")).alias("list"))
    texts = F.transform(F.filter("list", lambda x: x["kind"] == "text"), lambda x: F.concat_ws(":", x["position"], F.sha2(x["text"], 256)))
    # The page's own name is no digest of any media, and spreads the rows of texts.
    item = lambda place, kind, digest, caption, content: F.struct(place.alias("position"), F.lit(kind).alias("kind"), digest.alias("digest"), caption.alias("caption"), content.cast("binary").alias("content"))
    own = item(F.lit(-1), "texts", F.col("page"), F.lit(None).cast("string"), F.unhex(F.sha2(F.array_join(texts, "\n"), 256)))
    refs = F.transform(F.filter("list", lambda x: x["kind"] == "media"), lambda x: item(x["position"], "media", x["digest"], x["caption"], F.lit(None)))
    rows = listed.select("doc_id", F.unhex("page").alias("page"), F.size("list").alias("items"), F.explode(F.concat(refs, F.array(own))).alias("i")).select("doc_id", "page", "items", "i.*")
    found = resolved(rows, media, counts).withColumn("probe", probed(F.col("media")))
    main = F.endswith("caption", F.lit(" bytes"))
    whole = F.first(F.when(main, F.struct("doc_id", "position", "items", "caption", "probe")), ignorenulls=True)
    # Rows that repeat have the same page: a set holds each of its items once, from the start.
    each = F.collect_set(F.struct("position", "kind", F.coalesce("content", F.unhex("probe.payload_sha256")).alias("content"), "caption"))
    page = found.groupBy("page").agg(whole.alias("w"), F.array_sort(each).alias("lines"), F.count_if(F.col("kind") == "texts").alias("n"))
    line = F.transform("lines", lambda x: F.concat_ws(":", x["position"], x["kind"], F.coalesce(F.lower(F.hex(x["content"])), F.lit("")), F.coalesce(x["caption"], F.lit(""))))
    out = page.select("n", "w.*", F.sha2(F.array_join(line, "\n"), 256).alias("sequence_sha256"), (F.size("lines") - 1).cast("long").alias("n_media"))
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("_", "n")
