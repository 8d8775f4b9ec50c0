"""URL filtering, media sequences and quotation linking, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallylake.llm import media, quotes, url_filter

ALLOW = [("com", "/"), ("www.example.com", "/en/")]
BLOCK = [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("bad.org", "")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, rules in (("allow", ALLOW), ("block", BLOCK)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    None, "", "nothing", "://", "http://", "http:///en/", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/a", "https://a.www.example.com/en/", "http://example.com/EN/", "http://example.com", "http://example.com?x=/en/",
    "http://net/fr/", "http://a.net/es/1", "http://a.net/es", "http://anet/es/", "http://x.bad.org", "http://bad.org:80/", "http://com/", "http://com", "http://a..com/", "ftp://É.Com/x\ny", "http://a.net/fr/#://b", "http://user@b.com/",
]


def test_urls(spark):
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "net", "b.net", "bad.org", "good.org", "x.y.z.com"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['/en/', '/fr/', '/es/', '/', ''])}{i}" for i in range(300)] + ["http://hot.net/fr/same"] * 100
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, key string")
    out = url_filter.judged(df, url_filter.rules_frame(spark, ALLOW), url_filter.rules_frame(spark, BLOCK)).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"]), r["url"]


def test_long_lists(spark, monkeypatch):
    """Filters of many literals, and lists that take several passes."""
    monkeypatch.setattr(url_filter, "MOST_BYTES", 64)
    monkeypatch.setattr(url_filter, "BLOCK", 16)
    hosts = [f"h{i}.net" for i in range(400)]
    df = spark.createDataFrame([(i, f"http://a.{h}/x/{i}", 1) for i, h in enumerate(hosts)], "page_id long, url string, url_filter_hits int")
    block = url_filter.rules_frame(spark, [(h, "/x/") for h in hosts[::3]])
    allow = url_filter.rules_frame(spark, [(h, "/x/") for h in hosts[1::3]] + [("net", "/")])
    for segments in (1, 1000):
        monkeypatch.setattr(url_filter, "MOST_SEGMENTS", segments)
        out = url_filter.judged(df, allow, block).collect()
        assert len(out) == 400 and set(out[0].asDict()) == {"page_id", "url", "url_filter_hits", "host", "path", "rule", "verdict"}
        for r in out:
            i = r["page_id"]
            assert (r["rule"], r["verdict"]) == ((f"{hosts[i]}/x/", "block") if i % 3 == 0 else (f"{hosts[i]}/x/", "allow") if i % 3 == 1 else ("net/", "allow"))


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = url_filter.rules_frame(spark, [])
    assert url_filter.judged(df, none, none).first()["verdict"] == "allow"
    assert url_filter.judged(df.where("false"), url_filter.rules_frame(spark, ALLOW), url_filter.rules_frame(spark, BLOCK)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judged(df, url_filter.rules_frame(spark, ALLOW), url_filter.rules_frame(spark, ALLOW))


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = spark.range(0, 3000, 17).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.Cascade(listed, universe)
    got = universe.where(cascade.contains(F.col("key"))).count()
    assert len(cascade.levels) >= 2
    assert got == listed.count() and universe.where(cascade.contains(F.col("key"))).join(listed, "key", "left_anti").count() == 0


def test_media_round_trip():
    for payload in [b" " * 192, bytes(range(192)), b"xy" * 960]:
        assert media.read_back(media.stored(payload)) == payload
    assert media.feature(b" " * 192) == "64x1 mean 32000,32000,32000 edges 0"


def test_parsed_items():
    html = '<p>one &amp; two</p><script>no</script><figure><img src="sha256:aa"><img src="sha256:bb"><figcaption>both</figcaption></figure>tail<img src="http://x"><img src="sha256:cc" alt="c">'
    got = [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.parsed(html)]
    assert got == [(0, "text", "one & two", None, None), (1, "media", None, "aa", "both"), (2, "media", None, "bb", "both"), (3, "text", "tail", None, None), (4, "media", None, "cc", "c")]
    assert media.parsed("") == [] and media.parsed("<p>") == []


def padded(text):
    raw = text.encode()
    return raw + b" " * (-len(raw) % 192 if raw else 192)


def plain_page(text):
    """The items of a page: ``("text", text)`` or ``("media", payload, caption)``."""
    t = text or ""
    lines, out = t.split("\n"), []
    groups = [lines[i : i + 16] for i in range(0, len(lines), 16)]
    for k, group in enumerate(groups):
        out += [("text", x.strip()) for x in group if x.strip()] + [("media", padded(group[0]), f"paragraph {16 * k + 1}")]
        if k == (len(groups) + 1) // 2 - 1:
            out.append(("media", padded(t), f"{len(t.encode())} bytes"))
    return out


def test_media_sequences(spark):
    texts = ["hello <b> & more\nsecond line", "", None, "x" * 192, "é" * 100, " ", "hot"] + ["hot"] * 300 + ["long " * 5000, "line\n" * 40, "\n".join(map(str, range(33)))]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, texts[0], "n"), (None, "no id", "n")], "doc_id long, text string, digest string")
    pages, stored, counts = media.pages_with_media(docs.select("doc_id", "text"))
    items = media.sequence(pages)
    found = media.resolved(items.where("kind = 'media'"), stored, counts).withColumn("probe", media.probed(F.col("media"))).select("doc_id", "position", "caption", "probe.*").collect()
    want = [(i, n, x[1], x[2]) for i, t in [*enumerate(texts), (0, texts[0]), (None, "no id")] for n, x in enumerate(plain_page(t)) if x[0] == "media"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["position"], r["payload_sha256"], r["caption"]) for r in found), key=key)
    assert got == sorted(((i, n, hashlib.sha256(p).hexdigest(), c) for i, n, p, c in want), key=key)
    payloads = {hashlib.sha256(p).hexdigest(): p for _, _, p, _ in want}
    for r in found:
        payload = payloads[r["payload_sha256"]]
        assert r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["feature"] == media.feature(payload)
        assert r["media_sha256"] == hashlib.sha256(media.stored(payload)).hexdigest() and r["media_bytes"] == len(media.stored(payload))
    hot = counts.where("n > 256").collect()  # a digest of many references is salted by its count, and stored a few times only
    assert [r["n"] for r in hot] == [602] and stored.where(F.col("digest") == hot[0]["digest"]).count() <= 2


def test_pages_hold_every_line(spark):
    texts = ["a\n\nb & c\n <d> \ne", "one", None, "\n\nlast", "x &amp; y\n" * 501, "1\n2\n3\n4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pages, _, _ = media.pages_with_media(docs)
    got = {}
    for r in media.sequence(pages).collect():
        got.setdefault(r["doc_id"], {})[r["position"]] = ("text", r["text"]) if r["kind"] == "text" else ("media", r["digest"], r["caption"])
    for i, t in enumerate(texts):
        assert [got[i][n] for n in range(len(got[i]))] == [x if x[0] == "text" else ("media", hashlib.sha256(x[1]).hexdigest(), x[2]) for x in plain_page(t)]


def test_missing_media_keep_their_place(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:none"><p>b</p>'), (2, None)], "page_id long, html string")
    items = media.sequence(pages)
    none = spark.createDataFrame([], "digest string, media binary")
    counts = items.where("kind = 'media'").groupBy("digest").agg(F.count("*").alias("n"))
    out = media.resolved(items, none, counts).orderBy("position").collect()
    assert [(r["kind"], r["media"]) for r in out] == [("text", None), ("media", None), ("text", None)]


def test_quotes(spark):
    rows = [
        (1, 0, "user", "First line\nsecond  line"), (1, 1, "bot", "> first LINE\nanswer one"), (1, 2, "user", ">> First line\n> answer one\nmore"), (1, 3, "bot", "> unknown\nnew"), (1, 4, "user", " > new\n>second line\n\nend\n"),
        (2, 0, "user", "> first line\nx"), (2, 1, "bot", None), (2, 2, "bot", ""), (2, 2, "bot", "zz"), (None, 3, "bot", "x"), (2, None, "bot", "x"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, level string")
    every = quotes.reply_ordered(df).collect()
    out = {(r["conv_id"], r["turn"]): r for r in every}
    assert len(every) == 11 and len(out) == 10  # each row has its own result
    got = {k: (r["thread_turn"], r["parent_turn"], r["depth"], r["quoted"]) for k, r in out.items()}
    assert got[1, 0] == (0, None, 0, 0) and got[1, 1] == (0, 0, 1, 1) and got[1, 2] == (0, 1, 2, 2) and got[1, 3] == (3, None, 0, 0)
    assert got[1, 4] == (0, 0, 1, 1) and got[2, 0] == (0, None, 0, 0)
    assert out[1, 2]["formatted"] == "<|user|>\nmore\n<|end|>" and out[1, 4]["formatted"] == "<|user|>\nend\n<|end|>" and out[2, 1]["formatted"] == "<|bot|>\n\n<|end|>"
    assert sorted(r["formatted"] for r in every if (r["conv_id"], r["turn"]) == (2, 2)) == ["<|bot|>\n\n<|end|>", "<|bot|>\nzz\n<|end|>"]
    assert [out[k]["formatted"] for k in ((None, 3), (2, None))] == ["<|bot|>\nx\n<|end|>"] * 2


def plain_replies(rows):
    """Brute force over one conversation's ``{turn: text}``: ``{turn: (thread_turn, parent_turn, depth, quoted)}``."""
    def clean(line):
        m = re.match(r"[ \t]*(>[ \t]*)+", line)
        bare = line[m.end() :] if m else line
        return (m[0].count(">") if m else 0), re.sub(r"[ \t\r]+", " ", re.sub("[A-Z]", lambda c: c[0].lower(), bare)).strip(" ")

    parts = {}
    for turn, text in rows.items():
        runs = itertools.groupby(map(clean, (text or "").split("\n")), key=lambda x: x[0])
        parts[turn] = [(lv, kept) for lv, some in runs if (kept := [x for _, x in some if x])]
    own = {t: {" ".join(x) for lv, x in p if lv == 0} for t, p in parts.items()}
    own_lines = {t: {y for lv, x in p if lv == 0 for y in x} for t, p in parts.items()}
    parent, quoted = {}, {}
    for t, p in parts.items():
        hits = []
        for lv, x in p:
            if lv:
                whole = [o for o in own if o < t and " ".join(x) in own[o]]
                by = Counter()
                for y in x:
                    if some := [o for o in own_lines if o < t and y in own_lines[o]]:
                        by[max(some)] += len(y)
                if whole or by:
                    hits.append((lv, -max(whole) if whole else -max(by, key=lambda o: (by[o], o))))
        parent[t], quoted[t] = (-min(hits)[1] if hits else None), len(hits)
    out = {}
    for t in rows:
        top, depth = t, 0
        while parent[top] is not None:
            top, depth = parent[top], depth + 1
        out[t] = (top, parent[t], depth, quoted[t])
    return out


@pytest.mark.parametrize("bits", [1, 10])
def test_quotes_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(quotes, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    words = ["ok", "Yes", "no  way", "a longer line of text", "", "thanks", "x"]
    talks = {c: {t: "\n".join("> " * rng.choice([0, 0, 1, 1, 2]) + rng.choice(words) for _ in range(rng.randint(0, 7))) for t in range(rng.choice([1, 5, 20, 40]))} for c in range(12)}
    talks[90] = {0: "ok", 1: "ok", 2: "> ok\nfine"}
    talks[91] = {0: "A", 1: "B", 3: "A\nB", 4: "> A\n> B\nseen"}
    talks[92] = {0: "one two three\nfour five", 5: "> one two\n> three four\n> five\nyes", 2000: "> yes", 9000: ">> yes\n> nothing"}
    df = spark.createDataFrame([(c, t, "u", x) for c, m in talks.items() for t, x in m.items()], "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["thread_turn"], r["parent_turn"], r["depth"], r["quoted"]) for r in quotes.reply_ordered(df).collect()}
    assert got == {(c, t): v for c, m in talks.items() for t, v in plain_replies(m).items()}
    assert got[90, 2][1] == 1 and got[91, 4][1] == 3 and got[92, 5][1] == 0 and got[92, 9000][:2] == (0, 5)


def test_every_text_of_a_turn_is_a_message_and_a_writer(spark):
    rows = [(1, 0, "u", "hello"), (1, 0, "v", "another text"), (1, 0, "v", "another text"), (1, 1, "u", "> hello\nyes"), (1, 1, "w", "> another text\nno"), (1, 2, "u", "> no\nwhy"), (1, 3, "u", "> yes\nfine"), (None, 1, "u", "> hello\nlost"), (1, None, "u", "> hello\nlost")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = quotes.reply_ordered(df)
    got = sorted(((r["conv_id"] is None, r["turn"] if r["turn"] is not None else -1, r["role"], r["parent_turn"], r["thread_turn"], r["depth"], r["formatted"].split("\n", 1)[1].removesuffix("\n<|end|>")) for r in out.collect()), key=str)
    want = [(False, 0, "u", None, 0, 0, "hello"), (False, 0, "v", None, 0, 0, "another text"), (False, 0, "v", None, 0, 0, "another text"), (False, 1, "u", 0, 0, 1, "yes"), (False, 1, "w", 0, 0, 1, "no"),
            (False, 2, "u", 1, 0, 2, "why"), (False, 3, "u", 1, 0, 2, "fine"), (True, 1, "u", None, 1, 0, "lost"), (False, -1, "u", None, None, 0, "lost")]
    assert got == sorted(want, key=str)
    mail = sorted((r["turn"], r["text"]) for r in quotes.as_mail(df).where("conv_id = 1 AND turn < 3").collect())
    assert mail[:3] == [(0, "another text"), (0, "another text"), (0, "hello")] and [t for n, t in mail if n == 1] == ["> another text\n> another text\nno", "> another text\n> hello\nyes"]


def test_quotes_of_nothing_and_long_chains(spark):
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    chain = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    out = quotes.reply_ordered(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["thread_turn"] == 0 and r["depth"] == r["turn"] for r in out)
    mail = {r["turn"]: r["text"] for r in quotes.as_mail(spark.createDataFrame([(1, 0, "u", "a\nb"), (1, 1, "v", "c"), (1, 2, "u", "d")], "conv_id long, turn long, role string, text string")).collect()}
    assert mail == {0: "a\nb", 1: "> a\n> b\nc", 2: "> > a\n> > b\n> c\nd"}
