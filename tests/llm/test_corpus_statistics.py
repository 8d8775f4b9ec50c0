"""Class n-grams, the filter audit and spelling variants against plain versions, and against files that come later."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylake.llm import class_ngrams, filter_audit, queries, spelling

from .test_queries import none, rows, tables  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit ----------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """``docs``: ``(doc_id, text, source)``; ``labels``: ``(doc_id, quality, toxic)``."""
    least = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""].append(i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = ["A"] * (len(w) < 200) + ["B"] * (100 * len(set(w)) < 50 * len(w)) + ["C"] * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + ["D"] * bool(re.search("[#$%&*|]", t))
        fails += ["E"] * (i is not None and min(least[t]) < i)
        parts[s or ""].append((frozenset(fails), i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, own in parts.items():
        removed, lines = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                left = [d for d in own if not d[0] & set(order[:step])]
                gone = [d for d in left if f in d[0]]
                removed[f] += len(gone)
                redundant = sum(f in d[0] for d in own) - len(gone)
                lines.append((part, order, step + 1, len(left) - len(gone), len(gone), redundant, sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_op12(spark, tables, rows):  # noqa: F811
    out = queries.op12_filter_audit(spark, tables)
    labels = [tuple(r) for r in spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, out.select(AUDITED).collect())) == plain_audit([(i, t, "s") for i, t in rows], labels)
    assert {t for c, t in out.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}


def test_later_files_retract_earlier_ones(spark, tmp_path):
    rng = random.Random(3)
    texts = ["few words here", "many " * 300, "A LOT OF CAPITALS IN HERE", "signs # here", " ".join(map(str, range(300))), "", None]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(40)] + [(7, texts[0], "c"), (7, texts[0], "c"), (None, texts[0], "a"), (None, texts[1], "b")]
    labels = [(i, i % 2, i % 3 == 0 and 1) for i in range(0, 40, 2)] + [(4, None, 1), (4, 1, None)]
    known = spark.createDataFrame([(i, q, int(x) if x is not None else None) for i, q, x in labels], "doc_id long, quality int, toxic int")
    docs.sort(key=lambda d: (d[0] is not None, -(d[0] or 0)))  # small ids come last

    def put(some):
        spark.createDataFrame([(*d, "x") for d in some], "doc_id long, text string, source string, text_key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")

    def run():
        return filter_audit.orders_of(filter_audit.counted(spark, f"{tmp_path}/docs", known, f"{tmp_path}/state", batches=3, together=2))

    for first in range(0, 30, 10):
        put(docs[first : first + 10])
    assert sorted(map(tuple, run().select(AUDITED).collect())) == plain_audit(docs[:30], labels)
    assert len(list((tmp_path / "state/counters").glob("batch=*"))) == 3
    put(docs[30:])
    for _ in range(2):  # started again: the new file only, then none
        assert sorted(map(tuple, run().select(AUDITED).collect())) == plain_audit(docs, labels)
    assert len(list((tmp_path / "state/counters").glob("batch=*"))) == 4
    # A text of many rows reaches its state as one row a batch of rows.
    again = spark.createDataFrame([(i, "same text", "a") for i in range(500)], "doc_id long, text string, source string")
    shrunk = filter_audit.judged(again.coalesce(1), known).coalesce(1).mapInArrow(filter_audit.combined, "text_key string, doc_id bigint, held string, lost string")
    assert shrunk.count() == 1


# ---- spelling variants -------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0])


SPELLED = ["word", "form", "root", "n", "n_near", "form_n"]


def test_op13(spark, tables, rows):  # noqa: F811
    out = queries.op13_spelling_variants(spark, tables)
    assert sorted(map(tuple, out.select(SPELLED).collect()), key=lambda r: r[0]) == plain_variants(rows)
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(60)] + ["prefix" + "".join(rng.choices("ab", k=4)) for _ in range(40)]

    def slip(w):
        i, c = rng.randrange(len(w)), rng.choice("abéÀ×")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w])

    docs = [(i, rng.choice([" ", ", ", "1", "Ā"]).join(rng.choice([w, w.upper(), slip(w), slip(slip(w))]) for w in rng.choices(stems, k=60))) for i in range(240)] + [(None, "aaaaa " * 9), (None, None), (1, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_variants(docs)
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 100 and any(r[2] != r[1] and r[1] for r in want)
    for tile in (16, 1024):  # buckets in many blocks, and in one
        assert sorted(map(tuple, spelling.variants(frame, tile).select(SPELLED).collect()), key=lambda r: r[0]) == want


def test_tiles_stay_small_and_meet(spark):
    """A beginning that all words share: no tile is larger than some two blocks, and every two words meet."""
    words = spark.range(600).select(F.concat(F.lit("samebeginning"), F.lpad(F.conv("id", 10, 26), 4, "0")).alias("word"), F.lit(3).cast("long").alias("n"))
    dealt = spelling.tiles(words, 32)
    sizes = dealt.groupBy("bucket", "low", "high").count()
    assert sizes.agg(F.max("count")).first()[0] < 32 * 8
    found = {frozenset((r["word"], r["near"])) for r in spelling.near_words(words, 32).collect()}
    every = [r["word"] for r in words.collect()]
    assert found == {frozenset(p) for p in itertools.combinations(every, 2) if one_edit(*p)}


def test_near_pairs_of_long_and_wide_words():
    a = ["x" * 5000, "x" * 5001, "😀abcd", "😀abce", "abcd", "x" * 5000 + "y"]
    i, j = spelling.near_pairs(a, a)
    assert {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)} == {(x, y) for x in range(6) for y in range(6) if x != y and one_edit(a[x], a[y])}


# ---- class n-grams -----------------------------------------------------------------------------------------------------


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_base(docs):
    count = Counter(t for i, x in docs if not is_held_out(i) for t in tokens_of(x))
    n, v = sum(count.values()), len(count)
    return [(i, is_held_out(i), len(w := tokens_of(x)), sum(count[t] > 0 for t in w), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 6)) for i, x in docs]


def plain_class_scores(docs, classes, k):
    """Scores by dictionaries, from the words' classes."""
    count = Counter(t for i, x in docs if not is_held_out(i) for t in tokens_of(x))
    once, twice = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    d = (once + 0.5) / (once + 2 * twice + 1)
    size, types = Counter(), Counter()
    for w, c in classes.items():
        size[c] += count[w]
        types[c] += 1
    grams = [Counter(), Counter(), Counter()]
    for i, x in docs:
        if not is_held_out(i):
            own = [0, 0] + [0 if t is None else classes[t] for t in tokens_of(x)]
            for a, b, c in zip(own, own[1:], own[2:], strict=False):
                grams[0][c,] += 1
                grams[1][b, c] += 1
                grams[2][a, b, c] += 1

    def discounted(g):
        once, twice = sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())
        return (once + 0.5) / (once + 2 * twice + 1)

    total = sum(c + 0.5 for c in grams[0].values())

    def p(context, c):
        if None in context:
            return p(context[context.index(None) + 1 :] if context[-1] is not None else (), c)
        if not context:
            return (grams[0][c,] + 0.5) / total if grams[0][c,] else 0.0
        g = grams[len(context)]
        n = {x[-1]: v for x, v in g.items() if x[:-1] == context}
        dd = discounted(g)
        return (max(n.get(c, 0) - dd, 0) + dd * len(n) * p(context[1:], c)) / sum(n.values()) if n else p(context[1:], c)

    out = []
    for _, x in docs:
        score, context = 0.0, (0, 0)
        for t in tokens_of(x):
            if t is None:
                score += math.log10(p(context, 0))
            elif t in classes:
                c = classes[t]
                score += math.log10(p(context, c) * (count[t] - d) / size[c])
                context = (context[1], c)
            else:
                score += math.log10(sum(p(context, c) * d * types[c] / size[c] for c in range(1, k) if size[c]))
                context = (context[1], None)
        out.append(score)
    return out


def test_op11(spark, tables, rows):  # noqa: F811
    out = queries.op11_class_ngrams(spark, tables)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert [(*x[:5], pytest.approx(x[5])) for x in sorted(plain_base(rows), key=key)] == sorted(got, key=key)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out.collect())


@pytest.fixture(scope="module")
def corpus():
    """Two languages whose words never mix, and words that few texts have."""
    rng = random.Random(9)
    kinds = [[f"{p}{i}" for i in range(60)] for p in ("north", "south")]
    docs = []
    for i in range(300):
        words = rng.choices(kinds[i % 2], weights=[1 / (r + 1) for r in range(60)], k=rng.randint(1, 40))
        docs.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words) + rng.choice(["", f" only{i // 3}", f"\tnever{i}"])))
    return [*docs, (5, docs[5][1]), (5, docs[5][1]), (None, "north1 south1"), (301, None), (310, ""), (20, "unheard of words north1")]


def test_class_scores_equal_brute_force(spark, corpus, tmp_path):
    frame = spark.createDataFrame([(*d, "x") for d in corpus], "doc_id long, text string, key string").repartition(3)
    for name, options in (("small", {"k": 6, "top": 20, "dictionary": 60, "rounds": 4}), ("all", {"k": 4, "top": 100, "dictionary": 1000, "rounds": 3})):
        found = class_ngrams.clusters(frame, f"{tmp_path}/{name}", **options)
        classes = {r["word"]: r["class"] for r in found.collect()}
        count = Counter(t for i, x in corpus if not is_held_out(i) for t in tokens_of(x) if t)
        assert {r["word"]: r["n"] for r in found.collect()} == dict(count) and all(0 < c < options["k"] for c in classes.values())
        out = class_ngrams.scored(frame, **options)
        want = plain_class_scores(corpus, classes, options["k"])
        key = lambda r: tuple((x is not None, x) for x in r)
        got = sorted(((r["doc_id"], r["n_tokens"], round(r["score"], 7)) for r in out.collect()), key=key)
        assert got == [(i, n, pytest.approx(s, abs=1e-6)) for i, n, s in sorted(((i, len(tokens_of(x)), round(s, 7)) for (i, x), s in zip(corpus, want, strict=True)), key=key)]
        held = [r for r in out.collect() if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
        assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in held)


def test_exchange_tells_the_languages_apart(spark, corpus, tmp_path):
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    of = {r["word"]: r["class"] for r in class_ngrams.clusters(frame, f"{tmp_path}/two", k=9, top=60, dictionary=100, rounds=5).collect()}
    sides = {p: Counter(c for w, c in of.items() if w.startswith(p)) for p in ("north", "south")}
    mixed = sum(min(sides["north"][c], sides["south"][c]) for c in range(9))
    assert mixed <= 8, sides  # of 120 words


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.3, (7, 7, 7))
    counts[:, :, 6] = counts[:, 6] = counts[6] = 0  # a class without words
    unknown = rng.random(7) * 0.2
    table = 10 ** class_ngrams.transitions(counts, unknown)
    assert np.allclose(table[..., :7].sum(-1), 1)
    assert np.allclose(table[..., 7], (table[..., :7] * unknown).sum(-1))


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if is_held_out(i)][:3]
    out = class_ngrams.scored(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out] == [(3, 0, 0, 0.0, 0.0)] * 3
