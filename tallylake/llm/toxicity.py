"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alikes and digit substitutions.

Learning takes at most ``SAMPLE`` labelled documents of either class (those whose ids hash lowest), equal texts of a class once; rows of the held-out
third are never seen. Terms are folded words and their beginnings of 4 characters or more; of words beyond 32 letters only the beginnings at whose length some word of the sample parts from another are counted, since
those in between are held by the same documents as the next shorter one, which would be taken before them. Strong terms, whose log-likelihood ratio is ``STRONG`` of the best one's or more,
enter the lexicon by rank, unless a chosen term is their beginning or continues them, or tells much the same documents. (Near copies of one document share many words,
which all tell the same copies: one of them enters.) Then, again and again, the term with the highest ratio over the toxic documents that no chosen term tells, as long as it is ``EVIDENCE`` or more. Longer terms
under a chosen beginning follow if they have the evidence and weigh clearly more; of the terms at one place the longest counts. Words that hold a term, and
pairs of neighbouring words around it, that clean documents hold at least as often as toxic ones become exception phrases: what they cover does not count,
and weights, smoothed log odds, are counted again without it. A text's score is the logistic function of its weights' sum, normalised by the logarithm of its length in words, and of its
largest weight, fitted by Newton steps on the same sample, where every document is measured with weights that leave it out. Only ``SAMPLE`` bounds what is learned from: no number of terms,
phrases or characters is cut.

Cases: a null or empty text has no matches and scores the intercept; a null doc_id is held out by no rule, so ``held_out`` is false, and no label belongs to it; equal texts have equal scores; repeated rows are scored each; without any toxic
label in the sample all texts score the share of toxic rows; labels, language, source and ids are no inputs; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import math
import os
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: At most so many labelled documents of either class are learned from.
SAMPLE = 4000
#: Length of the shortest beginning, and length up to which all beginnings are counted one by one.
SHORTEST, DENSE_TO = 4, 32
#: Log-likelihood ratio that a term needs; share of the best one's from which a term is strong; overlap of documents (Jaccard) from which terms tell the same.
EVIDENCE, STRONG, SAME = 18.0, 0.25, 0.8
#: Terms that a task holds before it hands them on.
HELD = 100_000
#: How much more a longer term weighs; strong terms that come to the driver at once.
MARGIN, PAGE = 0.5, 500
FOUND = [("rank", pa.float64()), ("ratio", pa.float64()), ("term", pa.string()), ("docs", pa.list_(pa.int64())), ("clean", pa.int64())]
FOUND_SQL = "rank double, ratio double, term string, docs array<bigint>, clean bigint"

# Digits and signs that stand for letters, and look-alikes from Greek and Cyrillic.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
LOOKALIKES = dict(zip("αβεικνορτυχаеорсухіјѕԁһкмтвн", "abeiknoptuxaeopcyxijsdhkmtbh", strict=True))
#: Phrases that are never toxic, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish")


class Fold(dict):
    """Translation table, filled as characters come: lower case, look-alikes and substitutes as letters, all that is no letter as white space."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code).lower())
        c = "".join(SUBSTITUTES.get(x) or LOOKALIKES.get(x, x) for x in c)
        out = self[code] = c if c.isalpha() else "" if unicodedata.category(chr(code)).startswith("M") else " "
        return out


class Bare(dict):
    """Translation table that takes the accents off letters."""

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        return out


FOLD, BARE = Fold(), Bare()


def folded(text: str) -> str:
    """The folded words, then once more those with accents, without them: accents tell words apart, and are used to hide them. Words have single spaces around them."""
    t = " ".join(text.translate(FOLD).split())
    if t.isascii():
        return f" {t} "
    return f" {t}  {' '.join(' '.join(w for w in t.split(' ') if not w.isascii()).translate(BARE).split())} "


def terms_of(text: str) -> set[str]:
    """The terms of a folded text: `` word `` and `` stem`` of each word, stems up to ``DENSE_TO`` letters."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), DENSE_TO) + 1))
    return out


def log_odds(a: int, b: int, n_a: int, n_b: int) -> float:
    return math.log((a + 0.5) / (n_a - a + 0.5)) - math.log((b + 0.5) / (n_b - b + 0.5))


def likelihood_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Of a of n_a toxic and b of n_b clean documents holding a term, against one common share."""
    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)

    p, p_a, p_b = (a + b) / (n_a + n_b), a / n_a, b / n_b
    return 2 * (part(a, n_a, p_a) + part(b, n_b, p_b) - part(a, n_a, p) - part(b, n_b, p))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def built(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self.automaton.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                self.automaton.add_word(f" {folded(phrase).strip()} ", (len(folded(phrase).strip()) + 2, None))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` in a folded text, without those inside an exception phrase."""
        if not len(self.built()):
            return []
        found: dict[int, tuple[int, float]] = {}
        ends, covered = -1, []  # phrases in the order of their ends; those inside another one are left out
        for last, (size, w) in self.automaton.iter(text):
            if w is not None:
                found[last + 1 - size] = (last + 1, w)  # of terms with one start the longest comes last
            else:
                while covered and covered[-1][0] >= last + 1 - size:
                    covered.pop()
                covered.append((last + 1 - size, last + 1))
        if not covered:
            return [(a, b, w) for a, (b, w) in found.items()]
        out, at = [], 0
        for start in sorted(found):
            while at < len(covered) and covered[at][0] <= start:
                ends, at = max(ends, covered[at][1]), at + 1
            if found[start][0] > ends:
                out.append((start, *found[start]))
        return out

    def features(self, text: str, weights: dict[str, float] | None = None) -> tuple[float, float]:
        """The sum of weights by the logarithm of the words, and the largest. ``weights``: others than the lexicon's own, for its terms."""
        t = folded(text)
        found = [w if weights is None else weights[t[a:b]] for a, b, w in self.matches(t)]
        return (sum(found) / math.log2(1 + t.count(" ")), max(found)) if found else (0.0, 0.0)

    def score(self, text: str) -> float:
        a, b, c = self.logistic
        x, y = self.features(text)
        z = a + b * x + c * y
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc, text, toxic`` of at most ``sample`` labelled documents of either class, none of them held out; equal texts of a class once. ``doc`` tells texts apart."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    once = rows.groupBy(F.sha2("text", 256).alias("hash"), "toxic").agg(F.first("text").alias("text"))
    return once.select(F.xxhash64("hash").alias("doc"), "text", "toxic")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, docs, clean``: the toxic documents that hold a term, and the number of clean ones; of some documents at a time, so a term may come again."""
    docs, clean = defaultdict(list), Counter()

    def out() -> pa.RecordBatch:
        terms = [*(docs.keys() | clean.keys())]
        held = pa.array([docs.get(t, []) for t in terms], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "docs": held, "clean": pa.array([clean[t] for t in terms], pa.int64())})

    for batch in batches:
        for doc, text, toxic in zip(batch["doc"].to_pylist(), batch["text"], batch["toxic"].to_pylist(), strict=True):
            terms = terms_of(folded(text.as_py()))
            if toxic:
                for t in terms:
                    docs[t].append(doc)
            else:
                clean.update(terms)
            if len(docs) + len(clean) > HELD:
                yield out()
                docs.clear()
                clean.clear()
    yield out()


def long_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``start, word, doc, toxic``: the words of a text beyond ``DENSE_TO`` letters, once each."""
    for batch in batches:
        found = [(f" {w[:DENSE_TO]}", w, doc, toxic) for doc, text, toxic in zip(*(batch[c].to_pylist() for c in ("doc", "text", "toxic")), strict=True) for w in {*folded(text).split()} if len(w) > DENSE_TO]
        columns = zip(*found, strict=True) if found else ((),) * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["start", "word", "doc", "toxic"])


def long_beginnings(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``term, docs, clean`` of the beginnings beyond ``DENSE_TO`` letters that 3 toxic documents hold, at the lengths where words part. ``counts``: the same of shorter ones, of which only those go on.

    Sorted words part from others where neighbours part, so the lengths come from neighbours, once for all words of a start.
    """

    @F.arrow_udf("int")
    def parts_at(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if y is None else len(os.path.commonprefix((x, y))) + 1 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    starts = counts.where((F.length("term") == DENSE_TO + 1) & ~F.endswith("term", F.lit(" "))).select(F.col("term").alias("start"))
    words = checkpointed(rows.mapInArrow(long_words, "start string, word string, doc bigint, toxic int").join(starts, "start", "left_semi"))
    sorted_words = words.select("start", "word").distinct().withColumn("before", F.lag("word").over(W.partitionBy("start").orderBy("word")))
    neighbours = sorted_words.select("start", parts_at("word", "before").alias("n"))
    parting = F.array_union(F.collect_set("n"), F.array(F.lit(DENSE_TO + 1)))
    lengths = neighbours.groupBy("start").agg(parting.alias("lengths"))
    terms = words.join(lengths, "start").select("doc", "toxic", "word", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("word"))
    held = terms.select(F.concat(F.lit(" "), F.left("word", F.col("n"))).alias("term"), "doc", "toxic").distinct()
    return held.groupBy("term").agg(F.collect_list(F.when(F.col("toxic") == 1, F.col("doc"))).alias("docs"), F.count_if(F.col("toxic") == 0).alias("clean")).where(F.size("docs") >= 3)


def candidates(rows: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """``term, docs, clean, ratio`` of every term that 3 toxic documents hold, and toxic ones over four times as often as clean ones."""

    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likelihood_ratio(x, y, n_toxic, n_clean) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    counts = rows.mapInArrow(counted, "term string, docs array<bigint>, clean bigint").groupBy("term").agg(F.flatten(F.collect_list("docs")).alias("docs"), F.sum("clean").alias("clean"))
    counts = checkpointed(counts.where(F.size("docs") >= 3))
    every = counts.unionByName(long_beginnings(rows, counts))
    enough = every.where(F.size("docs") * F.lit(n_clean) > F.col("clean") * F.lit(4 * n_toxic))
    return enough.withColumn("ratio", ratio(F.size("docs"), F.col("clean")))


class Chosen(dict):
    """Chosen terms and their weights, that tell terms which one of them begins, and their beginnings, in the time of a few look-ups."""

    def __init__(self, *terms):
        super().__init__(*terms)
        self.sorted, self.sizes = sorted(self), {*map(len, self)}

    def take(self, term: str, weight: float) -> None:
        if term not in self:
            bisect.insort(self.sorted, term)
            self.sizes.add(len(term))
        self[term] = weight

    def under(self, term: str) -> str | None:
        """The longest chosen term that a term continues."""
        return max((x for n in self.sizes if n < len(term) and (x := term[:n]) in self), key=len, default=None)

    def free(self, term: str) -> bool:
        """Whether a term neither is a beginning of a chosen one, nor continues one."""
        at = bisect.bisect_left(self.sorted, term)
        return not (at < len(self.sorted) and self.sorted[at].startswith(term)) and self.under(term) is None

    def __reduce__(self):
        return Chosen, (dict(self),)


def chosen_terms(terms: DataFrame, n_toxic: int, n_clean: int) -> Chosen:
    """The lexicon's first terms and their weights, from ``candidates``, all of which take part: strong ones page by page, then a greedy cover of the documents not told.

    Each page and each term of the cover is one aggregate. The driver holds a page, the chosen terms and which documents of the sample they tell, as bits of an integer.
    """
    out = Chosen()
    bit: dict[int, int] = {}
    tells: list[int] = []

    def bits(docs: list[int]) -> int:
        return sum(1 << bit.setdefault(d, len(bit)) for d in docs)

    def take(t: str, docs: list[int], clean: int) -> None:
        out.take(t, log_odds(len(docs), clean, n_toxic, n_clean))
        tells.append(bits(docs))

    def told() -> list[int]:
        every = 0
        for x in tells:
            every |= x
        return [d for d, i in bit.items() if every >> i & 1]

    best = terms.agg(F.max("ratio")).first()[0]
    if best is None:
        return out
    place = F.struct((-F.col("ratio")).alias("ratio"), F.length("term").alias("size"), "term").alias("place")
    strong = terms.where(F.col("ratio") >= max(EVIDENCE, STRONG * best)).select(place, "docs", "clean")
    page = strong.orderBy("place").limit(PAGE).collect()
    while page:
        for r in page:
            if out.free(t := r["place"]["term"]):
                x = bits(r["docs"])
                if all((x & c).bit_count() < SAME * (x | c).bit_count() for c in tells):
                    take(t, r["docs"], r["clean"])
        last = F.struct(*(F.lit(x).alias(n) for n, x in r["place"].asDict().items()))
        page = strong.where(F.col("place") > last).orderBy("place").limit(PAGE).collect() if len(page) == PAGE else []

    def best_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best free term of these, over the documents not told."""
        top = None
        for batch in batches:
            held = [np.array(d, np.int64) for d in batch["docs"].to_pylist()]
            ends = np.cumsum([len(d) for d in held])
            is_open = np.concatenate(([0], np.cumsum(~np.isin(np.concatenate(held), known)))) if held else np.zeros(1, np.int64)
            for i, (t, b) in enumerate(zip(batch["term"].to_pylist(), batch["clean"].to_pylist(), strict=True)):
                a = int(is_open[ends[i]] - is_open[ends[i] - len(held[i])])
                if a >= 3 and a * n_clean > b * left and out.free(t):
                    rank = (-likelihood_ratio(a, b, left, n_clean), -batch["ratio"][i].as_py(), len(t), t)
                    if top is None or rank < top[0]:
                        top = rank, t, batch["docs"][i].as_py(), b
        if top is not None and -top[0][0] >= EVIDENCE:
            yield pa.RecordBatch.from_pylist([{"rank": -top[0][0], "ratio": -top[0][1], "term": top[1], "docs": top[2], "clean": top[3]}], pa.schema(FOUND))

    while True:
        known = np.array(sorted(told()), np.int64)
        left = n_toxic - len(known)
        r = terms.mapInArrow(best_open, FOUND_SQL).orderBy(F.desc("rank"), F.desc("ratio"), F.length("term"), "term").first() if left >= 3 else None
        if r is None:
            return out
        take(r["term"], r["docs"], r["clean"])


def longer_terms(terms: DataFrame, chosen: Chosen, n_toxic: int, n_clean: int) -> Chosen:
    """``chosen`` and the terms with enough evidence that continue one of them and weigh clearly more than the longest one they continue."""

    def continuing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([chosen.under(t) is not None for t in batch["term"].to_pylist()], pa.bool_()))

    strong = terms.where(F.col("ratio") >= EVIDENCE).select("term", F.size("docs").alias("a"), "clean")
    rows = strong.mapInArrow(continuing, "term string, a int, clean bigint").collect() if chosen else []
    out = Chosen(chosen)
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        t, w = r["term"], log_odds(r["a"], r["clean"], n_toxic, n_clean)
        if t not in out and w > out[out.under(t)] + MARGIN:
            out.take(t, w)
    return out


def around(text: str, lexicon: Lexicon) -> set[str]:
    """Words that hold a match, and pairs of neighbouring words around it."""
    t = folded(text)
    out = set()
    for start, _, _ in lexicon.matches(t):
        ends = t.find(" ", start + 1)
        word = t[start + 1 : ends]
        before, after = t[t.rfind(" ", 0, start) + 1 : start], t[ends + 1 : max(ends + 1, t.find(" ", ends + 1))]
        out.add(word)
        if before:
            out.add(f"{before} {word}")
        if after:
            out.add(f"{word} {after}")
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton steps; the intercept is not penalised."""
    design = np.column_stack((np.ones(len(x)), x))
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + penalty, design.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from labelled documents. What comes to the driver, terms and phrases of the sample that have the evidence, is bounded by ``sample``."""
    rows = checkpointed(training_rows(docs, labels, sample))  # 2 * sample rows at most
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.0
        return Lexicon({}, exceptions, (math.log(share / (1 - share)) if share else -30.0, 0.0, 0.0))
    terms = checkpointed(candidates(rows, n_toxic, n_clean))
    lexicon = Lexicon(longer_terms(terms, chosen_terms(terms, n_toxic, n_clean), n_toxic, n_clean), exceptions)

    @F.arrow_udf("array<string>")
    def contexts(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(around(t, lexicon)) for t in texts.to_pylist()], pa.list_(pa.string()))

    phrases = rows.select("toxic", F.explode(contexts(F.col("text"))).alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    harmless = phrases.where((F.col("clean") >= 3) & (F.col("toxic") * n_clean <= F.col("clean") * n_toxic)).orderBy(F.desc("clean"), "phrase").collect()
    lexicon = Lexicon(lexicon.weights, (*exceptions, *(r["phrase"] for r in harmless)))

    @F.arrow_udf("array<string>")
    def matched(texts: pa.Array) -> pa.Array:
        folds = map(folded, texts.to_pylist())
        return pa.array([sorted({t[a:b] for a, b, _ in lexicon.matches(t)}) for t in folds], pa.list_(pa.string()))

    again = rows.select("toxic", F.explode(matched(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in again.collect() if log_odds(r["toxic"], r["clean"], n_toxic, n_clean) > 0}
    lexicon = Lexicon({t: log_odds(*counts[t], n_toxic, n_clean) for t in lexicon.weights if t in counts}, lexicon.exceptions)
    # A document's own count is taken off the weights that it is measured with.
    without = [{t: log_odds(a - k, max(0, b - 1 + k), n_toxic - k, n_clean - 1 + k) if a - k >= 0 else 0.0 for t, (a, b) in counts.items()} for k in (0, 1)]

    @F.arrow_udf("struct<x:double,y:double>")
    def measured(texts: pa.Array, toxic: pa.Array) -> pa.Array:
        pairs = [lexicon.features(t, without[k]) for t, k in zip(texts.to_pylist(), toxic.to_pylist(), strict=True)]
        x, y = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], ["x", "y"])

    data = np.array([tuple(r) for r in rows.select(measured(F.col("text"), F.col("toxic")).alias("m"), "toxic").select("m.x", "m.y", "toxic").collect()])  # 2 * sample rows at most
    order = np.lexsort(data.T)
    lexicon.logistic = logistic_fit(data[order, :2], data[order, 2])
    return lexicon


def score(text: Column, lexicon: Lexicon) -> Column:
    """Toxicity of a text column, from 0 to 1. The lexicon is sent with the function."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(t) for t in texts.to_pylist()], pa.float64())

    return scored(F.coalesce(text, F.lit("")))
