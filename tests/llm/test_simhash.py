"""SimHash fingerprints and components, against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from tallylake.llm import simhash
from tallylake.llm.common import join_skewed


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = list(range(len(fps)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in ["", " \t\r\n", "One", "one TWO", "a b c", "a b c d a b c d", "É é x\x1cy z\x85w", "x y z " * 200]:
        assert simhash.simhash(text) == plain_fingerprint(text)
    long = " ".join(f"w{i % 977}" for i in range(3000))
    assert simhash.simhash(long, block=257) == plain_fingerprint(long)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(spark, fps, dense):
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    edges = simhash.links(df, dense)
    return {r["node"]: r["root"] for r in simhash.components(edges).collect()}


def compare(spark, fps, dense):
    roots = linked(spark, fps, dense)
    mine = [roots.get(signed(f), signed(f)) for f in fps]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == label) for label in set(labels))
    assert groups(mine) == groups(plain_components(fps))


def near(f, n, rng):
    for b in rng.sample(range(64), n):
        f ^= 1 << b
    return f


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, 1, 3, 7, 15, (1 << 64) - 1]
    for _ in range(40):
        f = rng.choice(fps)
        for n in (1, 2, 3, 3, 4, 4):
            f = near(f, n, rng)
            fps.append(f)
    compare(spark, fps, simhash.DENSE)


def test_dense_groups_equal_brute_force(spark):
    rng = random.Random(6)
    core = rng.getrandbits(64)
    fps = [core ^ (rng.getrandbits(32) << 32 & 0x3F3F << 40) for _ in range(60)] + [near(core, 4, rng) for _ in range(60)] + [rng.getrandbits(64) for _ in range(30)]
    compare(spark, fps, 3)


def test_documents(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(20)]
    texts = base + base[:5] * 3 + [b + " extra" for b in base[:8]] + ["", None, " ", "only", "Only"] + ["same text here"] * 60
    df = spark.createDataFrame([(1000 + 7 * i, t, "kept") for i, t in enumerate(texts)] + [(None, base[0], "kept"), (None, "alone and unknown text", "x")], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(texts) + 2
    fps = [plain_fingerprint(t or "") for t in texts]
    expected = plain_components(fps)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    for i, f in enumerate(fps):
        r = by_id[1000 + 7 * i]
        assert (r["fingerprint"], r["component_id"]) == (f"{f:016x}", 1000 + 7 * expected[i])
    assert sorted((r["component_id"] is None) for r in out if r["doc_id"] is None) == [False, True]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_of_links(spark):
    f, fps = 0, []
    for i in range(0, 60, 3):
        f ^= 0b111 << i
        fps.append(f)
    roots = linked(spark, fps, simhash.DENSE)
    assert len(set(roots.values())) == 1 and len(roots) == 20


def test_hot_keys_are_split(spark):
    """Both sides come straight from a shuffle, so Spark splits the partition of a key that a third of the rows have."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("a"), F.col("id").alias("b"))
        joined = join_skewed(rows, rows.groupBy("a").agg(F.min("b").alias("m")), "a")
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
