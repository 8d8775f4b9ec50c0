"""Exact top-k inner-product search by norm buckets.

Rows of one id and one vector come together first, with their number. Vectors are bucketed by length on a geometric scale; a bucket is dealt to blocks by a hash, so a crowded length is many blocks. Every query first
meets the ``HEAD`` longest vectors, which gives a lower bound of its k-th best score. From it follows the least length that a better
vector can have, and queries are bucketed by that length: a query block meets only blocks of vectors that are long enough. Within a block the bound
becomes a local cosine threshold. Where it is high, coordinates prune: a vector whose direction leaves the band that the threshold allows
around the query's largest coordinates is out; where it is low, length alone prunes. What is left is verified by inner products.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as ending in zeros;
ties go to the smaller id; every row is a candidate of every query but itself, and every query row gets its own results, so repeated ids are
candidates each, of each other too, and a query row that occurs twice has its results twice; rows without an id are candidates too, after all others of the same score (inside, the largest long stands for
no id); fewer candidates than k give all; a pair whose score does not fit a long is left out, and no other is; an empty table gives an empty table; extra columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ratio of a bucket's lengths, vectors of a block, queries of a block, and vectors that the first bound comes from.
RATIO, BLOCK, QUERIES, HEAD = 1.05, 8192, 2048, 2048
#: Local cosine threshold from which coordinates prune, and the number of coordinates looked at.
HIGH, FOCUS = 0.5, 4
RUN = 1 << 14
#: What stands for a score that does not fit a long, and for no id.
BEYOND, NO_ID = -(1 << 63), (1 << 63) - 1
NONE = -(1 << 30)  # bucket of zero vectors, and of queries that need every bucket


def whole_vectors(df: DataFrame, is_query: Column, vector: str, vec_id: str, scale: float) -> DataFrame:
    """``vec_id, v, n, asked, norm``: components as floor(scale * x), the number of such rows and of queries among them; vectors with null or non-finite components are left out."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("double"))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & fine).select(F.coalesce(F.col(vec_id).cast("bigint"), F.lit(NO_ID)).alias("vec_id"), x.alias("v"), (is_query & F.col(vec_id).isNotNull()).alias("q"))
    out = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n"), F.count_if("q").alias("asked"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def level(norm: Column) -> Column:
    return F.when(norm > 0, F.floor(F.log(norm) / math.log(RATIO)).cast("int")).otherwise(NONE)


def matrix(lists: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix, zeros at the end of short ones."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of p with the rows of q; ``BEYOND`` for those that do not fit a long."""
    width = max(p.shape[1], q.shape[1])
    p, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (p, q))
    most = float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width)
    if most < 2**53:
        return (p @ q.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(p).dot(whole(q).T)
    return np.where((exact > BEYOND) & (exact <= NO_ID), exact, BEYOND).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def times(n: np.ndarray, p: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int) -> np.ndarray:
    """How often each vector may be among the k best of a query: as often as it occurs, the query's own row left out."""
    out = np.minimum(n, k)
    for i in np.flatnonzero(ids == q_id):
        if (p[i] == q).all():
            out[i] = min(n[i] - 1, k)
    return out


def search_block(p: np.ndarray, ids: np.ndarray, norms: np.ndarray, n: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_norms: np.ndarray, bounds: np.ndarray, k: int):
    """``(place of the query, id, score)`` arrays: the k best of a block for each query, of those that reach its bound (NaN: no bound). ``n``: how often each vector occurs."""
    order = np.lexsort((ids, -norms))
    p, ids, norms, n = p[order], ids[order], norms[order], n[order]
    width = max(p.shape[1], q.shape[1])
    p, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (p, q))
    unit = p / np.where(norms > 0, norms, 1)[:, None]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(i: int, among: np.ndarray, scores: np.ndarray):
        if not math.isnan(bounds[i]):
            enough = scores >= bounds[i]
            among, scores = among[enough], scores[enough]
        often = np.where(scores == BEYOND, 0, times(n[among], p[among], ids[among], q[i], q_ids[i], k))
        among, scores, often = among[often > 0], scores[often > 0], often[often > 0]
        top = best(scores, ids[among], k)
        top = np.repeat(top, often[top])[:k]
        out.append((np.full(len(top), i), ids[among][top], scores[top]))

    least = np.where((bounds > 0) & (q_norms > 0), bounds / np.where(q_norms > 0, q_norms, 1), 0.0)
    least = np.where(np.isnan(least), 0.0, least) * (1 - 1e-9)
    reach = np.searchsorted(-norms, -least, "right")  # vectors long enough
    cosine = np.where(norms[0] > 0, least / max(norms[0], 1e-300), 0.0)
    by_length = np.flatnonzero((cosine < HIGH) & (reach > 0))
    by_length = by_length[np.argsort(reach[by_length], kind="stable")]
    for at in range(0, len(by_length), 128):
        some = by_length[at : at + 128]
        upto = int(reach[some].max())
        scores = products(p[:upto], q[some])
        for j, i in enumerate(some):
            keep(int(i), np.arange(int(reach[i])), scores[: reach[i], j])
    for i in np.flatnonzero((cosine >= HIGH) & (reach > 0)):
        direction, threshold = q[i] / q_norms[i], min(1.0, float(cosine[i]))
        among = np.arange(int(reach[i]))
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            band = math.sqrt(max(0.0, (1 - threshold**2) * (1 - min(1.0, direction[f] ** 2))))
            u = unit[among, f]
            # Beyond the band the cosine stays under the threshold; the far side of the query's own coordinate is never out.
            low = direction[f] * threshold - band - 1e-9 if direction[f] > -threshold else -1.0 - 1e-9
            high = direction[f] * threshold + band + 1e-9 if direction[f] < threshold else 1.0 + 1e-9
            among = among[(u >= low) & (u <= high)]
        if len(among):
            keep(int(i), among, products(p[among], q[i : i + 1])[:, 0])
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def grouped_needs(needs: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Neighbouring levels of need that hold few queries share a block: each level's shared level (the lowest, so that nothing is missed), and the queries of those."""
    shared: dict[int, int] = {}
    merged: dict[int, int] = {}
    group: list[int] = []
    for b in sorted(needs, reverse=True):
        if group and sum(needs[g] for g in group) + needs[b] > QUERIES:
            group = []
        group.append(b)
        for g in group:
            merged.pop(shared.get(g), None)
        shared.update(dict.fromkeys(group, b))
        merged[b] = sum(needs[g] for g in group)
    return shared, merged


def spread(rows: DataFrame, levels: list[tuple[int, int]], level_name: str, block_name: str, wanted) -> DataFrame:
    """``rows`` once for every block of every wanted level. ``levels``: level and its number of blocks."""
    table = F.array(*(F.struct(F.lit(b).alias("l"), F.lit(n).alias("n")) for b, n in levels or [(0, 1)]))
    some = rows.withColumn("_t", F.explode(F.filter(table, lambda t: wanted(t["l"]))))
    return some.withColumn(level_name, F.col("_t.l")).withColumn(block_name, F.explode(F.sequence(F.lit(0), F.col("_t.n") - 1))).drop("_t")


def top_k(df: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", vec_id: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k highest inner products over all rows but itself."""
    rows = whole_vectors(df, is_query, vector, vec_id, scale).withColumn("bucket", level(F.col("norm")))
    counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # at most some 15,000: the range of a double's logarithm
    head = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).select("vec_id", "v", "n").collect()
    width = max((len(r["v"]) for r in head), default=0)
    head_ids, head_n = np.array([r["vec_id"] for r in head], np.int64), np.array([r["n"] for r in head], np.int64)
    head_rows = np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in head]).reshape(len(head), width)

    @F.arrow_udf("double")
    def bound(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        q, out = matrix(vectors), []
        for at in range(0, len(q), 256):
            scores = products(head_rows, q[at : at + 256]) if len(head_ids) else np.zeros((0, len(q[at : at + 256])))
            for j, own in enumerate(ids.to_numpy(zero_copy_only=False)[at : at + 256]):
                same = np.zeros(max(width, q.shape[1]))
                same[: q.shape[1]] = q[at + j]
                often = times(head_n, np.pad(head_rows, ((0, 0), (0, len(same) - width))) if len(same) > width else head_rows, head_ids, same, own, k)
                got = np.repeat(scores[:, j], np.where(scores[:, j] == BEYOND, 0, often))
                out.append(float(np.partition(got, len(got) - k)[len(got) - k]) if len(got) >= k else None)
        return pa.array(out, pa.float64())

    named = F.md5(F.array_join(F.transform("v", lambda x: x.cast("bigint").cast("string")), ","))
    queries = rows.where("asked > 0").withColumns({"bound": bound(F.col("vec_id"), F.col("v")), "query_row": named})
    needed = F.when((F.col("bound") > 0) & (F.col("norm") > 0), level(F.col("bound") * (1 - 1e-9) / F.col("norm")) - 1).otherwise(NONE)
    queries = queries.withColumn("need", needed)
    needs = {r["need"]: r["count"] for r in queries.groupBy("need").count().collect()}
    block_of = lambda n, size: max(1, -(-n // size))
    blocks = F.map_from_entries(F.lit([]).cast("array<struct<a:int,b:int>>")) if not counts else F.create_map(*(F.lit(x) for b, n in counts.items() for x in (b, block_of(n, BLOCK))))
    shared, merged = grouped_needs(needs)
    q_blocks = {b: block_of(n, QUERIES) for b, n in merged.items()}
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.try_element_at(blocks, "bucket")).cast("int"))
    # Every block of vectors goes to the query blocks that need its bucket, every query block to the blocks of all buckets that it needs.
    # The literals hold buckets, whose number is bounded; blocks are counted off on the executors.
    vectors = spread(dealt, sorted(q_blocks.items()), "need", "q_block", lambda need: need <= F.col("bucket"))
    q_map = F.create_map(*(F.lit(x) for b, n in q_blocks.items() for x in (b, n))) if q_blocks else F.create_map(F.lit(0), F.lit(1))
    lowered = F.create_map(*(F.lit(x) for pair in shared.items() for x in pair)) if shared else F.create_map(F.lit(0), F.lit(0))
    asked = queries.drop("bucket").withColumn("need", F.try_element_at(lowered, "need")).withColumn("q_block", F.pmod(F.xxhash64("vec_id", "v"), F.try_element_at(q_map, "need")).cast("int"))
    asked = spread(asked, [(b, block_of(n, BLOCK)) for b, n in sorted(counts.items())], "bucket", "block", lambda bucket: bucket >= F.col("need"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        c = lambda t, name: t[name].to_numpy()
        if left.num_rows and right.num_rows:
            at, ids, scores = search_block(matrix(left["v"]), c(left, "vec_id"), c(left, "norm"), c(left, "n"), matrix(right["v"]), c(right, "vec_id"), c(right, "norm"), c(right, "bound").astype(float), k)
        else:
            at, ids, scores = [np.zeros(0, np.int64)] * 3
        asked_by = right.select(["vec_id", "query_row", "asked"]).take(pa.array(at.astype(np.int64)))
        return pa.table([*asked_by.columns, pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.int64))], names=["query_id", "query_row", "asked", "vec_id", "score"])

    key = ("bucket", "block", "need", "q_block")
    found = vectors.drop("asked").groupBy(*key).cogroup(asked.drop("n").groupBy(*key)).applyInArrow(tile, "query_id bigint, query_row string, asked bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    best_of = found.withColumn("rank", rank).where(F.col("rank") <= k)
    # A query row that occurs many times has its results as often, in runs of a bounded length.
    runs = best_of.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("asked") - 1, F.lit(RUN))))
    each = runs.withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("asked") - F.col("run")).cast("int"))))
    return each.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
