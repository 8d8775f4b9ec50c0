"""Bootstrap intervals of means over tasks.

A task's value is a ratio of small counts, so few values are distinct. Resampling tasks with replacement then depends on the histogram of values
alone: a resampled histogram is multinomial. The cost does not grow with the number of tasks. Where a group has more than ``FAN`` values, they
are the leaves of a tree, and the draws go down it by conditional splits: a node's draws are dealt to its children as another multinomial, so no task ever holds more than the children of a
node, and the leaves return sums of a replicate, not counts. The other method draws Poisson(1) weights
from a hash of task and replicate; it is built of SQL functions only and merges across partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylake.sources.runlog import checkpointed


def histogram(values: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    return values.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))


#: Children of a node of the tree of values, about, at most.
FAN = 1000


def generator(seed: int, key: Sequence) -> np.random.Generator:
    """Random numbers that depend on a seed and a name alone, so a task that is run again draws the same."""
    named = hashlib.sha256(repr((seed, *map(str, key))).encode()).digest()
    return np.random.default_rng(int.from_bytes(named[:8], "little"))


def histogram_intervals(values: DataFrame, groups: Sequence[str], value: str = "value", n_boot: int = 2000, alpha: float = 0.05, seed: int = 0, fan: int = FAN) -> DataFrame:
    """``groups, mean, ci_low, ci_high``: quantiles of ``n_boot`` multinomial resamples of each group's histogram, whatever its number of values."""
    hist = checkpointed(histogram(values, groups, value).withColumnRenamed(value, "value"))
    most = hist.groupBy(*groups).count().agg(F.max("count")).first()[0] or 1
    levels = 0
    while fan ** (levels + 1) < most:
        levels += 1
    # Nodes of one level have about as many children as those of the next.
    return tree_intervals(hist, groups, levels, n_boot, alpha, seed, math.ceil(most ** (1 / (levels + 1)))) if levels else flat_intervals(hist, groups, n_boot, alpha, seed)


def flat_intervals(hist: DataFrame, groups: Sequence[str], n_boot: int, alpha: float, seed: int) -> DataFrame:
    """The intervals of groups of few values, each in one draw."""
    kinds = dict(hist.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", mean double, ci_low double, ci_high double"

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        v, n = part["value"].to_numpy(float), part["n"].to_numpy(np.int64)
        total = int(n.sum())
        counts = generator(seed, key).multinomial(total, n / total, size=n_boot)
        low, high = np.quantile(counts @ v / total, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*key, float(v @ n / total), low, high]], columns=[*groups, "mean", "ci_low", "ci_high"])

    return hist.groupBy(*groups).applyInPandas(draw, schema)


def tree_intervals(hist: DataFrame, groups: Sequence[str], levels: int, n_boot: int, alpha: float, seed: int, fan: int) -> DataFrame:
    """The intervals by a tree of ``levels`` levels between a group and its values, which a hash deals to its nodes."""
    kinds = dict(hist.dtypes)
    path = [f"_{i}" for i in range(levels)]
    named = ", ".join(f"{g} {kinds[g]}" for g in groups)
    dealt = hist.withColumns({p: F.pmod(F.xxhash64("value", F.lit(i)), F.lit(fan)).cast("int") for i, p in enumerate(path)})
    totals = hist.groupBy(*groups).agg(F.sum("n").alias("total"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    draws = totals.select(*groups, F.array_repeat("total", n_boot).alias("draws"))

    def splitter(above: Sequence[str], own: str):
        def split(key: tuple, children: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
            children = children.sort_values(own)
            n = children["n"].to_numpy(np.int64)
            counts = generator(seed, key).multinomial(np.asarray(node["draws"].iat[0], np.int64), n / n.sum())
            out = pd.DataFrame({c: [k] * len(n) for c, k in zip(above, key, strict=True)})
            return out.assign(**{own: children[own].to_numpy(), "draws": list(counts.T)})

        return split

    for i in range(levels):
        above, own = [*groups, *path[:i]], path[i]
        sums = dealt.groupBy(*above, own).agg(F.sum("n").alias("n"))
        schema = ", ".join([named, *(f"{p} int" for p in path[: i + 1]), "draws array<bigint>"])
        draws = sums.groupBy(*above).cogroup(draws.groupBy(*above)).applyInPandas(splitter(above, own), schema)

    def leaves(key: tuple, part: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        v, n = part["value"].to_numpy(float), part["n"].to_numpy(np.int64)
        counts = generator(seed, key).multinomial(np.asarray(node["draws"].iat[0], np.int64), n / n.sum())
        out = pd.DataFrame({c: [k] * n_boot for c, k in zip(groups, key, strict=False)})
        return out.assign(replicate=np.arange(n_boot, dtype=np.int32), s=counts @ v)

    key = [*groups, *path]
    parts = dealt.groupBy(*key).cogroup(draws.groupBy(*key)).applyInPandas(leaves, f"{named}, replicate int, s double")
    sums = parts.groupBy(*groups, "replicate").agg(F.sum("s").alias("s"))
    bounds = sums.groupBy(*groups).agg(F.percentile("s", F.lit(alpha / 2)).alias("low"), F.percentile("s", F.lit(1 - alpha / 2)).alias("high"))
    same = F.lit(True)
    for g in groups:
        same = same & totals[g].eqNullSafe(bounds[g])
    met = totals.join(bounds, same)
    return met.select(*(totals[g] for g in groups), "mean", (F.col("low") / F.col("total")).alias("ci_low"), (F.col("high") / F.col("total")).alias("ci_high"))


def poisson_bounds(most: int = 8) -> list[float]:
    """Cumulative probabilities of Poisson(1) for 0 .. most - 1."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)]).tolist()


def poisson_weight(name: Column) -> Column:
    """A Poisson(1) weight from the MD5 of a name: the first 32 bits against the cumulative probabilities."""
    first = F.substring(F.md5(name), 1, 8)  # of eight digits each, hexadecimal numbers compare as texts
    return sum((F.when(first >= f"{math.ceil(b * 2**32):08x}", 1).otherwise(0) for b in poisson_bounds()), F.lit(0))


def poisson_replicates(values: DataFrame, groups: Sequence[str], task: str = "task_id", value: str = "value", replicates: int = 100) -> DataFrame:
    """``groups, replicate, mean``: weighted means of each replicate, combined map-side."""
    some = values.where(F.col(value).isNotNull()).select(*groups, task, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    w = some.withColumn("w", poisson_weight(F.concat_ws("|", F.col(task), F.col("replicate").cast("string"))))
    return w.groupBy(*groups, "replicate").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0)).cast("double")).alias("mean"))


def poisson_intervals(values: DataFrame, groups: Sequence[str], task: str = "task_id", value: str = "value", replicates: int = 100, alpha: float = 0.05) -> DataFrame:
    means = poisson_replicates(values, groups, task, value, replicates)
    return means.groupBy(*groups).agg(F.percentile("mean", F.lit(alpha / 2)).alias("ci_low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("ci_high"))
