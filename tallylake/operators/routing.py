"""Routers: signal and logistic scores as expressions, training by distributed Newton steps, rank AUC."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylake.functions.signals import FEATURES
from tallylake.functions.splits import in_train_split
from tallylake.operators.ranges import PER_RANGE, cuts, with_before
from tallylake.operators.summary import share
from tallylake.schemas import ROUTERS

LEAST_ROWS = 20


def signal_score(signal: Column) -> Column:
    """A single signal as a score; a missing one never stops a cascade."""
    return F.coalesce(signal.cast("double"), F.lit(-math.inf))


@dataclass
class Logistic:
    features: list[str]
    weights: list[float]
    bias: float
    mean: list[float]
    std: list[float]
    meta: dict[str, str] = field(default_factory=dict)

    def score(self, signals: Mapping[str, Column] | None = None) -> Column:
        """The probability of being correct. Missing features count as their training mean."""
        z = F.lit(self.bias)
        for f, w, m, s in zip(self.features, self.weights, self.mean, self.std, strict=True):
            x = (signals[f] if signals else F.col(f)).cast("double")
            x = F.when(F.isnan(x), None).otherwise(x)
            z = z + F.lit(w) * (F.coalesce(x, F.lit(m)) - F.lit(m)) / F.lit(s)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.features, self.weights, self.bias, self.mean, self.std, self.meta)], ROUTERS).coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Logistic:
        r = spark.read.schema(ROUTERS).json(path).first()
        return cls(list(r["features"]), list(r["weights"]), r["bias"], list(r["mean"]), list(r["std"]), dict(r["meta"] or {}))


def training_rows(records: DataFrame, policy: str, benchmarks: Sequence[str] | None = None, signals: str | None = "signals") -> DataFrame:
    """Records of a policy without error and with signals."""
    out = records.where((F.col("policy") == policy) & F.col("error").isNull())
    out = out.where(F.col("benchmark").isin(*benchmarks)) if benchmarks else out
    return out.where(F.size(signals) > 0) if signals else out


def feature_counts(rows: DataFrame, candidates: Sequence[str] = FEATURES, signals: str | None = "signals") -> DataFrame:
    """``candidate, feature, n``: the place of each candidate and the rows that have it, one aggregate for all."""
    value = lambda f: F.try_element_at(F.col(signals), F.lit(f)) if signals else F.col(f)
    counts = F.array(*(F.struct(F.lit(i).alias("candidate"), F.lit(f).alias("feature"), F.count_if(value(f).isNotNull()).alias("n")) for i, f in enumerate(candidates)))
    return rows.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def present_features(rows: DataFrame, candidates: Sequence[str] = FEATURES, signals: str | None = "signals") -> list[str]:
    """The candidates that any row has, in order."""
    return [r["feature"] for r in feature_counts(rows, candidates, signals).where("n > 0").orderBy("candidate").collect()]


def feature_columns(rows: DataFrame, features: Sequence[str], label: str = "correct", signals: str = "signals", keep: Sequence[str] = ()) -> DataFrame:
    """A narrow table of plain doubles: the signals wanted, and ``y``; and the columns to ``keep``."""
    return rows.select(*keep, *(F.try_element_at(F.col(signals), F.lit(f)).alias(f) for f in features), F.col(label).cast("int").alias("y"))


def fitted(rows: DataFrame, features: Sequence[str], label: str = "y", l2: float = 1.0, rounds: int = 50, meta: dict[str, str] | None = None) -> Logistic:
    """Regularised logistic regression by Newton's method: every step is one aggregate of gradient and Hessian sums over the cached
    narrow columns; only the solve of a matrix of a dozen rows is on the driver. The bias is not penalised.

    Missing values become the mean, constant features have deviation 1. Under 20 rows is an error.
    """
    names = [f"x{i}" for i in range(len(features))]
    plain = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(n) for f, n in zip(features, names, strict=True)]
    data = rows.select(*plain, F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull()).persist()
    stats = data.agg(F.count("*"), *(F.avg(n) for n in names)).first()
    if stats[0] < LEAST_ROWS:
        data.unpersist()
        raise ValueError(f"{stats[0]} rows are too few to train on; {LEAST_ROWS} are needed")
    mean = [float(v) if v is not None else 0.0 for v in stats[1:]]
    spread = data.agg(*(F.stddev_pop(F.coalesce(n, F.lit(m))) for n, m in zip(names, mean, strict=True)), F.lit(0)).first()
    std = [float(s) if s is not None and s >= 1e-8 else 1.0 for s in spread[: len(names)]]
    x = [F.lit(1.0)] + [(F.coalesce(n, F.lit(m)) - F.lit(m)) / F.lit(s) for n, m, s in zip(names, mean, std, strict=True)]
    d = len(x)
    w, penalty = np.zeros(d), np.diag([0.0] + [l2] * (d - 1))
    for _ in range(rounds):
        z = sum((F.lit(float(a)) * b for a, b in zip(w, x, strict=True)), F.lit(0.0))
        scored = data.select(*(c.alias(f"c{i}") for i, c in enumerate(x)), "y", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("p"))
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        gradient = [F.sum((F.col("p") - F.col("y")) * F.col(f"c{i}")) for i in range(d)]
        hessian = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs]
        row = scored.agg(*gradient, *hessian).first()
        h = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[d:], strict=True):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h + penalty + 1e-9 * np.eye(d), np.array(row[:d]) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    data.unpersist()
    return Logistic(list(features), [float(v) for v in w[1:]], float(w[0]), mean, std, meta or {})


def fitted_by(rows: DataFrame, groups: Sequence[str], features: Sequence[str], label: str = "y", l2: float = 1.0, rounds: int = 50) -> dict[tuple, Logistic]:
    """``fitted`` for every group (a policy, a benchmark, a split), all in one: each round is one job, whose gradient and Hessian sums are grouped.
    Rows that agree in group, features and label are one with their number, so a round reads the distinct ones.

    The driver holds a few numbers a group; groups are of a configuration, not of the data. A group whose steps have ended takes no part in later rounds; one with under 20 rows has no router.
    """
    groups, k = list(groups), len(features)
    plain = F.array(*(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features)) if features else F.array().cast("array<double>")
    known = rows.select(*groups, plain.alias("x"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull())
    data = known.groupBy(*groups, "x", "y").agg(F.count("*").cast("double").alias("n")).persist()
    spark = rows.sparkSession
    kinds = ", ".join(f"{g} {t}" for g, t in data.dtypes if g in groups)

    def met(frame: DataFrame, values: dict[tuple, Sequence], columns: str) -> DataFrame:
        """``frame`` with numbers of its groups, for the groups that have any."""
        names = [f"_{g}" for g in groups]
        table = spark.createDataFrame([(*key, *v) for key, v in values.items()], f"{kinds}, {columns}").withColumnsRenamed(dict(zip(groups, names, strict=True)))
        same = F.lit(True)
        for g, n in zip(groups, names, strict=True):
            same = same & F.col(g).eqNullSafe(F.col(n))
        return frame.join(table, same).drop(*names)

    key_of = lambda r: tuple(r[g] for g in groups)
    stats = {key_of(r): r for r in data.groupBy(*groups).agg(F.sum("n").alias("n"), *((F.sum(F.get("x", i) * F.col("n")) / F.sum(F.when(F.get("x", i).isNotNull(), F.col("n")))).alias(f"m{i}") for i in range(k))).collect()}
    mean = {key: [float(r[f"m{i}"]) if r[f"m{i}"] is not None else 0.0 for i in range(k)] for key, r in stats.items() if r["n"] >= LEAST_ROWS}
    if not mean:
        data.unpersist()
        return {}
    filled = met(data, {key: (m,) for key, m in mean.items()}, "mean array<double>").withColumn("x", F.transform("x", lambda v, i: F.coalesce(v, F.get("mean", i))))
    spread = filled.groupBy(*groups).agg(F.lit(0).alias("none"), *(F.sqrt(F.sum(F.col("n") * (F.get("x", i) - F.get("mean", i)) * (F.get("x", i) - F.get("mean", i))) / F.sum("n")).alias(f"s{i}") for i in range(k))).collect()
    std = {key_of(r): [float(s) if (s := r[f"s{i}"]) is not None and s >= 1e-8 else 1.0 for i in range(k)] for r in spread}
    scaled = met(filled, {key: (s,) for key, s in std.items()}, "std array<double>")
    design = scaled.select(*groups, "y", "n", F.concat(F.array(F.lit(1.0)), F.transform("x", lambda v, i: (v - F.get("mean", i)) / F.get("std", i))).alias("x")).persist()
    d = k + 1
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    weights, active, penalty = {key: np.zeros(d) for key in mean}, {*mean}, np.diag([0.0] + [l2] * (d - 1))
    for _ in range(rounds):
        z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        scored = met(design, {key: (weights[key].tolist(),) for key in active}, "w array<double>").withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        gradient = [F.sum(F.col("n") * (F.col("p") - F.col("y")) * F.get("x", i)).alias(f"g{i}") for i in range(d)]
        hessian = [F.sum(F.col("n") * F.col("p") * (1 - F.col("p")) * F.get("x", i) * F.get("x", j)).alias(f"h{i}_{j}") for i, j in pairs]
        for r in scored.groupBy(*groups).agg(*gradient, *hessian).collect():
            key, h = key_of(r), np.zeros((d, d))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            step = np.linalg.solve(h + penalty + 1e-9 * np.eye(d), np.array([r[f"g{i}"] for i in range(d)]) + penalty @ weights[key])
            weights[key] = weights[key] - step
            if np.abs(step).max() < 1e-8:
                active.discard(key)
        if not active:
            break
    design.unpersist()
    data.unpersist()
    return {key: Logistic(list(features), [float(v) for v in w[1:]], float(w[0]), mean[key], std[key]) for key, w in weights.items()}


def score_by(routers: Mapping[tuple, Logistic], groups: Sequence[str]) -> Column:
    """The score of each row by its group's router, null for a group without one."""
    out = F.lit(None).cast("double")
    for key, router in routers.items():
        same = F.lit(True)
        for g, value in zip(groups, key, strict=True):
            same = same & F.col(g).eqNullSafe(F.lit(value))
        out = F.when(same, router.score()).otherwise(out)
    return out


def trained(records: DataFrame, policy: str, benchmarks: Sequence[str] | None = None, split: float | None = None, features: Sequence[str] | None = None, signals: str = "signals", l2: float = 1.0) -> Logistic:
    """The router of a policy, with what is known of its training in ``meta``: policy, benchmarks, split, rows, base rate, and the AUC on either side of the split.

    Features are named, or those of the candidates that any training row has. ``split``: the share of tasks that are trained on.
    """
    rows = training_rows(records, policy, benchmarks, signals)
    side = F.when(in_train_split(F.col("task_id"), split), "train").otherwise("test") if split else F.lit("train")
    own = rows.where(side == "train")
    names = list(features) if features is not None else present_features(own, signals=signals)
    plain = feature_columns(rows.withColumn("side", side), names, signals=signals, keep=("benchmark", "side")).persist()
    router = fitted(plain.where("side = 'train'"), names, l2=l2)
    about = plain.where("side = 'train'").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.array_sort(F.collect_set("benchmark")).alias("benchmarks")).first()
    sides = {r["side"]: r["auc"] for r in evaluated(plain, router, F.col("side")).withColumnRenamed("split", "side").collect()}
    plain.unpersist()
    router.meta = {"policy": policy, "benchmarks": ",".join(about["benchmarks"]), "split_frac": str(split), "n_train": str(about["n"]), "base_rate": repr(about["rate"])}
    router.meta |= {f"{name}_auc": repr(value) for name, value in sorted(sides.items(), reverse=True)}
    return router


def auc(scored: DataFrame, score: str = "score", label: str = "y", groups: Sequence[str] = (), per_range: int = PER_RANGE) -> DataFrame:
    """``groups, n, auc``: the share of (correct, wrong) pairs that are in order, ties counting half; null for one class.

    Rows collapse to distinct scores first, combined before the shuffle. Ranks need the number of wrong ones below each score: a running count over ranges of scores.
    """
    groups = list(groups)
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = known.groupBy(*groups, score).agg(F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") == 0).alias("neg"))
    ranked = with_before(by_score, groups, score, F.sum, "neg", "_below", cuts(by_score, score, per_range))
    wins = F.sum(F.col("pos") * (2 * F.coalesce("_below", F.lit(0)) + F.col("neg")).cast("decimal(38,0)"))
    pos, neg = F.sum("pos"), F.sum("neg")
    pairs = pos.cast("double") * neg.cast("double") * 2
    aggs = ((pos + neg).alias("n"), (wins.cast("double") / F.nullif(pairs, F.lit(0.0))).alias("auc"))
    return ranked.groupBy(*groups).agg(*aggs) if groups else ranked.agg(*aggs)


def rated(scored: DataFrame, groups: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """``groups, n, base_rate, auc`` of scored rows."""
    rates = scored.groupBy(*groups).agg(share(F.count_if(F.col(label) == 1), F.count("*")).alias("base_rate"))
    return auc(scored, score, label, groups).join(rates, list(groups))


def evaluated(rows: DataFrame, router: Logistic, split: Column, label: str = "y") -> DataFrame:
    """``split, n, base_rate, auc`` of a router on each side of a split."""
    return rated(rows.select(router.score().alias("score"), F.col(label).cast("int").alias("y"), split.alias("split")), ["split"])


def stage_scores(scorers: Sequence[Column], stages: Sequence[str]) -> list[Column]:
    """One score for each boundary; a single one is used for all."""
    if len(scorers) not in (1, len(stages) - 1):
        raise ValueError(f"{len(scorers)} scorers for {len(stages) - 1} boundaries")
    return list(scorers) * (len(stages) - 1) if len(scorers) == 1 else list(scorers)
