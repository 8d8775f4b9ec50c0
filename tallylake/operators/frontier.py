"""Pareto frontiers of cost against quality, and what is read off them. All per benchmark; undefined is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallylake.operators.ranges import PER_RANGE, cuts, with_before, with_neighbours
from tallylake.sources.runlog import checkpointed


def pareto_frontier(points: DataFrame, x: str = "gen_tokens", y: str = "accuracy", point_id: str = "policy", groups: Sequence[str] = ("benchmark",), many: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """Points that no other one of their group beats at the same or a lower x. NaN and null are never kept.

    Of the points at one x only the best (then the one with the smallest id) can be kept, so these come first, combined before the shuffle; each is then compared
    with the best y at any smaller x. ``many``: groups of any number of different x, whose order is cut into ranges.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    rest = [c for c in points.columns if c not in (*groups, x, y)]
    best = F.min_by(F.struct(F.col(y).alias("_y"), *rest), F.struct((-F.col(y)).alias("y"), F.col(point_id).alias("id"))).alias("_p")
    at_x = known.groupBy(*groups, x).agg(best).select(*groups, x, F.col("_p._y").alias(y), *(f"_p.{c}" for c in rest))
    compared = with_before(at_x, groups, x, F.max, y, "_top", cuts(at_x, x, per_range) if many else [])
    return compared.where(F.col("_top").isNull() | (F.col(y) > F.col("_top"))).select(*points.columns)


def neighbours(frontier: DataFrame, asked: DataFrame, value: str, along: str, x: str, y: str, groups: Sequence[str], many: bool, per_range: int) -> DataFrame:
    """``asked`` with the frontier's points ``last`` and ``next`` to each ``value``, along one of its columns. ``many``: groups of any number of rows, whose order is cut into ranges."""
    points = frontier.select(*groups, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    at = cuts(asked.select(F.col(value).cast("double").alias("v")).unionByName(points.select(F.col(along).alias("v"))), "v", per_range) if many else []
    return with_neighbours(asked, points, groups, value, along, along == "x", at)


def accuracy_at_budget(frontier: DataFrame, budgets: DataFrame, x: str = "gen_tokens", y: str = "accuracy", groups: Sequence[str] = ("benchmark",), many: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """``budgets`` (groups and ``budget``) with ``value``: linear between neighbours, the last y beyond the frontier, null before it.

    Budgets and points are merged in one order, in which each budget meets the points beside it; the work grows with their number, not with their product.
    """
    found = neighbours(frontier, budgets, "budget", "x", x, y, groups, many, per_range)
    low, high = F.col("last"), F.col("next")
    part = (F.col("budget") - low["x"]) / (high["x"] - low["x"])
    value = F.when(F.col("budget").isNull(), F.lit(None)).when(high.isNull(), low["y"]).otherwise(low["y"] + part * (high["y"] - low["y"]))
    return found.select(*budgets.columns, value.alias("value"))


def compute_to_target(frontier: DataFrame, targets: DataFrame, x: str = "gen_tokens", y: str = "accuracy", groups: Sequence[str] = ("benchmark",), many: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """``targets`` (groups and ``target``) with ``tokens``: the least x that reaches y, interpolated; null beyond the frontier. Targets and points are merged in the order of y, in which a frontier's x grows too."""
    found = neighbours(frontier, targets, "target", "y", x, y, groups, many, per_range)
    low, high = F.col("last"), F.col("next")
    part = (F.col("target") - low["y"]) / (high["y"] - low["y"])
    tokens = F.when(F.col("target").isNull(), F.lit(None)).when(low.isNull(), high["x"]).otherwise(low["x"] + part * (high["x"] - low["x"]))
    return found.select(*targets.columns, tokens.alias("tokens"))


def marginal_efficiency(rows: DataFrame, reference: str, x: str = "gen_tokens", y: str = "accuracy") -> DataFrame:
    """Accuracy gained per token over the reference policy of the benchmark; null where no more tokens are spent."""
    base = rows.where(F.col("policy") == reference).select("benchmark", F.col(x).alias("_x"), F.col(y).alias("_y"))
    more = F.col(x) - F.col("_x")
    gain = F.when(more > 0, (F.col(y) - F.col("_y")) / more)
    return rows.join(base, "benchmark", "left").withColumn("marginal_efficiency", gain).drop("_x", "_y")


def with_frontier_flag(rows: DataFrame, x: str = "gen_tokens", y: str = "accuracy") -> DataFrame:
    """``rows`` with ``on_frontier``. They are few and read twice, so they are computed first."""
    rows = checkpointed(rows)
    on = pareto_frontier(rows, x, y).select("benchmark", "policy", F.lit(True).alias("_on"))
    return rows.join(on, ["benchmark", "policy"], "left").withColumn("on_frontier", F.coalesce("_on", F.lit(False))).drop("_on")
