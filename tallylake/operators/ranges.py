"""Running aggregates over the order of a column, without a window over all rows of a group.

The order is cut into ranges whose number follows the number of rows. What comes before a row is then what comes before it in its range, by a
window of bounded size, and the totals of the ranges before, by a window over the few ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about; quantiles that ranges are made of, so that there are at most so many.
PER_RANGE, QUANTILES = 1_000_000, 1024


def cuts(rows: DataFrame, x: str, per_range: int = PER_RANGE) -> list[float]:
    """Ascending values of ``x`` that cut the rows into ranges of about ``per_range``: one aggregate, at most ``QUANTILES`` values."""
    n, marks = rows.agg(F.count(x), F.percentile_approx(x, [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES)).first()
    ranges = min(QUANTILES, -(-n // per_range))
    return sorted({marks[i * QUANTILES // ranges - 1] for i in range(1, ranges)}) if ranges > 1 else []


def range_of(x: Column, at: Sequence[float], inclusive: bool = False) -> Column:
    """The number of cuts below a value (``inclusive``: or equal to it), by halving."""
    if not len(at):
        return F.lit(0)
    table = F.lit([float(v) for v in at])

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        right = F.struct((middle + 1).alias("low"), high.alias("high"))
        left = F.struct(low.alias("low"), middle.alias("high"))
        cut = F.get(table, middle)
        return F.when(low >= high, state).when((cut <= x) if inclusive else (cut < x), right).otherwise(left)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(at)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(at).bit_length())), start, halve)["low"]


def with_before(rows: DataFrame, groups: Sequence[str], x: str, total: Callable[[str], Column], value: str, out: str, at: Sequence[float]) -> DataFrame:
    """``rows`` (distinct in ``groups`` and ``x``) with ``out``: an aggregate of ``value`` (sum or max) over the rows of the group with a smaller ``x``, null for none."""
    dealt = rows.withColumn("_range", range_of(F.col(x).cast("double"), at))
    inside = W.partitionBy(*groups, "_range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("_here", total(value).over(inside))
    if not len(at):
        return local.withColumnRenamed("_here", out).drop("_range")
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy(*groups, "_range").agg(total(value).alias("_all"))
    offsets = ranges.select(*groups, "_range", total("_all").over(earlier).alias("_earlier"))
    both = F.array_compact(F.array("_here", "_earlier"))
    joined = local.join(offsets, [*groups, "_range"])
    # Two totals at most: their sum or their greater one, as the aggregate of an array of them.
    combined = F.array_max(both) if total is F.max else F.when(F.size(both) > 0, F.aggregate(both, F.lit(0).cast("bigint"), lambda a, v: a + v))
    return joined.withColumn(out, combined).drop("_range", "_here", "_earlier")


def with_sums_before(rows: DataFrame, groups: Sequence[str], x: str, values: Sequence[str], at: Sequence[float]) -> DataFrame:
    """``rows`` (distinct in ``groups`` and ``x``) where each of ``values`` is the sum of it over the rows of the group with a smaller ``x``, 0 for none."""
    dealt = rows.withColumn("_range", range_of(F.col(x).cast("double"), at))
    inside = W.partitionBy(*groups, "_range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = dealt.select(*(c for c in dealt.columns if c not in values), *(zero(F.sum(v).over(inside)).alias(v) for v in values))
    if not len(at):
        return local.drop("_range")
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy(*groups, "_range").agg(*(F.sum(v).alias(v) for v in values))
    offsets = ranges.select(*groups, "_range", *(zero(F.sum(v).over(earlier)).alias(f"_{v}") for v in values))
    joined = local.join(offsets, [*groups, "_range"])
    return joined.select(*(c for c in local.columns if c not in values and c != "_range"), *((F.col(v) + F.col(f"_{v}")).alias(v) for v in values))


def with_neighbours(asked: DataFrame, points: DataFrame, groups: Sequence[str], x: str, point_x: str, reached: bool, at: Sequence[float]) -> DataFrame:
    """``asked`` with ``last`` and ``next``: of the points of a row's group, in one order with it, the one before it and the one behind it (structs of their columns, null for none).

    A point at the row's own ``x`` is before it if ``reached``, else behind it. Both orders are cut into ranges; what a range has no point for comes from those before or behind it. No row is joined with points.
    """
    rest = [c for c in points.columns if c not in groups]
    row = F.struct(*(c for c in asked.columns if c not in groups))
    point = F.struct(*rest)
    both = asked.select(*groups, F.col(x).cast("double").alias("_x"), F.lit(int(reached)).alias("_kind"), row.alias("_row"), F.lit(None).cast(points.select(point).schema[0].dataType).alias("_point"))
    own = points.select(*groups, F.col(point_x).cast("double").alias("_x"), F.lit(int(not reached)).alias("_kind"), F.lit(None).cast(asked.select(row).schema[0].dataType).alias("_row"), point.alias("_point"))
    dealt = both.unionByName(own).withColumn("_range", F.coalesce(range_of(F.col("_x"), at), F.lit(0)))
    order = [F.col("_x"), F.col("_kind")]
    back = [F.desc("_x"), F.desc("_kind")]
    met = lambda w: F.last("_point", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    inside = W.partitionBy(*groups, "_range")
    local = dealt.withColumn("last", met(inside.orderBy(*order))).withColumn("next", met(inside.orderBy(*back)))
    if len(at):
        ends = dealt.where(F.col("_point").isNotNull()).groupBy(*groups, "_range").agg(F.max_by("_point", "_x").alias("_high"), F.min_by("_point", "_x").alias("_low"))
        ranges = dealt.select(*groups, "_range").distinct().join(ends, [*groups, "_range"], "left")
        far = lambda c, *o: F.last(c, ignorenulls=True).over(W.partitionBy(*groups).orderBy(*o).rowsBetween(W.unboundedPreceding, -1))
        offsets = ranges.select(*groups, "_range", far("_high", "_range").alias("_before"), far("_low", F.desc("_range")).alias("_behind"))
        local = local.where(F.col("_row").isNotNull()).join(offsets, [*groups, "_range"]).withColumns({"last": F.coalesce("last", "_before"), "next": F.coalesce("next", "_behind")})
    return local.where(F.col("_row").isNotNull()).select(*groups, "_row.*", "last", "next")
