"""Running totals, numbers and order statistics of whole columns, without a task that sees them all.

Rows are dealt over ranges of the value they are ordered by: bounds are sampled percentiles, as many as the
number of rows asks for. A range's total is one row; the totals of the ranges before are added to
what a window counts within the range. A group's rows (a route's, say) get ranges of their own; bounds are
broadcast as one row a group, so groups are to be few: for many small ones a plain window does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most (a power of 2), rows of a range that are wished for, and ids sampled for a bound.
MOST, RANGE_ROWS, SAMPLED = 4096, 250_000, 40


def bounds_of(value: str, rows_a_range: int | None = None) -> Column:
    """Aggregate: ascending bounds of a group's ranges, none where all rows fit one range."""
    every = F.percentile_approx(value, [k / MOST for k in range(1, MOST)], 20_000)
    ranges = F.least(F.lit(MOST), F.ceil(F.count(value) / F.lit(rows_a_range or RANGE_ROWS))).cast("int")
    return F.when(ranges > 1, F.transform(F.sequence(F.lit(1), ranges - 1), lambda k: F.element_at(every, F.floor(k * MOST / ranges).cast("int"))))


def range_of(bounds: Column, value: Column) -> Column:
    """How many of the ascending ``bounds`` are below ``value``, by halving steps; 0 for a null."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(MOST.bit_length() - 1))))
    below = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) < value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(below(at, step), step).otherwise(F.lit(0)))


def ranged(rows: DataFrame, keys: list[str], value: str, *more: Column, rows_a_range: int | None = None) -> DataFrame:
    """``rows`` with ``__range``, ascending with ``value`` in each group, and the group's aggregates ``more``."""
    totals = rows.groupBy(*keys).agg(bounds_of(value, rows_a_range).alias("__bounds"), *more)
    met = rows.join(F.broadcast(totals), keys) if keys else rows.crossJoin(F.broadcast(totals))  # one row a group
    return met.withColumn("__range", range_of(F.col("__bounds"), F.col(value))).drop("__bounds")


def with_totals_before(rows: DataFrame, keys: list[str], order: list[Column], add: dict[str, Column], descending: bool = False) -> DataFrame:
    """``rows`` of :func:`ranged` with, for each name of ``add``, the sum of its column over the rows before.

    ``order`` orders the rows of a range, and goes the way of ``descending``.
    """
    ways = F.desc if descending else F.asc
    ahead = Window.partitionBy(*keys).orderBy(ways("__range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in add.items()))
    base = sums.select(*keys, "__range", *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in add))
    here = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, [*keys, "__range"])
    return out.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in add.items()}).drop("__range", *(f"__{n}" for n in add))


def running_total(rows: DataFrame, keys: list[str], order: str, add: str, name: str, rows_a_range: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``add`` over the group's rows of a lower ``order``, whose values differ."""
    return with_totals_before(ranged(rows, keys, order, rows_a_range=rows_a_range), keys, [F.asc(order)], {name: F.col(add)})


def quantile(rows: DataFrame, keys: list[str], value: str, p: float, name: str, rows_a_range: int | None = None, times: str | None = None) -> DataFrame:
    """By keys: the exact, linearly interpolated quantile of ``value`` (nulls passed over), which comes ``times`` in a row.

    Values are counted, and the two that the quantile lies between are found by their ranks; no task
    holds a group's values.
    """
    points = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("__n"))
    at = with_totals_before(ranged(points, keys, value, F.sum("__n").alias("__total"), rows_a_range=rows_a_range), keys, [F.asc(value)], {"__before": F.col("__n")})
    rank = F.lit(p) * (F.col("__total") - 1)
    holds = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__n"))
    low, high = F.max(F.when(holds(F.floor(rank)), F.col(value))), F.max(F.when(holds(F.ceil(rank)), F.col(value)))
    share = F.max(rank - F.floor(rank))
    return at.filter(holds(F.floor(rank)) | holds(F.ceil(rank))).groupBy(*keys).agg((low + (high - low) * share).alias(name))


def numbered_in_order(ids: DataFrame, column: str = "query_id", rows_a_range: int | None = None) -> DataFrame:
    """(column, at): distinct values that can be ordered, text too, numbered from 0 in their order."""
    each, rows = ids.select(column).distinct(), rows_a_range or RANGE_ROWS
    size = each.count()
    bounds = []
    if size > rows:
        ranges = min(MOST, -(-size // rows))
        some = sorted(r[0] for r in each.sample(min(1.0, SAMPLED * ranges / size), seed=1).filter(F.col(column).isNotNull()).collect())
        bounds = sorted({some[k * len(some) // ranges] for k in range(1, ranges)}) if some else []
    found = each.withColumn("__range", range_of(F.array(*map(F.lit, bounds)), F.col(column)) if bounds else F.lit(0))
    return with_totals_before(found, [], [F.asc(column)], {"at": F.lit(1)}).select(column, F.col("at").cast("long").alias("at"))
