"""Statistics as Catalyst expressions: medians, deviations, folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often `then` names it: the
    planner merges projections and would repeat a plain expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sorted_quantile(a: Column, q: float) -> Column:
    """The q-quantile of a sorted array, linear between neighbours; null if empty."""

    def between(at: Column) -> Column:
        low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return F.when(F.size(a) > 0, between((F.size(a) - 1) * F.lit(float(q))))


def sorted_median(a: Column) -> Column:
    """The median of a sorted array; null if it is empty."""
    n = F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(a, low) + F.get(a, high)) / 2)


def mad(a: Column, median: Column) -> Column:
    """1.4826 times the median distance from `median`; null below two values."""
    return F.when(F.size(a) >= 2, 1.4826 * let(F.array_sort(F.transform(a, lambda x: F.abs(x - median))), sorted_median))


def sorted_mad(a: Column) -> Column:
    """`mad` of a sorted array around its own median."""
    return let(sorted_median(a), lambda m: mad(a, m))


def ewma(values: Column, span: int) -> Column:
    """The last exponentially weighted average of an ordered array of doubles,
    with the weight 2 / (span + 1); it starts at the first value."""
    alpha = 2.0 / (span + 1)
    start = F.get(values, F.lit(0))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, lambda s, x: s + alpha * (x - s))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def squash(z: Column) -> Column:
    """A logistic curve from 0 to 100."""
    return 100.0 / (1.0 + F.exp(-z))


def z_score(x: Column, centre: Column, scale: Column) -> Column:
    """0 where the scale is none."""
    return F.when(scale.isNull() | (scale == 0), F.lit(0.0)).otherwise((x - centre) / scale)


def interpolated(rows: DataFrame, keys: list[str], order: str, value: str, max_gap: int, out: str = "filled") -> DataFrame:
    """rows with linear values in inner gaps of up to max_gap; longer gaps and the
    edges stay null. `order` is a dense day number."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    v, at = F.col(value), F.when(F.col(value).isNotNull(), F.col(order))
    rows = rows.withColumn("_pv", F.last(v, True).over(before)).withColumn("_pi", F.last(at, True).over(before))
    rows = rows.withColumn("_nv", F.first(v, True).over(after)).withColumn("_ni", F.first(at, True).over(after))
    line = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col(order) - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    filled = F.when(F.col("_ni") - F.col("_pi") - 1 <= max_gap, line)
    return rows.withColumn(out, F.coalesce(v, filled)).drop("_pv", "_pi", "_nv", "_ni")
