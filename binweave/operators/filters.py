"""Filters: one inclusive range of bins for each dimension, all of which a row must meet, and what a changed range adds and removes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binweave.plans.encode import Dimension

Range = tuple[float, float]


def check_range(bounds: object) -> Range:
    """A range of two numbers; sets and functions are refused."""
    if isinstance(bounds, (set, frozenset)):
        raise NotImplementedError("set filters are not supported; use a range")
    if callable(bounds):
        raise NotImplementedError("function filters are not supported; use a range")
    if not isinstance(bounds, (tuple, list)) or len(bounds) != 2:
        raise ValueError("a filter is a range of two bins")
    low, high = bounds
    return low, high


def within(dim: Dimension, bounds: Range) -> Column:
    """Whether a row's bin is in a range; lower bounds above upper ones match nothing."""
    return F.col(dim.column).between(F.lit(bounds[0]), F.lit(bounds[1]))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def active(dims: Mapping[str, Dimension], filters: Mapping[str, Range], without: str | None = None) -> Column:
    """Whether a row meets all filters (but that of one dimension)."""
    return all_of(within(dims[name], r) for name, r in filters.items() if name != without)


def satisfied(dims: Mapping[str, Dimension], filters: Mapping[str, Range]) -> Column:
    """How many filters a row meets."""
    return sum((within(dims[n], r).cast("int") for n, r in filters.items()), F.lit(0))


def range_diff(old: Range | None, new: Range | None, bins: int) -> tuple[list[Range], list[Range]]:
    """(added, removed): whole-bin ranges that a new range has and the old one lacks, and the other way round; None is no filter."""
    a, b = (0, bins - 1) if old is None else old, (0, bins - 1) if new is None else new

    def less(x: Range, y: Range) -> list[Range]:
        if x[0] > x[1]:
            return []
        if y[0] > y[1] or y[1] < x[0] or y[0] > x[1]:
            return [x]
        return [r for r in ((x[0], y[0] - 1), (y[1] + 1, x[1])) if r[0] <= r[1]]

    return less(b, a), less(a, b)


def in_any(dim: Dimension, ranges: Iterable[Range]) -> Column:
    """Whether a row's bin is in one of some ranges."""
    return any_of(within(dim, r) for r in ranges)


def signed(dim: Dimension, old: Range | None, new: Range | None) -> Column:
    """1 for rows that a changed filter lets in, -1 for those it shuts out, 0 for others. Exact for fractional bounds as well."""
    before = F.lit(True) if old is None else within(dim, old)
    after = F.lit(True) if new is None else within(dim, new)
    return after.cast("int") - before.cast("int")


def sweep(encoded: DataFrame, dim: Dimension, windows: DataFrame) -> DataFrame:
    """windows (window, low, high) with count, the rows in each: from the histogram, which is joined by range on at most 65,536 bins."""
    hist = encoded.groupBy(F.col(dim.column).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    joined = windows.join(F.broadcast(hist), F.col("bin").between(F.col("low"), F.col("high")), "left")
    return joined.groupBy("window", "low", "high").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
