"""Incremental refresh: what a changed filter adds to and takes from histograms, sums and coarse bins.

Only rows of the bins that come or go are read: `rows` is a function (ranges, any_of) that gives the encoded rows that meet the ranges of
some dimensions and any of the ranges of others, as Session.rows does, so these conditions reach an index or the file scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binweave.operators.filters import Range, range_diff, satisfied, signed
from binweave.operators.histograms import all_histograms, coarse
from binweave.plans.encode import Dimension

Rows = Callable[[Mapping[str, Range], Mapping[str, Sequence[Range]]], DataFrame]


def segments(dim: Dimension, old: Range | None, new: Range | None) -> tuple[list[Range], list[Range]]:
    """Ranges of whole bins that come and that go when a filter changes."""
    whole = lambda r: None if r is None else (math.ceil(max(r[0], 0)), math.floor(min(r[1], dim.bins - 1)))
    return range_diff(whole(old), whole(new), dim.bins)


def moved(rows: Rows, dim: Dimension, filters: Mapping[str, Range], new: Range | None) -> tuple[DataFrame, Column]:
    """The rows that come or go and meet the other filters, and 1 or -1 for each."""
    old = filters.get(dim.name)
    others = {n: r for n, r in filters.items() if n != dim.name}
    added, removed = segments(dim, old, new)
    return rows(others, {dim.name: added + removed}), signed(dim, old, new)


def changes(rows: Rows, dims: Sequence[Dimension], filters: Mapping[str, Range], name: str, new: Range | None) -> DataFrame:
    """(dim, bin, count): signed changes of all histograms when the filter of dimension name becomes new. Where rows only come or only go,
    they are counted and the sign is given to the counts."""
    dim = {d.name: d for d in dims}[name]
    changed, sign = moved(rows, dim, filters, new)
    added, removed = segments(dim, filters.get(name), new)
    if not removed:
        return all_histograms(changed, dims)
    if not added:
        return all_histograms(changed, dims).withColumn("count", -F.col("count"))
    return all_histograms(changed, dims, sign).where("count <> 0")


def sum_changes(rows: Rows, of: Dimension, value: Column, by: Dimension, filters: Mapping[str, Range], new: Range | None) -> DataFrame:
    """(bin, count, sum): signed changes of the counts and sums by bin of a dimension when the filter of dimension by becomes new."""
    changed, sign = moved(rows, by, filters, new)
    return changed.groupBy(F.col(of.column).alias("bin")).agg(F.sum(sign).alias("count"), F.sum(sign * value.cast("double")).alias("sum"))


def coarse_changes(rows: Rows, of: Dimension, target: int, by: Dimension, filters: Mapping[str, Range], new: Range | None) -> DataFrame:
    """(bin, count): signed changes of a coarse histogram."""
    changed, sign = moved(rows, by, filters, new)
    hist = changed.groupBy(F.col(of.column).alias("bin")).agg(F.sum(sign).cast("long").alias("count"))
    return coarse(hist, of, target)


def apply_changes(before: DataFrame, change: DataFrame) -> DataFrame:
    """Histograms after changes: (dim, bin, count) or (bin, count), and sum and avg where both have sums; bins that lose all rows go."""
    keys = [c for c in ("dim", "bin") if c in before.columns]
    added = [c for c in ("count", "sum") if c in before.columns and c in change.columns]
    both = before.select(*keys, *added).unionByName(change.select(*keys, *added))
    out = both.groupBy(*keys).agg(*[F.sum(c).cast("long" if c == "count" else "double").alias(c) for c in added]).where("count <> 0")
    return out.withColumn("avg", F.col("sum") / F.col("count")) if "sum" in added else out


def transitions(encoded: DataFrame, dims: Mapping[str, Dimension], filters: Mapping[str, Range], name: str, new: Range | None) -> DataFrame:
    """(before, after, rows): how many rows met so many filters before and meet so many after the filter of a dimension becomes new. Rows that
    become active are those whose count reaches that of the filters."""
    later = {**{n: r for n, r in filters.items() if n != name}, **({} if new is None else {name: new})}
    return encoded.groupBy(satisfied(dims, filters).alias("before"), satisfied(dims, later).alias("after")).agg(F.count(F.lit(1)).alias("rows"))
