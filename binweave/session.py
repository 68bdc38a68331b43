"""Linked histograms: a table, a filter for each dimension, and every dimension's histogram over the rows that meet all filters.

Filters are ranges of bins, and a dimension's own filter applies to its own histogram too. State is on the driver; results are DataFrames."""

from __future__ import annotations

import logging
import math
import os
import time
import warnings
import weakref
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.functions.quantize import bin_of
from binweave.operators import deltas, filters, histograms, index
from binweave.plans.encode import Dimension, Options, encode, fit, within_values
from binweave.plans.planner import Planner, Work
from binweave.sources.tables import Table, from_frame

log = logging.getLogger("binweave")
#: Open sessions from which a warning is given; BINWEAVE_MAX_SESSIONS replaces it.
MANY_SESSIONS = 5
_sessions: weakref.WeakSet = weakref.WeakSet()


def _unpersist(frames: list[DataFrame]) -> None:
    while frames:
        frames.pop().unpersist()


class Session:
    """A table encoded for linked filtering.

    cache keeps the encoded table in memory and on disk, for many refreshes of one table; without it each refresh reads the source with
    filters and needed columns pushed down. fitted: dimensions of another session (or of load_fit()), so that the table isn't scanned to fit them; columns
    that the table lacks are bin 0. Use it as a context manager or call dispose()."""

    def __init__(self, table: Table | DataFrame, bins: float | None = None, dimensions: Mapping[str, Mapping] | None = None, values: Sequence[str] = (), keep: Sequence[str] = (), order_by: str | None = None, dims: Sequence[str] | None = None, null_as: str = "missing", cache: bool = False, guard: bool = True, fitted: Sequence[Dimension] | None = None):
        self.table = table if isinstance(table, Table) else from_frame(table, dims, order_by)
        self.options = Options(bins, dict(dimensions or {}), null_as)
        self.values, self.keep = list(values), list(keep)
        self.dims: dict[str, Dimension] = {d.name: d for d in (fit(self.table, self.options) if fitted is None else fitted)}
        self.filters: dict[str, filters.Range] = {}
        self.reductions: dict[str, tuple[str, str]] = {}
        self.planner, self.last_profile = Planner(guard), None
        self._indexes: dict[str, tuple[DataFrame, dict]] = {}
        self._base: dict[str, np.ndarray] | None = None
        self._kept: tuple[dict[str, filters.Range], dict[str, np.ndarray]] | None = None
        self._encoded = encode(self.table, list(self.dims.values()), self.values, self.keep, null_as)
        self.cached, self.disposed, self.sequence = cache, False, 0
        self._cube: DataFrame | None = None
        self._frames: list[DataFrame] = []  # cubes and indexes, given back when the session goes
        self._end_frames = weakref.finalize(self, _unpersist, self._frames)
        if cache:
            self._encoded = self._encoded.persist(StorageLevel.MEMORY_AND_DISK)
        self._end = weakref.finalize(self, self._encoded.unpersist) if cache else None
        _sessions.add(self)
        most = int(os.environ.get("BINWEAVE_MAX_SESSIONS", MANY_SESSIONS))
        if sum(not s.disposed for s in _sessions) >= most:
            warnings.warn(f"{most} sessions or more are open; dispose of those no longer used", stacklevel=2)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.dispose()

    def dispose(self) -> None:
        """Give back the cache; once is enough, more is no error."""
        if not self.disposed:
            self.disposed = True
            self._drop_derived()
            if self._end is not None:
                self._end()

    def _drop_cube(self) -> None:
        if self._cube is not None:
            self._cube.unpersist()
            self._frames.remove(self._cube)
            self._cube = None

    def _drop_derived(self) -> None:
        """Forget all that was made from the encoded table."""
        self._drop_cube()
        _unpersist(self._frames)
        self._indexes, self._base, self._kept = {}, None, None

    def when_idle(self) -> None:
        """Nothing is ever pending: results are computed when they are read."""

    def dimension(self, name: str) -> DimensionHandle:
        if callable(name):
            raise TypeError("Function-based dimensions are not supported. Pre-compute the value as a column and name that.")
        if name not in self.dims:
            raise KeyError(f"no dimension {name!r}; there are {', '.join(self.dims)}")
        return DimensionHandle(self, self.dims[name])

    def group(self, of: str | DimensionHandle, coarse_bins: int | None = None) -> Group:
        if isinstance(of, DimensionHandle):
            of = of.dim.name
        if not isinstance(of, str):
            raise TypeError("a group is of a dimension or its name")
        return Group(self, self.dimension(of).dim, coarse_bins)

    def add_dimension(self, name: str, **options: object) -> DataFrame:
        """Fit one more column as a dimension: (bin, count, active) of it, unfiltered and under the present filters."""
        if name in self.dims:
            raise ValueError(f"{name!r} is a dimension already")
        own = from_frame(self.table.df, [name], self.table.order_by)
        table = Table(self.table.df, self.table.types | own.types, self.table.order_by, self.table.labels)
        opts = Options(self.options.bins, {**self.options.dimensions, name: options}, self.options.null_as)
        new = fit(Table(own.df, own.types, own.order_by), opts)[0]
        self.table, self.options = table, opts
        self.dims[name] = Dimension(**{**new.__dict__, "position": len(self.dims)})
        self._drop_derived()
        encoded = encode(table, list(self.dims.values()), self.values, self.keep, self.options.null_as)
        if self.cached:
            self._end()
            encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)
            self._end = weakref.finalize(self, encoded.unpersist)
        self._encoded = encoded
        return histograms.filtered_and_not(encoded, self.dims[name], filters.active(self.dims, self.filters))

    @property
    def encoded(self) -> DataFrame:
        return self._encoded

    def rows(self, ranges: Mapping[str, filters.Range] | None = None, any_of: Mapping[str, Sequence[filters.Range]] | None = None) -> DataFrame:
        """Encoded rows that meet the filters (or the given ranges), and any of the ranges of each dimension of any_of. An index of one of these
        dimensions is read where there is one. Uncached, filters of plain numbers are comparisons of the source's values, made by its
        scan, and only the rows left are encoded."""
        ranges, any_of = dict(self.filters if ranges is None else ranges), dict(any_of or {})
        wanted = {**{n: [r] for n, r in ranges.items()}, **{n: [*r] for n, r in any_of.items()}}  # a dimension is in one of both
        both = lambda w: filters.all_of(filters.in_any(self.dims[n], r) for n, r in w.items())
        indexed = [n for n in wanted if n in self._indexes]
        if indexed:
            width = lambda n: sum(max(0, b - a + 1) for a, b in wanted[n]) / self.dims[n].bins
            return self._indexes[min(indexed, key=width)][0].where(both(wanted))
        if self.cached or self.options.null_as == "zero":
            return self._encoded.where(both(wanted))
        at_source = {}
        for n, each in wanted.items():
            parts = [within_values(self.table.df, self.dims[n], *r) for r in each]
            if all(p is not None for p in parts):
                at_source[n] = filters.any_of(parts)
        if not at_source:
            return self._encoded.where(both(wanted))
        left = Table(self.table.df.where(filters.all_of(at_source.values())), self.table.types, self.table.order_by, self.table.labels)
        encoded = encode(left, list(self.dims.values()), self.values, self.keep, self.options.null_as)
        return encoded.where(both({n: r for n, r in wanted.items() if n not in at_source}))

    def refresh(self, strategy: str = "auto") -> DataFrame:
        """(dim, bin, count) of all dimensions over the active rows.

        strategy: scan (all dimensions by one pass and one shuffle), separate (a pass for each), cube (from the joint counts, built if need be),
        delta (the counts of the last such refresh, kept by the driver, at most as many as there are bins, and the rows that came or went since),
        or auto (cube where one is built, else scan). All give the same rows."""
        dims = list(self.dims.values())
        if strategy == "auto":
            strategy = "scan" if self._cube is None else "cube"
        if strategy == "scan" or not dims:
            return histograms.all_histograms(self.rows(), dims)
        if strategy == "delta":
            return self._refresh_kept()
        if strategy == "separate":
            rows = self.rows()
            each = [histograms.histogram(rows, d).select(F.lit(d.name).alias("dim"), "bin", "count") for d in dims]
            return reduce(DataFrame.unionByName, each)
        if strategy != "cube":
            raise ValueError(f"no strategy {strategy!r}")
        if self._cube is None:
            self.build_cube()
        return histograms.all_histograms(self._cube.where(filters.active(self.dims, self.filters)), dims, F.col("n"))

    def _refresh_kept(self) -> DataFrame:
        dims = list(self.dims.values())
        before, counts = self._kept or ({}, None)
        changed = [n for n in {**before, **self.filters} if before.get(n) != self.filters.get(n)]
        if counts is None or len(changed) > 1:
            counts = histograms.to_arrays(histograms.all_histograms(self.rows(), dims), dims)
        elif changed:
            new = self.filters.get(changed[0])
            change = histograms.to_arrays(deltas.changes(self.rows, dims, before, changed[0], new), dims)
            counts = {n: c + change[n] for n, c in counts.items()}
        self._kept = (dict(self.filters), counts)
        return histograms.from_arrays(self._encoded.sparkSession, counts)

    def build_cube(self) -> int:
        """Keep the joint counts of all dimensions, and return how many combinations there are. Worth it where they are far fewer than rows."""
        self._drop_cube()
        self._cube = histograms.cube(self._encoded, list(self.dims.values())).persist(StorageLevel.MEMORY_AND_DISK)
        self._frames.append(self._cube)
        return self._cube.count()

    def refresh_with(self, before: DataFrame, name: str, new: filters.Range | None) -> DataFrame:
        """What refresh() gives after the filter of a dimension becomes new, from the histograms before it and the rows that come or go."""
        change = deltas.changes(self.rows, list(self.dims.values()), self.filters, name, new)
        return deltas.apply_changes(before, change)

    def count(self) -> int:
        """Active rows."""
        return self.rows().count()

    def _unfiltered(self) -> dict[str, np.ndarray]:
        """Counts by bin of all dimensions without filters: one job in a session's life, and at most as many numbers as there are bins."""
        if self._base is None:
            dims = list(self.dims.values())
            self._base = histograms.to_arrays(histograms.all_histograms(self.rows({}), dims), dims)
        return self._base

    def _inside(self, name: str, bounds: filters.Range | None) -> int:
        """Rows whose bin is in a range."""
        counts = self._unfiltered()[name]
        if bounds is None:
            return int(counts.sum())
        low, high = math.ceil(max(bounds[0], 0)), math.floor(min(bounds[1], len(counts) - 1))
        return int(counts[low : high + 1].sum()) if low <= high else 0

    def clear_work(self, name: str) -> Work:
        """What clearing a filter takes, by the unfiltered histograms, as if dimensions were independent."""
        total = self._inside(name, None)
        others = math.prod(self._inside(n, r) / max(total, 1) for n, r in self.filters.items() if n != name)
        outside = total - self._inside(name, self.filters.get(name))
        return Work(outside * others, total * others, len(self.dims))

    def clear_strategy(self, name: str) -> str:
        """How the planner would refresh if the filter of a dimension were cleared: 'delta' or 'recompute'."""
        return self.planner.choose(self.clear_work(name))

    def clear_with_profile(self, name: str, before: DataFrame | None = None) -> DataFrame:
        """Clear a filter by the planner's choice; the planner and profile() learn from it. before: the histograms under it; else those that the last
        refresh("delta") kept serve."""
        work, old = self.clear_work(name), self.filters.get(name)
        how = self.planner.choose(work) if before is not None or self._kept else "recompute"
        total, inside = self._inside(name, None), self._inside(name, old)
        started = time.perf_counter()
        if how == "delta" and before is not None:
            out = self.refresh_with(before, name, None)
            self.dimension(name).clear()
        else:
            self.dimension(name).clear()
            if how == "recompute":
                self._kept = None
            out = self.refresh("delta")
        rows = out.toArrow()
        seconds = time.perf_counter() - started
        self.planner.record(how, seconds, work)
        low, high = (0, self.dims[name].bins - 1) if old is None else (math.ceil(max(old[0], 0)), math.floor(min(old[1], self.dims[name].bins - 1)))
        self.last_profile = {
            "dimension": name, "strategy": how, "fallback": how == "recompute", "range": old, "range_bins": max(0, high - low + 1), "ms": seconds * 1000, "rows": total,
            "inside_rows": inside, "outside_rows": total - inside, "outside_fraction": (total - inside) / max(total, 1),
        }
        log.debug("cleared %s by %s in %.1f ms", name, how, seconds * 1000)
        return self._encoded.sparkSession.createDataFrame(rows, out.schema)

    def profile(self) -> dict | None:
        return self.last_profile

    def planner_snapshot(self) -> dict:
        return self.planner.snapshot()

    def build_index(self, name: str) -> dict:
        """Keep a copy of the encoded table clustered by a dimension's bins, which filters of it then read; again is no work. Each index is a copy in
        memory or on disk until dispose() or add_dimension()."""
        dim = self.dimension(name).dim
        if name not in self._indexes:
            started = time.perf_counter()
            frame = index.clustered(self._encoded, dim).persist(StorageLevel.MEMORY_AND_DISK)
            self._frames.append(frame)
            rows = frame.count()
            self._indexes[name] = (frame, {"ready": True, "ms": (time.perf_counter() - started) * 1000, "bytes": index.size_bytes(rows, dim)})
        return self._indexes[name][1]

    def index_status(self, name: str) -> dict:
        self.dimension(name)
        return self._indexes[name][1] if name in self._indexes else {"ready": False}


class DimensionHandle:
    """A dimension's filter."""

    def __init__(self, session: Session, dim: Dimension):
        self.session, self.dim = session, dim

    def filter(self, bounds: filters.Range) -> DimensionHandle:
        """Keep rows whose bin is in [low, high]; replaces this dimension's filter."""
        self.session.filters[self.dim.name] = filters.check_range(bounds)
        self.session.sequence += 1
        return self

    def filter_values(self, low: float, high: float) -> DimensionHandle:
        """filter() with the bins of two values; rows in those bins stay, so it is as fine as the bins are."""
        if self.dim.scale is None:
            raise TypeError("only number dimensions have values")
        return self.filter((bin_of(low, self.dim.scale), bin_of(high, self.dim.scale)))

    def clear(self) -> DimensionHandle:
        self.session.filters.pop(self.dim.name, None)
        self.session.sequence += 1
        return self

    def group(self, coarse_bins: int | None = None) -> Group:
        return Group(self.session, self.dim, coarse_bins)


class Group:
    """A dimension's histogram over the active rows."""

    def __init__(self, session: Session, dim: Dimension, coarse_bins: int | None = None):
        self.session, self.dim = session, dim
        self.coarse_bins = coarse_bins or dim.coarse_bins

    def _hist(self, exclude_own: bool = False) -> DataFrame:
        s = self.session
        ranges = {k: r for k, r in s.filters.items() if not exclude_own or k != self.dim.name}
        return histograms.histogram(s.rows(ranges), self.dim)

    def bins(self, exclude_own: bool = False) -> DataFrame:
        """(bin, count) of all bins. exclude_own leaves this dimension's filter out."""
        return histograms.dense(self._hist(exclude_own), self.dim)

    def keys(self) -> range:
        return range(self.dim.bins)

    def count(self) -> int:
        return self.session.count()

    def coarse(self) -> DataFrame | None:
        """(bin, count) at the coarse resolution; None where none was asked for."""
        return histograms.coarse(self._hist(), self.dim, self.coarse_bins) if self.coarse_bins else None

    def reduce_sum(self, column: str) -> Group:
        """Add up a value column in each bin, in place of this dimension's reduction."""
        return self._reduce("sum", column)

    def reduce_min(self, column: str) -> Group:
        return self._reduce("min", column)

    def reduce_max(self, column: str) -> Group:
        return self._reduce("max", column)

    def _reduce(self, kind: str, column: str) -> Group:
        if callable(column):
            raise TypeError("function accessors are not supported; name a value column")
        if column not in self.session.values:
            raise ValueError(f"{column!r} is no value column; there are {self.session.values}")
        self.session.reductions[self.dim.name] = (kind, column)
        return self

    def _change_of(self, by: str) -> tuple[Dimension, Mapping[str, filters.Range]]:
        return self.session.dimension(by).dim, self.session.filters

    def coarse_with(self, before: DataFrame, by: str, new: filters.Range | None) -> DataFrame:
        """What coarse() gives after the filter of a dimension becomes new, from what it gave before and the rows that come or go."""
        dim, present = self._change_of(by)
        return deltas.apply_changes(before, deltas.coarse_changes(self.session.rows, self.dim, self.coarse_bins or self.dim.bins, dim, present, new))

    def all_with(self, before: DataFrame, by: str, new: filters.Range | None) -> DataFrame:
        """What all() gives after the filter of a dimension becomes new, from what it gave before and the rows that come or go; for counts and
        sums, as least and largest values cannot be taken back. Sums are of doubles, so their last digits may differ."""
        s = self.session
        kind, column = s.reductions.get(self.dim.name, ("sum", None))
        if kind != "sum":
            raise ValueError(f"a {kind} cannot be taken back; use all()")
        dim, present = self._change_of(by)
        value = F.col(f"v{s.values.index(column)}") if column is not None else F.lit(0.0)
        return deltas.apply_changes(before, deltas.sum_changes(s.rows, self.dim, value, dim, present, new)).orderBy("bin")

    def all(self) -> DataFrame:
        """(bin, count, and the reduction) of the bins that have rows, by bin."""
        s = self.session
        kind, column = s.reductions.get(self.dim.name, ("sum", None))
        value = F.col(f"v{s.values.index(column)}") if column is not None else None
        return histograms.reduced(s.rows(), self.dim, value, kind).orderBy("bin")

    def top(self, k: int, by: str = "count") -> DataFrame:
        """The k bins with the most rows, with their values or labels."""
        return self._ranked(k, True, by)

    def bottom(self, k: int, by: str = "count") -> DataFrame:
        return self._ranked(k, False, by)

    def _ranked(self, k: int, largest: bool, by: str) -> DataFrame:
        hist = self._hist() if by == "count" else self.all()
        best = histograms.ranked(hist.limit(0) if self.session.disposed else hist, k, largest, by)
        order = F.desc(by) if largest else F.asc(by)
        return histograms.keyed(best, self.dim).orderBy(order, "bin")
