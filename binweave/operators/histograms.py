"""Histograms and reductions over an encoded table. Counting combines in each task before its shuffle, so a shuffle carries at most the
bins of each task, whatever the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions.quantize import MAX_BITS, bin_value
from binweave.plans.encode import Dimension


def histogram(encoded: DataFrame, dim: Dimension) -> DataFrame:
    """(bin, count) of the bins that have rows."""
    return encoded.groupBy(F.col(dim.column).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def all_histograms(encoded: DataFrame, dims: Sequence[Dimension], weight: Column | None = None) -> DataFrame:
    """(dim, bin, count) of all dimensions by one pass and one shuffle; weight: added up instead of counting."""
    if not dims:
        return encoded.sparkSession.createDataFrame([], "dim string, bin int, count bigint")
    total = F.count(F.lit(1)) if weight is None else F.sum("w").cast("long")
    cells = F.explode(F.array(*[F.col(d.column) + F.lit(k << MAX_BITS) for k, d in enumerate(dims)])).alias("cell")  # one key, not two
    rows = encoded.select(cells) if weight is None else encoded.select(weight.alias("w"), cells)
    names = F.element_at(F.array(*[F.lit(d.name) for d in dims]), F.shiftright("cell", MAX_BITS) + 1)
    return rows.groupBy("cell").agg(total.alias("count")).select(names.alias("dim"), F.col("cell").bitwiseAND(F.lit((1 << MAX_BITS) - 1)).alias("bin"), "count")


def to_arrays(hists: DataFrame, dims: Sequence[Dimension]) -> dict[str, np.ndarray]:
    """The counts of (dim, bin, count) by dimension, brought to the driver: a number for each bin."""
    found = hists.toArrow()
    out = {d.name: np.zeros(d.bins, np.int64) for d in dims}
    bins, count = found["bin"].to_numpy(), found["count"].to_numpy()
    for d in dims:
        own = pc.equal(found["dim"], d.name).to_numpy()
        out[d.name][bins[own]] = count[own]
    return out


def from_arrays(spark: SparkSession, counts: Mapping[str, np.ndarray]) -> DataFrame:
    """(dim, bin, count) of the bins that have rows."""
    names = list(counts)
    full = [np.flatnonzero(counts[n]) for n in names]
    dim = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), [len(at) for at in full])))
    bins, count = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (full, [counts[n][at] for n, at in zip(names, full, strict=True)]))
    return spark.createDataFrame(pa.table([dim, pa.array(bins.astype(np.int32)), pa.array(count)], names=["dim", "bin", "count"]))


def dense(hist: DataFrame, dim: Dimension) -> DataFrame:
    """All bins of a dimension, with count 0 where a histogram has none; both sides have at most 65,536 rows."""
    every = hist.sparkSession.range(dim.bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(hist), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def coarse(hist: DataFrame, dim: Dimension, target: int) -> DataFrame:
    """(bin, count) of min(target, bins) coarse bins, each of ceil(bins / target) bins; bins without rows are left out."""
    most = max(1, min(target, dim.bins))
    factor = math.ceil(dim.bins / most)
    return hist.groupBy(F.floor(F.col("bin") / factor).cast("int").alias("bin")).agg(F.sum("count").alias("count"))


def reduced(encoded: DataFrame, dim: Dimension, value: Column | None, kind: str = "sum") -> DataFrame:
    """(bin, count, sum, avg) or (bin, count, min) or (bin, count, max) of a value column, as floats added up in doubles."""
    how = {"sum": lambda v: [F.sum(v.cast("double")).alias("sum")], "min": lambda v: [F.min(v.cast("double")).alias("min")], "max": lambda v: [F.max(v.cast("double")).alias("max")]}
    extra = how[kind](value) if value is not None else []
    out = encoded.groupBy(F.col(dim.column).alias("bin")).agg(F.count(F.lit(1)).alias("count"), *extra)
    return out.withColumn("avg", F.col("sum") / F.col("count")) if value is not None and kind == "sum" else out


def filtered_and_not(encoded: DataFrame, dim: Dimension, active: Column) -> DataFrame:
    """(bin, count, active): rows in a bin, and those of them that meet the filters, for a dimension that joins later."""
    return encoded.groupBy(F.col(dim.column).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.count_if(active).alias("active"))


def keyed(hist: DataFrame, dim: Dimension) -> DataFrame:
    """A histogram with the value (number) or label (string) of each bin."""
    if dim.type == "number":
        return hist.withColumn("value", bin_value(F.col("bin"), dim.scale))
    words = hist.sparkSession.createDataFrame(list(enumerate(dim.labels[: dim.bins])), "code int, label string")
    return hist.join(F.broadcast(words), F.col("bin") == F.col("code"), "left").drop("code")


def ranked(hist: DataFrame, k: int, largest: bool = True, by: str = "count") -> DataFrame:
    """The k bins with the most (or fewest) rows, of those that have any; ties go to the lower bin."""
    if k < 0:
        raise ValueError("k must not be negative")
    order = F.desc(by) if largest else F.asc(by)
    return hist.where("count > 0").orderBy(order, F.asc("bin")).limit(k)


def running_stats(df: DataFrame, value: Column) -> DataFrame:
    """(n, mean, variance): the population variance, 0 for fewer than two values."""
    v = value.cast("double")
    return df.agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("variance"))


def touched(hist: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """(rows): how many rows the bins of some ranges have; a bin in two ranges counts twice."""
    parts = [F.coalesce(F.sum(F.when(F.col("bin").between(a, b), F.col("count"))), F.lit(0)) for a, b in ranges]
    return hist.agg(sum(parts, F.lit(0)).cast("long").alias("rows"))


def cube(encoded: DataFrame, dims: Sequence[Dimension], values: Sequence[str] = ()) -> DataFrame:
    """Counts (n) and sums of value columns for each combination of bins. Where combinations are few, any filter and histogram over these
    dimensions can be answered from it, weighted by n."""
    return encoded.groupBy(*[d.column for d in dims]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(v).cast("double")).alias(v) for v in values])
