"""Questions answered from histograms: means, shares, downsampled charts, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.functions.quantize import Scale, bin_of, bin_value
from binweave.plans.encode import Dimension


def total(hist: DataFrame) -> DataFrame:
    """(count): rows of a histogram."""
    return hist.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"))


def mean(hist: DataFrame, dim: Dimension) -> DataFrame:
    """(mean): of the values that bins stand for, weighted by their rows; null without rows."""
    return hist.agg((F.sum(bin_value(F.col("bin"), dim.scale) * F.col("count")) / F.sum("count")).alias("mean"))


def downsampled(hist: DataFrame, dim: Dimension, target: int) -> DataFrame:
    """(chunk, count): runs of max(1, floor(bins / target)) bins added up; the last may be shorter."""
    size = max(1, dim.bins // target)
    return hist.groupBy(F.floor(F.col("bin") / size).cast("int").alias("chunk")).agg(F.sum("count").alias("count"))


def by_category(hist: DataFrame, dim: Dimension, labels: Sequence[str]) -> DataFrame:
    """(label, count): bins of a numeric dimension of codes, each decoded to the nearest code; equal labels are one."""
    code = F.least(F.greatest(F.floor(bin_value(F.col("bin"), dim.scale) + 0.5), F.lit(0)), F.lit(len(labels) - 1)).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), code + 1)
    return hist.groupBy(label.alias("label")).agg(F.sum("count").alias("count"))


def brush(low: float, high: float, scale: Scale) -> tuple[int, int]:
    """The bins of a range of values, whichever end comes first."""
    a, b = bin_of(low, scale), bin_of(high, scale)
    return min(a, b), max(a, b)


def pixels_to_values(start: float, stop: float, width: float, scale: Scale) -> tuple[float, float]:
    """The range of values under a range of pixels of a chart."""
    at = lambda x: scale.low + min(max(x / width, 0.0), 1.0) * (scale.high - scale.low)
    return at(min(start, stop)), at(max(start, stop))


def benchmark_statistics(measurements: DataFrame) -> DataFrame:
    """(operation, size, avg, min, max, stddev, avg_memory) of measurements (operation, size, ms, memory)."""
    return measurements.groupBy("operation", "size").agg(F.avg("ms").alias("avg"), F.min("ms").alias("min"), F.max("ms").alias("max"), F.stddev_pop("ms").alias("stddev"), F.avg("memory").alias("avg_memory"))
