"""Indexes: row ids by bin, in the order of bins and then ids.

Positions come from a range partitioning: tasks number their own rows, and the sizes of the partitions, a row for each, give where a
partition starts. No task sees more than its own range; ties in (bin, row id) go to different places by partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binweave.operators.histograms import dense, histogram
from binweave.plans.encode import Dimension
from binweave.plans.storage import shared_dir, stored


def clustered(encoded: DataFrame, dim: Dimension) -> DataFrame:
    """The table by ranges of bins and rows, sorted in each partition, so that a range of bins reads few cache batches or row groups. A bin of
    many rows is split among partitions by their place in the table."""
    numbered = encoded.withColumn("_row", F.monotonically_increasing_id())
    return numbered.repartitionByRange(F.col(dim.column), F.col("_row")).sortWithinPartitions(dim.column).drop("_row")


def offsets(encoded: DataFrame, dim: Dimension) -> DataFrame:
    """(bin, offset): rows in lower bins, for bins 0 .. n (n: all rows). The running sum is over at most 65,537 rows."""
    hist = dense(histogram(encoded, dim), dim)
    last = hist.sparkSession.range(1).select(F.lit(dim.bins).alias("bin"), F.lit(0).cast("long").alias("count"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return hist.unionByName(last).select("bin", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("offset"))


def row_ids(encoded: DataFrame, dim: Dimension, row_id: str) -> DataFrame:
    """(position, bin, row_id): all rows in the order of bins, ids ascending in each."""
    rows = encoded.select(F.col(dim.column).alias("bin"), F.col(f"`{row_id}`").alias("row_id"))
    return positions(rows, "bin", "row_id").select("position", "bin", "row_id")


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows with position, counted from 0 in the given order; the sorted rows are stored in the shared folder."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spark = rows.sparkSession
    numbered = stored(sorted_.withColumn("_m", F.monotonically_increasing_id()), shared_dir(spark, "positions"))
    part = F.shiftright("_m", 33)
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))  # a row for each partition
    placed = numbered.join(F.broadcast(starts), part == F.col("_p"))
    return placed.withColumn("position", (F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m", "_p", "_s")


def lookup(encoded: DataFrame, dim: Dimension, low: float, high: float, *columns: Column) -> DataFrame:
    """Rows whose bin is in [low, high], bounds clamped to the bins there are."""
    inside = F.col(dim.column).between(F.lit(max(low, 0)), F.lit(min(high, dim.bins - 1)))
    return encoded.where(inside).select(*columns) if columns else encoded.where(inside)


def size_bytes(rows: int, dim: Dimension) -> int:
    """Bytes of an index of 32-bit row ids and offsets."""
    return 4 * rows + 4 * (dim.bins + 1)
