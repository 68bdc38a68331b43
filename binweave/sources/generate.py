"""Synthetic tables for benchmarks, from seeded generators that run on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(spark: SparkSession, rows: int, dims: int, low: float = 0.0, high: float = 1000.0, seed: int = 1) -> DataFrame:
    """row_order and dim0.. uniform in [low, high)."""
    return spark.range(rows).select(F.col("id").alias("row_order"), *[(F.rand(seed + k) * (high - low) + low).alias(f"dim{k}") for k in range(dims)])


def _normal(seed: int, mean: float, deviation: float, low: float, high: float) -> Column:
    return F.least(F.greatest(F.round(F.randn(seed) * deviation + mean), F.lit(low)), F.lit(high))


def flights(spark: SparkSession, rows: int, carriers: tuple[str, ...] = ("AA", "UA", "DL", "WN", "B6", "AS"), seed: int = 1) -> DataFrame:
    """Flights with day, hour, delay, distance and carrier, clamped normals where a real table has them."""
    pick = F.floor(F.rand(seed + 4) * len(carriers)).cast("int")
    return spark.range(rows).select(
        F.col("id").alias("row_order"), F.floor(F.rand(seed) * 90).alias("date"), _normal(seed + 1, 13, 4.5, 0, 23).alias("hour"), _normal(seed + 2, 8, 30, -60, 150).alias("delay"), _normal(seed + 3, 800, 450, 50, 2000).alias("distance"),
        pick.alias("carrier_index"), F.element_at(F.array(*[F.lit(c) for c in carriers]), pick + 1).alias("carrier"),
    )
