"""Ordered classification rules, priorities and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_rule(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds; unknown conditions don't."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules], F.lit(default))


def priority(base: int, step: int, useful: Sequence[Column]) -> Column:
    """A base score, and a step for each column that has text."""
    return sum((F.when(F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)), step).otherwise(0) for c in useful), F.lit(base))


def tiles(spark: SparkSession, south: float, west: float, north: float, east: float, grid: int) -> DataFrame:
    """(tile, south, west, north, east) row by row; the last edges are those of the box."""
    high, wide = (north - south) / grid, (east - west) / grid
    t = spark.range(grid * grid).select(F.col("id").alias("tile"), F.floor(F.col("id") / grid).alias("r"), (F.col("id") % grid).alias("c"))
    edge = lambda k, n, start, step, last: F.when(F.col(k) + n == grid, last).otherwise(start + (F.col(k) + n) * step)
    return t.select("tile", (south + F.col("r") * high).alias("south"), (west + F.col("c") * wide).alias("west"), edge("r", 1, south, high, north).alias("north"), edge("c", 1, west, wide, east).alias("east"))
