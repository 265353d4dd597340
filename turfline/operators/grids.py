"""Regular grids of scenario values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def value_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of the given values, one exploded array per column."""
    grid = spark.range(1).select()
    for name, items in values.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in items])).alias(name))
    return grid


def scenario_grid(spark: SparkSession) -> DataFrame:
    """Spot 80 to 30, distance 1 to 15, down 1 to 4."""
    return value_grid(spark, spot_y=range(80, 29, -1), distance=range(1, 16), down=range(1, 5))


def composition_grid(
    spark: SparkSession,
    names: Sequence[str] = ("blitz", "middle", "hooks", "flat", "third"),
    low: int = 1,
    high: int = 7,
    total: int = 7,
) -> DataFrame:
    """Ways to split ``total`` players over the named roles, each role low to high."""
    grid = value_grid(spark, **{n: range(low, high + 1) for n in names})
    return grid.where(sum((F.col(n) for n in names[1:]), F.col(names[0])) == total)


def grid_counts(grid: DataFrame, df: DataFrame, columns: Mapping[str, object], count: str = "plays") -> DataFrame:
    """How many rows of ``df`` fall on each grid point.

    The rows are counted per point before they meet the grid.
    """
    seen = df.groupBy(*[c.alias(name) for name, c in columns.items()]).agg(F.count(F.lit(1)).alias(count))
    return grid.join(seen, list(columns), "left").withColumn(count, F.coalesce(count, F.lit(0)))
