"""Decisions over small result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_max(value: Column) -> Column:
    """The largest value, or null if any is null; plain max would pass over those."""
    return F.when(F.count_if(value.isNull()) == 0, F.max(value))


def shared_level(scores: DataFrame, level: str, cell: str, score: str, baseline: float, worst: float, near: float) -> DataFrame:
    """One row: the lowest level whose mean gain over the baseline level is near the best one, among levels no cell loses more than `worst` at."""
    base = scores.where(F.col(level) == baseline).select(cell, F.col(score).alias("__base"))
    gains = scores.join(base, cell).groupBy(level).agg(F.min(F.col("__base") - F.col(score)).alias("least"), F.avg(F.col("__base") - F.col(score)).alias("mean"), F.median(F.col("__base") - F.col(score)).alias("median")).where(F.col("least") >= -worst)
    best = F.max("mean").over(Window.partitionBy(F.lit(1)))
    return gains.select("*", best.alias("best")).where(F.col("mean") >= F.col("best") - near).agg(F.min_by(F.struct(level, "least", "mean", "median"), level).alias("s")).select("s.*")


def least_sufficient(table: DataFrame, groups: list[str], size: str, power: str, wanted: float) -> DataFrame:
    """By group: the smallest size that reaches the wanted power; null where none does."""
    return table.groupBy(*groups).agg(F.min(F.when(F.col(power) >= wanted, F.col(size))).alias("needed"))


def pair_spread(df: DataFrame, group: str, key: str, spread: str) -> DataFrame:
    """Sums of the spreads of each pair of keys of a group, each pair once."""
    other = df.select(group, F.col(key).alias("other"), F.col(spread).alias("__s"))
    return df.join(other, group).where(F.col(key) < F.col("other")).select(group, key, "other", (F.col(spread) + F.col("__s")).alias("total"))


def envelope(grid: DataFrame, seconds: str, steps: str, runs: str, margin: float, limit_hours: float) -> DataFrame:
    """Hours that a grid of runs needs with a margin, and whether they stay within four fifths of the limit."""
    hours = F.sum(F.col(seconds) * F.col(steps) * F.col(runs)) / 3600.0 * margin
    return grid.agg(hours.alias("hours")).select("hours", (F.col("hours") <= 0.8 * limit_hours).alias("fits"))
