"""Power by simulation: draws are hashes of their names, so that any engine repeats them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import unit_draw


def normal_draw(*parts: Column | str) -> Column:
    """A standard normal draw that depends on the parts alone."""
    radius = F.sqrt(-2.0 * F.log(1.0 - unit_draw(*parts, F.lit("r"))))
    return radius * F.cos(2.0 * math.pi * unit_draw(*parts, F.lit("t")))


def unit_lower_bounds(spark: SparkSession, sizes: list[int], outer: int, resamples: int, seed: str, level: float = 0.95) -> DataFrame:
    """(size, m, bound): lower percentile-bootstrap bounds of the mean of `size` standard normal draws.

    The joined tables are sizes x outer x resamples draws, whatever the data's size.
    """
    grid = spark.createDataFrame([(s,) for s in sizes], "size bigint").join(spark.range(outer).withColumnRenamed("id", "m"))
    units = grid.select("size", "m", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    values = units.select("size", "m", "i", normal_draw(F.lit(seed), "size", "m", "i").alias("x"))
    draws = units.join(spark.range(resamples).withColumnRenamed("id", "b")).select("size", "m", "b", F.floor(unit_draw(F.lit(seed + "-boot"), "size", "m", "b", "i") * F.col("size")).alias("i"))
    means = draws.join(values, ["size", "m", "i"]).groupBy("size", "m", "b").agg(F.avg("x").alias("mean"))
    return means.groupBy("size", "m").agg(F.percentile("mean", F.lit((1 - level) / 2)).alias("bound"))


def detection_power(bounds: DataFrame, effects: list[float], spreads: list[float]) -> DataFrame:
    """(effect, spread, size, power): how often the bound of the shifted and scaled draws is above zero."""
    cells = bounds.sparkSession.createDataFrame([(e, s) for e in effects for s in spreads], "effect double, spread double")
    above = (F.col("bound") > -F.col("effect") / F.col("spread")).cast("double")
    return bounds.join(F.broadcast(cells)).groupBy("effect", "spread", "size").agg(F.avg(above).alias("power"))
