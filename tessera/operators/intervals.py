"""Joins of positions and intervals, by bins instead of nested loops.

Intervals are (chrom, start, stop), half open. Each is listed under every bin
of BIN width that it touches and a position under its own, so that a range
join is an equi-join on (chrom, bin) with a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import numbering

BIN = 100_000


def _binned(intervals: DataFrame, width: int) -> DataFrame:
    return intervals.where("start < stop").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))


def covering(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Each point (chrom, pos, ...) with each interval that covers it."""
    cut = intervals.withColumnsRenamed({c: f"i_{c}" for c in intervals.columns if c not in ("chrom", "start", "stop")})
    return points.withColumn("bin", F.floor(F.col("pos") / width)).join(_binned(cut, width), ["chrom", "bin"]).where("start <= pos and pos < stop").drop("bin")


def cover_value(points: DataFrame, intervals: DataFrame, key: str, missing: float = 0.0, width: int = BIN) -> DataFrame:
    """points with value: the score of the last covering interval by (start, stop, score), or `missing`."""
    best = covering(points, intervals, width).groupBy(key).agg(F.max(F.struct("start", "stop", "i_score")).alias("best"))
    return points.join(best, key, "left").withColumn("value", F.coalesce(F.col("best.i_score"), F.lit(missing))).drop("best")


def covered_count(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """One row: how many points some interval covers, and how many there are."""
    hit = _binned(intervals, width).withColumnRenamed("chrom", "c").alias("i")
    at = points.withColumn("bin", F.floor(F.col("pos") / width)).alias("p")
    found = at.join(hit, (F.col("p.chrom") == F.col("i.c")) & (F.col("p.bin") == F.col("i.bin")) & (F.col("i.start") <= F.col("p.pos")) & (F.col("p.pos") < F.col("i.stop")), "left_semi")
    return found.agg(F.count("*").alias("covered")).crossJoin(points.agg(F.count("*").alias("points")))


def within_radius(centers: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Pairs with |pos - center| <= radius; centers have (chrom, center, ...)."""
    near = centers.withColumn("bin", F.explode(F.sequence(F.floor((F.col("center") - radius) / radius), F.floor((F.col("center") + radius) / radius))))
    return points.withColumn("bin", F.floor(F.col("pos") / radius)).join(near, ["chrom", "bin"]).where(F.abs(F.col("pos") - F.col("center")) <= radius).drop("bin")


def nearest_distance(points: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """points with the distance to the nearest site (chrom, site) on their chromosome, null without one.

    Both tables in one sorted pass: the last site at or before a point and the first at or after it.
    """
    both = points.select("chrom", "pos", key, F.lit(None).cast("bigint").alias("site")).unionByName(sites.select("chrom", F.col("site").alias("pos"), F.lit(None).cast(points.schema[key].dataType).alias(key), F.col("site").cast("bigint").alias("site")))
    found = numbering.nearest_known(both, "chrom", "pos", F.col("site"))
    return found.withColumn("distance", F.least(F.col("pos") - F.col("__back"), F.col("__ahead") - F.col("pos"))).where(F.col(key).isNotNull()).select("chrom", "pos", key, "distance")


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals: columns of left, and of right with the prefix r_."""
    r = _binned(right, width).withColumnsRenamed({c: f"r_{c}" for c in right.columns if c != "chrom"})
    pairs = _binned(left, width).join(r, ["chrom", "bin"]).where("start < r_stop and r_start < stop")
    # a pair meets in several bins; only the one where the overlap begins counts
    return pairs.where(F.col("bin") == F.floor(F.greatest("start", "r_start") / width)).drop("bin")


def runs(df: DataFrame, size: int, by: str, order: list[str]) -> DataFrame:
    """Number of the run of `size` rows that each row falls into, afresh for each value of `by`."""
    return df.withColumn("run", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))


def tiles(spans: DataFrame, size: int) -> DataFrame:
    """Tiles of `size` over each (chrom, start, stop); the last one ends with its span."""
    begun = spans.where("start < stop").select("chrom", F.col("stop").alias("end"), F.explode(F.sequence("start", F.col("stop") - 1, F.lit(size).cast("bigint"))).alias("start"))
    return begun.select("chrom", "start", F.least(F.col("start") + size, "end").alias("stop"))


def map_tiles(curve: DataFrame, size: float) -> DataFrame:
    """Tiles (chrom, block, start, stop) of a curve (chrom, x, y) whose y never falls: a tile begins where y passes a multiple of size.

    A multiple that lies between two points begins a tile at the later one, however many lie between. Positions count from 1
    and the tiles from 0, so the last one ends behind its chromosome's last point.
    """
    begun = curve.groupBy("chrom", F.floor(F.col("y") / size).alias("step")).agg(F.min("x").alias("first"), F.max("x").alias("last"))
    by_step = Window.partitionBy("chrom").orderBy("step")  # one row a tile
    stop = F.coalesce(F.lead("first").over(by_step) - 1, F.col("last"))
    tiles = begun.select("chrom", (F.row_number().over(by_step) - 1).cast("bigint").alias("block"), (F.col("first") - 1).alias("start"), stop.alias("stop"))
    return tiles.where("stop > start")


def interpolated(points: DataFrame, curve: DataFrame, key: str) -> DataFrame:
    """points (chrom, pos) with y read off the curve (chrom, x, y) by straight lines, held at its ends."""
    both = points.select("chrom", F.col("pos").alias("x"), key, F.lit(None).cast("double").alias("y")).unionByName(curve.select("chrom", "x", F.lit(None).cast(points.schema[key].dataType).alias(key), F.col("y").cast("double").alias("y")))
    known = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    found = numbering.nearest_known(both, "chrom", "x", known).withColumnsRenamed({"__back": "l", "__ahead": "r"}).where(F.col(key).isNotNull())
    inner = F.col("l.y") + (F.col("r.y") - F.col("l.y")) * (F.col("x") - F.col("l.x")) / (F.col("r.x") - F.col("l.x"))
    y = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull() | (F.col("l.x") == F.col("r.x")), F.col("l.y")).otherwise(inner)
    return found.select("chrom", F.col("x").alias("pos"), key, y.alias("value"))


def sorted_violations(df: DataFrame, by: str, order: str, value: str, strict: bool = True) -> DataFrame:
    """Rows whose value does not grow (or shrinks, if not strict) from the row before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("before", before).where(F.col(value) <= F.col("before") if strict else F.col(value) < F.col("before"))


