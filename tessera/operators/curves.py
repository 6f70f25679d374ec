"""Summaries of ordered curves (cell, step, metric)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def tail_mean(curve: DataFrame, upto: int | None = None, count: int = 5) -> DataFrame:
    """Mean of each cell's last `count` rows with step <= upto; null where there are fewer."""
    rows = curve if upto is None else curve.where(F.col("step") <= upto)
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("step")))).where(F.col("n") <= count)
    return last.groupBy("cell").agg(F.when(F.count("*") == count, F.avg("metric")).alias("tail"))


def rolling_mean(curve: DataFrame, count: int = 5) -> DataFrame:
    """Trailing means over full frames only."""
    frame = Window.partitionBy("cell").orderBy("step").rowsBetween(1 - count, 0)
    return curve.select("cell", "step", F.avg("metric").over(frame).alias("rolling"), F.count("metric").over(frame).alias("n")).where(F.col("n") == count).drop("n")


def tails_at(curve: DataFrame, anchors: list[int], count: int = 5) -> DataFrame:
    """tail_<anchor> for each anchor step, in one pass; null where a frame is short."""
    ordered = Window.partitionBy("cell").orderBy("step").rowsBetween(1 - count, 0)
    framed = curve.select("cell", "step", F.when(F.count("metric").over(ordered) == count, F.avg("metric").over(ordered)).alias("mean"))
    return framed.groupBy("cell").agg(*[F.max_by("mean", F.when(F.col("step") <= a, F.col("step"))).alias(f"tail_{a}") for a in anchors])


def drops(tails: DataFrame, anchors: list[int], small: float) -> DataFrame:
    """Falls between neighbouring anchors, and whether all are small, all positive, and the last against the first."""
    names = [f"drop_{a}_{b}" for a, b in zip(anchors[:-1], anchors[1:], strict=True)]
    found = tails.select("cell", *[(F.col(f"tail_{a}") - F.col(f"tail_{b}")).alias(n) for n, a, b in zip(names, anchors[:-1], anchors[1:], strict=True)])
    every = lambda test: F.forall(F.array(*names), test)
    return found.select("*", every(lambda d: d <= small).alias("all_small"), every(lambda d: d > 0).alias("all_positive"), F.try_divide(F.col(names[-1]), F.col(names[0])).alias("ratio"))


def shape(all_small: Column, ratio: Column, speeding: float = 1.0) -> Column:
    """NOT_STABLE, STABLE_BUT_ACCELERATING or STABLE."""
    return F.when(~F.coalesce(all_small, F.lit(False)), "NOT_STABLE").when(ratio > speeding, "STABLE_BUT_ACCELERATING").otherwise("STABLE")


def degradation(curve: DataFrame, count: int = 5, limit: float = 0.002) -> DataFrame:
    """Last rolling mean less the best one, by cell, and whether that passes the limit."""
    rolled = rolling_mean(curve, count).groupBy("cell").agg(F.max_by("rolling", "step").alias("last"), F.min("rolling").alias("best"))
    return rolled.select("cell", (F.col("last") - F.col("best")).alias("rise"), (F.col("last") - F.col("best") > limit).alias("degraded"))


def late_change(curve: DataFrame, count: int = 8) -> DataFrame:
    """Mean of the last `count` rows less that of the `count` before them; null where there are fewer."""
    n = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("step")))
    rows = curve.withColumn("n", n).where(F.col("n") <= 2 * count)
    late = F.avg(F.when(F.col("n") <= count, F.col("metric")))
    early = F.avg(F.when(F.col("n") > count, F.col("metric")))
    return rows.groupBy("cell").agg(F.when(F.count("*") == 2 * count, late - early).alias("change"))


def _pooled(values: list[float]) -> list[float]:
    blocks: list[list[float]] = []
    for v in values:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            mean, size = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + mean * size) / (blocks[-1][1] + size), blocks[-1][1] + size]
    return [mean for mean, size in blocks for _ in range(size)]


@F.arrow_udf(ArrayType(DoubleType()))
def _fits(metrics: pa.Array) -> pa.Array:
    return pa.array([_pooled(m) for m in metrics.to_pylist()], pa.list_(pa.float64()))


def nonincreasing_fit(curve: DataFrame) -> DataFrame:
    """Least-squares non-increasing fit of each cell's curve, by pooling neighbours that violate it.

    A curve is one row of arrays, so that a batch of cells goes through Python at a time.
    """
    rows = curve.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("step", "metric"))).alias("c"))
    fitted = rows.select("cell", F.explode(F.arrays_zip(F.col("c.step").alias("step"), F.col("c.metric").alias("metric"), _fits(F.col("c.metric")).alias("fit"))).alias("z"))
    return fitted.select("cell", F.col("z.step").alias("step"), F.col("z.metric").alias("metric"), F.col("z.fit").alias("fit"))


def acceleration(control: DataFrame, selected: DataFrame, targets: int = 5) -> DataFrame:
    """By cell: median ratio of the first steps at which two fits reach levels inside their common range.

    Pairs that `unpaired` names have no such ratio, or none that compares like with like.
    """
    ends = lambda df, n: df.groupBy("cell").agg(F.max("fit").alias(f"hi_{n}"), F.min("fit").alias(f"lo_{n}"))
    common = ends(control, "c").join(ends(selected, "s"), "cell").select("cell", F.least("hi_c", "hi_s").alias("hi"), F.greatest("lo_c", "lo_s").alias("lo")).where("hi > lo")
    levels = common.select("cell", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(targets)), lambda k: F.col("hi") - (F.col("hi") - F.col("lo")) * k / (targets + 1))).alias("n", "level"))
    reach = lambda df, name: levels.join(df, "cell").where(F.col("fit") <= F.col("level")).groupBy("cell", "n").agg(F.min("step").alias(name))
    return reach(control, "c").join(reach(selected, "s"), ["cell", "n"]).groupBy("cell").agg(F.median(F.col("c") / F.col("s")).alias("speedup"), F.count("*").alias("levels"))


def unpaired(control: DataFrame, selected: DataFrame) -> DataFrame:
    """(cell, problem) of pairs of fits that cannot be compared: one is missing, their steps differ, or their ranges do not overlap."""
    c, s = control.select("cell", "step", F.col("fit").alias("a")), selected.select("cell", "step", F.col("fit").alias("b"))
    both = c.join(s, ["cell", "step"], "full").groupBy("cell")
    ranges = both.agg(F.count("a").alias("n"), F.count("b").alias("m"), F.bool_or(F.col("a").isNull() | F.col("b").isNull()).alias("differ"), F.least(F.max("a"), F.max("b")).alias("hi"), F.greatest(F.min("a"), F.min("b")).alias("lo"))
    problem = F.when((F.col("n") == 0) | (F.col("m") == 0), "one curve").when(F.col("differ"), "steps differ").when(F.col("hi") <= F.col("lo"), "no common range")
    return ranges.select("cell", problem.alias("problem")).where("problem is not null")


def step_violations(curve: DataFrame, start: int, by: int) -> DataFrame:
    """Cells whose steps are not start, start + by, and so on."""
    seen = curve.groupBy("cell").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return seen.where(F.col("steps") != F.transform(F.sequence(F.lit(0), F.size("steps") - 1), lambda k: (start + k * by).cast("bigint"))).select("cell", F.size("steps").cast("bigint").alias("n"))


def boundary_change(first: DataFrame, second: DataFrame) -> DataFrame:
    """Last value of one curve less the first of the next."""
    a, b = first.groupBy("cell").agg(F.max_by("metric", "step").alias("last")), second.groupBy("cell").agg(F.min_by("metric", "step").alias("first"))
    return a.join(b, "cell").select("cell", (F.col("last") - F.col("first")).alias("change"))


