"""Bootstraps, permutations and masks whose draws are hashes of their names.

Draws do not depend on partitioning or order, so any engine repeats them. A
bootstrap joins a table of draws (replicates x rows) with per-row sums, never
with raw detail; clusters are drawn as whole pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import ranking_key, unit_draw
from tessera.operators import numbering
from tessera.session import keep


def numbered(df: DataFrame, order: list[str], *groups: str) -> DataFrame:
    """df with i from 0 and n by group; without groups over ranges of the whole table."""
    if not groups:
        return numbering.numbered(df, "i", *order).crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))
    return df.select("*", (F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1).cast("bigint").alias("i"), F.count("*").over(Window.partitionBy(*groups)).alias("n"))


def draws(units: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(rep, slot, i): as many draws with replacement as units, for each replicate. units: (i, n)."""
    slots = units.select(F.col("i").alias("slot"), "n").crossJoin(units.sparkSession.range(replicates).select(F.col("id").alias("rep")))
    return slots.select("rep", "slot", F.floor(unit_draw(F.lit(seed), "rep", "slot") * F.col("n")).alias("i"))


def draw_weights(units: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(rep, i, w): how often each replicate draws each unit."""
    return draws(units, replicates, seed).groupBy("rep", "i").agg(F.count("*").alias("w"))


#: Units that are sent to every task.
SENT_UNITS = 500_000


def replicated(units: DataFrame, replicates: int, seed: str, statistics: list[Column], *by: str) -> DataFrame:
    """Statistics of each replicate; aggregates may use w, a unit's weight, and are sums over units.

    Every draw is a row of weight 1, made and added up where it is made: up to SENT_UNITS units are broadcast, so that nothing
    is shuffled but a row a replicate and task; of more units the draws are shuffled once.
    """
    own = keep(units, "units")
    drawn = draws(own, replicates, seed)
    sent = F.broadcast(own) if own.count() <= SENT_UNITS else own
    return drawn.join(sent, "i").withColumn("w", F.lit(1)).groupBy("rep", *by).agg(*statistics)


def interval(reps: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic over replicates, and their number."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return reps.agg(q[0].alias("low"), q[1].alias("high"), F.count(value).alias("replicates"))


def gain(y: str, a: str, b: str, mean: str) -> Column:
    """R2 of b less R2 of a over weighted rows, both from the same mean."""
    error = lambda p: F.sum(F.col("w") * (F.col(y) - F.col(p)) ** 2)
    return (error(a) - error(b)) / F.nullif(F.sum(F.col("w") * (F.col(y) - F.col(mean)) ** 2), F.lit(0.0))


def two_way(cells: DataFrame, left: str, right: str, replicates: int, seed: str, statistic: Column) -> DataFrame:
    """statistic of each replicate with w the product of both sides' draw weights; by replicate and left unit."""

    def weights(side: str) -> DataFrame:
        units = numbered(cells.select(side).distinct(), [side])
        return draw_weights(units, replicates, f"{seed}-{side}").join(units.select("i", side), "i").select("rep", side, F.col("w").alias(f"w_{side}"))

    joined = cells.join(weights(left), left).join(weights(right), ["rep", right])
    return joined.withColumn("w", F.col(f"w_{right}")).groupBy("rep", left, f"w_{left}").agg(statistic.alias("value"))


def permuted(df: DataFrame, value: str, key: str, replicates: int, seed: str, *strata: str) -> DataFrame:
    """(rep, rows of df, permuted): the values of each stratum dealt anew in hash order, for each replicate."""
    reps = df.crossJoin(df.sparkSession.range(replicates).select(F.col("id").alias("rep")))
    by_key = Window.partitionBy("rep", *strata).orderBy(key)
    by_hash = Window.partitionBy("rep", *strata).orderBy(ranking_key(F.lit(seed), "rep", key), key)
    kept = reps.withColumn("__i", F.row_number().over(by_key))
    dealt = reps.select("rep", *strata, F.col(value).alias("permuted"), F.row_number().over(by_hash).alias("__i"))
    return kept.join(dealt, ["rep", *strata, "__i"]).drop("__i")


def permutation_p(observed: Column, null: str) -> Column:
    """(1 + null values at least as large) / (1 + null values), as an aggregate."""
    return (1 + F.count_if(F.abs(null) >= F.abs(observed))) / (1 + F.count("*"))


def bernoulli(rate: float, *parts: Column | str) -> Column:
    """True with the given chance, decided by the parts alone."""
    return unit_draw(*parts) < rate


def folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """fold of each row: groups in hash order dealt round; a group never crosses folds."""
    groups = df.select(group).distinct()
    placed = numbering.numbered(groups, "__i", ranking_key(F.lit(seed), group))
    return df.join(placed.select(group, (F.col("__i") % k).alias("fold")), group)


def signs(*parts: Column | str) -> Column:
    """-1 or 1, decided by the parts alone."""
    return F.when(unit_draw(*parts) < 0.5, -1.0).otherwise(1.0)


def largest_of_family(terms: DataFrame, candidate: str, unit: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(candidate, statistic, p): |sum| / root of sum of squares, and its family-wise p by sign-flipping units together."""
    norm = F.sqrt(F.nullif(F.sum(F.col(value) ** 2), F.lit(0.0)))
    observed = terms.groupBy(candidate).agg((F.abs(F.sum(value)) / norm).alias("statistic"))
    reps = terms.crossJoin(terms.sparkSession.range(replicates).select(F.col("id").alias("rep")))
    largest = reps.groupBy("rep", candidate).agg((F.abs(F.sum(signs(F.lit(seed), "rep", unit) * F.col(value))) / norm).alias("s")).groupBy("rep").agg(F.max("s").alias("top"))
    tops = largest.agg(F.sort_array(F.collect_list("top")).alias("tops"))  # one number a replicate
    p = (1 + F.size(F.filter("tops", lambda t: t >= F.col("statistic")))) / F.lit(float(replicates + 1))
    return observed.crossJoin(F.broadcast(tops)).select(candidate, "statistic", p.alias("p"))
