"""Filters, joins and set checks that count what they leave out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "retained") -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    return reduce(lambda done, rule: done.when(F.coalesce(rule[1], F.lit(False)), rule[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])).otherwise(otherwise)


def reason_counts(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str = "retained") -> DataFrame:
    """How many rows each reason claims."""
    return df.groupBy(first_reason(rules, otherwise).alias("reason")).agg(F.count("*").alias("n"))


def one_of_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; ties must not matter."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys only in a, in both, only in b."""
    sides = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return sides.agg(*[F.count_if(c).alias(n) for n, c in (("only_a", F.col("b").isNull()), ("both", F.col("a").isNotNull() & F.col("b").isNotNull()), ("only_b", F.col("a").isNull()))])


def checked_join(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join on keys, and a frame of violations: keys that repeat or miss on the right."""
    repeated = right.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("violation"))
    missing = left.join(right.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("missing").alias("violation"))
    return left.join(right, keys), repeated.unionByName(missing)


def union_with_blanks(frames: list[DataFrame], blank: str = "") -> DataFrame:
    """Rows of all frames under all columns in order of first sight; absent and null text is blank."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return joined.select(*[F.coalesce(F.col(c).cast("string"), F.lit(blank)).alias(c) for c in names])


def missing_cells(observed: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """Combinations of the levels (small lists) that were not observed."""
    grid = reduce(lambda a, b: a.crossJoin(b), [df.select(name).distinct() for name, df in levels.items()])
    return grid.join(observed.select(*levels).distinct(), list(levels), "left_anti")


def updated(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the patch's values where it has the key and a value."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != key])
    return base.join(p, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in base.columns])


def crossing_groups(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups whose rows lie in more than one part."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def same_partition(a: DataFrame, b: DataFrame, member: str, label: str) -> DataFrame:
    """Member sets that only one of two labellings has; empty if they are the same partition."""
    # a label's set is its smallest member and, for each member, that smallest one
    by_least = [f.select(member, F.min(member).over(Window.partitionBy(label)).alias("least")) for f in (a, b)]
    return by_least[0].exceptAll(by_least[1]).unionByName(by_least[1].exceptAll(by_least[0])).select("least").distinct()


def in_any_region(chrom: Column, pos: Column, regions: list[tuple[str, int, int]]) -> Column:
    """Whether a position lies in one of a few closed regions."""
    return reduce(lambda a, b: a | b, [(chrom == c) & pos.between(lo, hi) for c, lo, hi in regions], F.lit(False))
