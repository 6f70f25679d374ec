"""Row numbers and running sums over a whole table without one task for all rows.

Rows are dealt into ranges of the order and written once, so that every later
step sees the same ranges; a range's rows are numbered on their own, and the
ranges' counts, one row each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import keep


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with __range, the number of its range of the order; equal keys share a range."""
    return keep(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def offsets(ranges: DataFrame, amount: Column) -> DataFrame:
    """(__range, __before): the sum of an aggregate over the ranges before each. One row a range."""
    sums = ranges.groupBy("__range").agg(amount.cast("bigint").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the number, from 0, of each row in the order."""
    ranges = in_ranges(df, *order)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = ranges.withColumn("__place", inside).join(F.broadcast(offsets(ranges, F.count("*"))), "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__place")).cast("bigint")).drop("__range", "__before", "__place")


def running(df: DataFrame, name: str, weight: Column, *order: Column | str) -> DataFrame:
    """df with the sum of a whole-numbered weight over all rows at or before each in the order; equals count together."""
    ranges = in_ranges(df, *order)
    inside = F.sum(weight.cast("bigint")).over(Window.partitionBy("__range").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))
    placed = ranges.withColumn("__place", inside).join(F.broadcast(offsets(ranges, F.sum(weight.cast("bigint")))), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__before", "__place")


def running_in_groups(df: DataFrame, group: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sum, by name, of each column over its group's rows up to each row. A group may hold any share of the rows.

    Sums run inside ranges of the order; groups that lie in several ranges, at most one more than there are ranges, carry theirs over.
    """
    ranges = in_ranges(df, F.col(group), *order)
    inside = Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranges.groupBy("__range", group).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    whole = Window.partitionBy(group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__range", group, F.count("*").over(whole).alias("__ranges"), *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums])
    carried = F.broadcast(carried.where("__ranges > 1").drop("__ranges"))
    placed = ranges.select("*", *[F.sum(c).over(inside).alias(f"__in_{n}") for n, c in sums.items()]).join(carried, ["__range", group], "left")
    return placed.select(*df.columns, *[(F.col(f"__in_{n}") + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in sums])


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """df with the rank from 1 of each value among its group's, equal values sharing their mean rank, and __n, the group's rows.

    Ranks come from the counts of distinct values, in ranges over all groups, so a group may hold any share of the rows.
    """
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("__k"))
    upto = running(counts, "__upto", F.col("__k"), *groups, value)
    starts = upto.groupBy(*groups).agg(F.min(F.col("__upto") - F.col("__k")).alias("__start"), F.sum("__k").alias("__n"))
    same = lambda left, right, columns: [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    ranked = upto.alias("u").join(starts.alias("s"), same("u", "s", groups))
    rank = F.col("__upto") - F.col("__start") - F.col("__k") + (F.col("__k") + 1) / 2.0
    table = ranked.select(*[F.col(f"u.{c}").alias(c) for c in (*groups, value)], rank.alias(name), "__n")
    return df.alias("d").join(table.alias("t"), same("d", "t", (*groups, value))).select("d.*", f"t.{name}", "t.__n")


def nearest_known(df: DataFrame, group: str, order: str, known: Column) -> DataFrame:
    """df with __back and __ahead: the last known value at or before each row of its group, and the first at or after it.

    Windows stay inside ranges of the order and only look back, once in each direction: for a frame that ends with its
    partition, Spark walks all rows ahead again at every row. Each range's first and last known values, one row a range, carry over.
    """
    ranges = in_ranges(df.withColumn("__known", known), group, order)
    inside, upto = Window.partitionBy("__range", group), (Window.unboundedPreceding, 0)
    back = F.last("__known", ignorenulls=True).over(inside.orderBy(order).rangeBetween(*upto))
    ahead = F.last("__known", ignorenulls=True).over(inside.orderBy(F.desc(order)).rangeBetween(*upto))
    placed = F.when(F.col("__known").isNotNull(), F.struct(F.col(order).alias("at"), F.col("__known").alias("known")))
    ends = ranges.groupBy("__range", group).agg(F.min(placed)["known"].alias("__first"), F.max(placed)["known"].alias("__last"))
    by_range, earlier = Window.partitionBy(group), (Window.unboundedPreceding, -1)
    before = F.last("__last", ignorenulls=True).over(by_range.orderBy("__range").rowsBetween(*earlier))
    after = F.last("__first", ignorenulls=True).over(by_range.orderBy(F.desc("__range")).rowsBetween(*earlier))
    carried = ends.select("__range", group, before.alias("__before"), after.alias("__after"))
    found = ranges.withColumn("__in_back", back).withColumn("__in_ahead", ahead).join(carried, ["__range", group])
    return found.select(*df.columns, F.coalesce("__in_back", "__before").alias("__back"), F.coalesce("__in_ahead", "__after").alias("__ahead"))
