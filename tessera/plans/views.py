"""Cohort relations as views over the driver's tables, in Spark and in DuckDB SQL.

genotype(variant, sample, dosage): a dosage of 0, 1, 2, or null where missing.
variant(variant, chrom, pos, ref, alt); sample(sample, split, stratum);
phenotype(sample, y); edges(a, b); curve(cell, step, metric);
interval(chrom, start, stop, score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table

PRELUDE = {
    "genotype": """SELECT l_partkey AS variant, l_suppkey AS sample,
      CASE WHEN min(l_discount) = 0 THEN NULL ELSE CAST(sum(l_quantity) AS BIGINT) % 3 END AS dosage
      FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "variant": """SELECT p_partkey AS variant, 'chr' || CAST(p_size % 5 AS VARCHAR) AS chrom, p_partkey * 1000 AS pos,
      substr(p_brand, 1, 1) AS ref, substr(p_type, 1, CAST(1 + p_size % 2 AS INT)) AS alt FROM part""",
    "sample": """SELECT s_suppkey AS sample,
      CASE WHEN s_suppkey % 10 < 6 THEN 'train' WHEN s_suppkey % 10 < 8 THEN 'validation' WHEN s_suppkey % 10 = 8 THEN 'test' ELSE 'holdout' END AS split,
      'n' || CAST(s_nationkey AS VARCHAR) AS stratum FROM supplier""",
    "phenotype": "SELECT s_suppkey AS sample, s_acctbal AS y FROM supplier",
    "edges": """SELECT DISTINCT least(o_custkey, o_orderkey % 1500 + 1) AS a, greatest(o_custkey, o_orderkey % 1500 + 1) AS b
      FROM orders WHERE o_custkey <> o_orderkey % 1500 + 1""",
    "curve": """SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS cell,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS step, value AS metric FROM events""",
    "interval": """SELECT 'chr' || CAST(s_nationkey % 5 AS VARCHAR) AS chrom, s_suppkey * 18000 AS start,
      s_suppkey * 18000 + 1000 * (5 + s_nationkey) AS stop, round(s_acctbal, 2) AS score FROM supplier""",
}


def genotype(spark: SparkSession, sf: str, dealt_by: str | None = None) -> DataFrame:
    """Calls; dealt by variant or by sample at once if the next step gathers these, which saves it a shuffle."""
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("variant"), F.col("l_suppkey").alias("sample"), "l_discount", "l_quantity")
    rows = (line.repartition(dealt_by) if dealt_by else line).groupBy("variant", "sample")
    summed = rows.agg(F.min("l_discount").alias("least"), F.sum("l_quantity").cast("bigint").alias("total"))
    return summed.select("variant", "sample", F.when(F.col("least") != 0, F.col("total") % 3).alias("dosage"))


def variant(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("variant"), F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")).alias("chrom"), (F.col("p_partkey") * 1000).alias("pos"), F.substring("p_brand", 1, 1).alias("ref"), F.expr("substring(p_type, 1, 1 + p_size % 2)").alias("alt"))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    digit = F.col("s_suppkey") % 10
    split = F.when(digit < 6, "train").when(digit < 8, "validation").when(digit == 8, "test").otherwise("holdout")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), split.alias("split"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("stratum"))


def phenotype(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("y"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(table(spark, sf, "orders"))


def _edges(orders: DataFrame) -> DataFrame:
    other = F.col("o_orderkey") % 1500 + 1
    rows = orders.where(F.col("o_custkey") != other)
    return rows.select(F.least("o_custkey", other).alias("a"), F.greatest("o_custkey", other).alias("b")).distinct()


def curve(spark: SparkSession, sf: str) -> DataFrame:
    by_id = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("cell"), F.row_number().over(by_id).cast("bigint").alias("step"), F.col("value").alias("metric"))


def interval(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("s_suppkey") * 18000
    return table(spark, sf, "supplier").select(F.concat(F.lit("chr"), (F.col("s_nationkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 1000 * (5 + F.col("s_nationkey"))).alias("stop"), F.round("s_acctbal", 2).alias("score"))
