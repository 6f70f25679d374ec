"""Deterministic ordering, top-k, quotas and splits, all by hashed keys."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import UNIT, ranking_key, stable_hex
from tessera.operators import numbering


def top_by(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1; filters before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def first_windows(df: DataFrame, chrom: str, window: str, most: int) -> DataFrame:
    """Rows of the first `most` windows of each chromosome."""
    return df.withColumn("__w", F.dense_rank().over(Window.partitionBy(chrom).orderBy(window))).where(F.col("__w") <= most).drop("__w")


def proportional(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """About `most` rows, shared over the groups by size; each group has one at least."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    quota = sizes.crossJoin(total).select(group, F.greatest(F.lit(1), F.bround(most * F.col("n") / F.col("total"))).cast("bigint").alias("quota"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).join(quota, group).where("rank <= quota").drop("rank", "quota")


def largest_remainder(sizes: DataFrame, name: str, n: str, seats: int) -> DataFrame:
    """Seats for each row in proportion to n: whole shares, then by largest remainder and name."""
    every = Window.partitionBy(F.lit(1))
    exact = F.col(n) * seats / F.sum(n).over(every)
    shared = sizes.select(name, n, F.floor(exact).alias("whole"), (exact - F.floor(exact)).alias("rest"))
    left = F.lit(seats) - F.sum("whole").over(every)
    ranked = shared.select("*", left.alias("left"), F.row_number().over(Window.orderBy(F.desc(F.round("rest", 9)), name)).alias("place"))
    return ranked.select(name, n, (F.col("whole") + (F.col("place") <= F.col("left")).cast("bigint")).alias("seats"))


def hash_split(df: DataFrame, group: str, key: str, seed: str, share: float) -> DataFrame:
    """is_validation: by hash rank within each group, half-up share of it, at least one and at most all but one."""
    by_hash = Window.partitionBy(group).orderBy(ranking_key(F.lit(seed), F.col(key)))
    n = F.count("*").over(Window.partitionBy(group))
    wanted = F.least(F.greatest(F.floor(n * share + 0.5), F.lit(1)), n - 1)
    return df.select("*", (F.row_number().over(by_hash) <= wanted).alias("is_validation"))


def firewall(df: DataFrame, group: str, key: str, seeds: list[str], k: int) -> DataFrame:
    """historic: among the first k by hash under any of the seeds, in its group."""
    first = [F.row_number().over(Window.partitionBy(group).orderBy(ranking_key(F.lit(s), F.col(key)))) <= k for s in seeds]
    return df.select("*", F.exists(F.array(*first), lambda x: x).alias("historic"))


def half_up(x: float, digits: int) -> float:
    """x >= 0 rounded as SQL engines do it: the scaled value to the nearest whole number, halves up. From 2^52 on the scaled value is whole itself."""
    scaled = x * 10.0**digits
    low = float(math.floor(scaled)) if math.isfinite(scaled) else scaled
    out = (low + 1 if scaled - low >= 0.5 else low) / 10.0**digits
    return out if math.isfinite(out) else x


def greedy_split(units: DataFrame, stratum: str, unit: str, size: str, shares: dict[str, float], seed: str) -> DataFrame:
    """split of each unit: in every stratum larger units first, each where it leaves least squared deviation from the shares.

    Units of one size follow a seeded hash, and so do splits that leave the same deviation to six digits, rounded as in SQL. Each choice depends on those
    before it, so a stratum's units are handled in one group.
    """
    names = list(shares)

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([size, "__hash"], ascending=[False, True])
        total, held, out = float(frame[size].sum()), [0.0] * len(names), []
        wanted = [shares[s] * total for s in names]
        for own, n in zip(frame[unit].tolist(), frame[size].tolist(), strict=True):
            away = [[held[j] + n * (i == j) - wanted[j] for j in range(len(names))] for i in range(len(names))]
            left = [half_up(reduce(lambda s, d: s + d * d, a, 0.0), 6) for a in away]  # sum() would carry what each addition rounds off, as SQL does not
            tied = [i for i in range(len(names)) if left[i] == min(left)]
            text = lambda i, own=own: UNIT.join(map(str, (seed, frame[stratum].iloc[0], own, names[i])))
            best = tied[0] if len(tied) == 1 else min(tied, key=lambda i: hashlib.sha256(text(i).encode()).hexdigest())
            held[best] += n
            out.append(names[best])
        return frame.assign(split=out)[[stratum, unit, size, "split"]]

    kinds = dict(units.dtypes)
    rows = units.select(stratum, unit, size, stable_hex(F.lit(seed), stratum, unit).alias("__hash"))
    return rows.groupBy(stratum).applyInPandas(assign, f"{stratum} {kinds[stratum]}, {unit} {kinds[unit]}, {size} {kinds[size]}, split string")


def even_thin(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group spread evenly over its order, first and last among them; all rows of smaller groups."""
    ranked = df.select("*", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).alias("__i"), F.count("*").over(Window.partitionBy(group)).alias("__n"))
    # place j is at bround(j (n-1) / (k-1)); row i can only be that of the j next to i (k-1) / (n-1)
    near = F.floor(F.col("__i") * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    chosen = [F.bround((near + d) * (F.col("__n") - 1) / (k - 1)) == F.col("__i") for d in (-1, 0, 1)]
    return ranked.where((F.col("__n") <= k) | chosen[0] | chosen[1] | chosen[2]).drop("__i", "__n")


def diverse_top(candidates: pd.DataFrame, k: int, conflict: Callable[[pd.Series, pd.Series], bool]) -> pd.DataFrame:
    """Greedy choice of k rows in the order given, leaving out any that conflicts with one chosen before."""
    chosen: list[pd.Series] = []
    for _, row in candidates.iterrows():
        if len(chosen) == k:
            break
        if not any(conflict(row, c) for c in chosen):
            chosen.append(row)
    return pd.DataFrame(chosen, columns=candidates.columns)


def schedule(levels: DataFrame, key: list[str], seed: str, workers: int) -> DataFrame:
    """Hash-ordered rows with place, worker (place mod workers) and round."""
    return numbering.numbered(levels, "place", ranking_key(F.lit(seed), *[F.col(k) for k in key])).select("*", (F.col("place") % workers).alias("worker"), F.floor(F.col("place") / workers).alias("round"))
